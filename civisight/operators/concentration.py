"""Shares of the largest contributors, and rates without a dominant one."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions.money import ratio
from civisight.operators.windows import top_per_group
from civisight.session import settle


def top_share(totals: DataFrame, key: str, value: str, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Share of the k largest keys in the grand total (one row)."""
    grand = totals.agg(F.sum(value)).scalar()
    out = totals.orderBy(F.col(value).desc(), F.col(key)).limit(max(ks))
    ranked = top_per_group(out.withColumn("_g", F.lit(1)), ["_g"], [F.col(value).desc(), F.col(key)], max(ks), rank="_r")
    return ranked.agg(
        grand.cast("double").alias("total"),
        *[ratio(F.sum(F.when(F.col("_r") <= k, F.col(value))), grand).alias(f"top{k}_share") for k in ks],
    )


def supporter_profile(rows: DataFrame, supporter: str, author: str, committed: str, paid: str, top: int = 20, nested: int = 3) -> DataFrame:
    """Largest supporters with sums, share, distinct authors over all rows and their top authors."""
    positive = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)))
    pairs = settle(rows.groupBy(supporter, author).agg(positive(committed).alias("_c"), positive(paid).alias("_p")))
    totals = pairs.groupBy(supporter).agg(
        F.sum("_c").alias("committed"), F.sum("_p").alias("paid"), F.count(F.lit(1)).alias("authors_count"))
    grand = totals.agg(F.sum("committed")).scalar()
    best = (
        totals.filter("committed is not null").withColumn("share", ratio("committed", grand))
        .orderBy(F.col("committed").desc(), F.col(supporter)).limit(top)
    )
    ranked = top_per_group(pairs.filter("_c is not null"), [supporter], [F.col("_c").desc(), F.col(author)], nested, rank="_r")
    authors = ranked.groupBy(supporter).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.col(author).alias("author"), F.col("_c").cast("double").alias("committed")))),
        lambda s: F.struct(s["author"].alias("author"), s["committed"].alias("committed"))).alias("top_authors"))
    return best.join(authors, supporter, "left")


def dominant_contributor(rows: DataFrame, group: Sequence[str], contributor: str, denied: Column) -> DataFrame:
    """Per group: contributors, attributed rows, and the contributor with most rows
    (then most denials, then the smallest id)."""
    per = settle(rows.groupBy(*group, contributor).agg(F.count("*").alias("_n"), F.count_if(denied).alias("_d")))
    totals = per.groupBy(*group).agg(F.count("*").alias("distinct_contributors"), F.sum("_n").alias("total_attributed"))
    top = top_per_group(per, group, [F.col("_n").desc(), F.col("_d").desc(), F.col(contributor).asc()], 1)
    top = top.select(*group, F.col(contributor).alias("top_id"), F.col("_n").alias("top_total"), F.col("_d").alias("top_denied"))
    return totals.join(top, list(group))


def adjusted_rate(groups: DataFrame, total: str = "total", denied: str = "denied", min_total: int = 200, min_share: float = 0.30, min_rate: float = 0.80) -> DataFrame:
    """Denial rate without a contributor that dominates the group; needs ``top_total`` and
    ``top_denied`` of ``dominant_contributor`` (null where nobody could be attributed)."""
    t, d = F.coalesce("top_total", F.lit(0)), F.coalesce("top_denied", F.lit(0))
    share, rate = ratio(t, total), ratio(d, t)
    flag = (F.col(total) >= min_total) & (share >= min_share) & (rate >= min_rate)
    return groups.withColumns({
        "top_share": share, "top_denied_rate": rate, "concentrated": flag,
        "denied_rate_adjusted": F.when(flag, ratio(F.col(denied) - d, F.col(total) - t)).otherwise(ratio(denied, total)),
        "flagged_id": F.when(flag, F.col("top_id")),
    })


def latest_by_year(rows: DataFrame, key: str, year: str) -> DataFrame:
    """A later year overwrites an earlier one."""
    return top_per_group(rows, [key], [F.col(year).desc()], 1)


def with_concentration(rows: DataFrame, concentration: DataFrame, key: str, fields: Sequence[str] = ("concentrated", "denied_rate_adjusted")) -> DataFrame:
    """Attach flag and adjusted rate to alert or profile rows."""
    return rows.join(concentration.select(key, *fields), key, "left").withColumn(
        "concentrated", F.coalesce("concentrated", F.lit(False)))
