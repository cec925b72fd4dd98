"""Top lists. Ties are broken by key, so a ranking does not depend on row order."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions.money import ratio
from civisight.operators.windows import top_per_group


def top_n(df: DataFrame, value: str, key: str | Sequence[str], n: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.col(value).desc(), *[F.col(k) for k in keys]).limit(n)


def rank_rows(df: DataFrame, order: Sequence[Column], n: int, where: Column | None = None) -> DataFrame:
    """First rows in a composite order, optionally above a volume floor."""
    return (df if where is None else df.filter(where)).orderBy(*order).limit(n)


def chosen_ranking(by_year: DataFrame, overall: DataFrame, year: int | None, n: int = 25, rank: str = "position") -> DataFrame:
    """First rows of one year's ranking, or of the whole series (``year`` null) if no year is asked for.

    A year that has no ranking is replaced by the latest that has one; without any, the whole series is shown.
    """
    whole = overall.filter(F.col(rank) <= n).withColumn("year", F.lit(None).cast("int"))
    if year is None:
        return whole
    shown = by_year.agg(F.coalesce(F.max(F.when(F.col("year") == year, F.col("year"))), F.max("year"))).scalar()
    one = by_year.filter((F.col("year") == shown) & (F.col(rank) <= n))
    return one.unionByName(whole.filter(shown.isNull()).select(*one.columns), allowMissingColumns=True)


def top_n_plus_pinned(df: DataFrame, order: Sequence[Column], n: int, pinned: Column, volume: str, key: str) -> DataFrame:
    """Top rows, plus the largest row that matches a pattern when it is not among them."""
    head = df.orderBy(*order).limit(n)
    pin = df.filter(pinned).orderBy(F.col(volume).desc(), F.col(key)).limit(1)
    extra = pin.join(head.select(key), key, "left_anti")
    return head.withColumn("is_pinned", F.lit(False)).unionByName(extra.withColumn("is_pinned", F.lit(True)))


def topk_with_other(
    counts: DataFrame, year: str, label: str, n: str, k: int, other: str, totals: DataFrame, total: str,
    restricted: str | None = None, fold_measures: bool = False, other_is_label: bool = False,
) -> DataFrame:
    """Dense (year, label) grid of the k largest labels and the folded rest, with shares.

    With ``other_is_label`` the rest is itself a label of the data (it joins the list when it
    is not among the k); its second measure then counts its own rows only, unless
    ``fold_measures``.
    """
    ranking = counts.groupBy(label).agg(F.sum(n).alias("_all")).orderBy(F.col("_all").desc(), F.col(label)).limit(k)
    head = ranking.select(F.col(label).alias("_top"))
    folded = counts.join(head, counts[label] == head["_top"], "left").withColumn("_l", F.coalesce("_top", F.lit(other)))
    own = F.lit(True) if fold_measures else (F.col(label) == F.col("_l"))
    aggs = [F.sum(n).alias("count")]
    if restricted:
        aggs.append(F.sum(F.when(own, F.col(restricted))).alias("restricted_count"))
    cells = folded.groupBy(year, F.col("_l").alias(label)).agg(*aggs)
    # the k labels and the rest, for every year with data
    labels = ranking.select(label).unionByName(counts.sparkSession.range(1).select(F.lit(other).alias(label))).distinct()
    years = totals.agg(F.sort_array(F.collect_set(year))).scalar()
    grid = labels.select(label, F.explode(years).alias(year))
    out = grid.join(cells, [year, label], "left").join(totals.select(year, total), year)
    out = out.withColumn("count", F.coalesce("count", F.lit(0)))
    if restricted:
        out = out.withColumn("restricted_count", F.coalesce("restricted_count", F.lit(0))).withColumn(
            "restricted_rate", ratio("restricted_count", "count"))
    return out.withColumn("share", ratio("count", total)).drop(total)


def nested_profile(counts: DataFrame, group: str, item: str, detail: str, n: str, restricted: str, items: int = 6, details: int = 3) -> DataFrame:
    """Exploded form of a nested top list: the largest items per group, and for each its
    largest details with their share."""
    per_item = counts.groupBy(group, item).agg(F.sum(n).alias("item_total"), F.sum(restricted).alias("item_restricted"))
    best = top_per_group(per_item, [group], [F.col("item_total").desc(), F.col(item)], items, rank="item_rank")
    per_detail = counts.groupBy(group, item, detail).agg(F.sum(n).alias("detail_total"))
    fine = top_per_group(per_detail, [group, item], [F.col("detail_total").desc(), F.col(detail)], details, rank="detail_rank")
    return best.join(fine, [group, item]).withColumns({
        "item_restricted_rate": ratio("item_restricted", "item_total"), "share_in_item": ratio("detail_total", "item_total")})


def nest_profile(flat: DataFrame, group: str, item: str, detail: str) -> DataFrame:
    """Nested form for export: at most items x details entries per group."""
    inner = flat.groupBy(group, item, "item_rank", "item_total", "item_restricted", "item_restricted_rate").agg(
        F.array_sort(F.collect_list(F.struct("detail_rank", detail, "detail_total", "share_in_item"))).alias("details"))
    return inner.groupBy(group).agg(F.array_sort(F.collect_list(
        F.struct("item_rank", item, "item_total", "item_restricted", "item_restricted_rate", "details"))).alias("items"))


def sample_per_group(df: DataFrame, keys: Sequence[str], text: str, order: str, k: int = 2) -> DataFrame:
    """Up to k examples per group without repeated text, earliest first."""
    usable = df.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    distinct = top_per_group(usable, [*keys, text], [F.col(order)], 1)
    return top_per_group(distinct, keys, [F.col(order)], k, rank="sample_no")


def rank_groups(df: DataFrame, rate: str, volume: str, key: str, min_volume: int, n: int, bottom: bool = False) -> DataFrame:
    """Best (or worst) groups by rate among those with enough volume."""
    order = [F.col(rate).asc(), F.col(volume).asc(), F.col(key)] if bottom else [F.col(rate).desc(), F.col(volume).desc(), F.col(key)]
    return df.filter(F.col(volume) >= min_volume).orderBy(*order).limit(n)


def recent_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def fetch_priority(df: DataFrame, failures: str, url: str, n: int | None = None) -> DataFrame:
    """Work queue: fewest failures, light pages first, short URLs first."""
    low = F.lower(F.col(url))
    heavy = low.contains("/view") | low.contains(".pdf") | low.contains("@@download/file")
    order = [F.coalesce(F.col(failures), F.lit(0)).asc(), heavy.cast("int").asc(), F.length(low).asc(), low.asc()]
    return df.orderBy(*order).limit(n) if n else df.orderBy(*order)


def sections(df: DataFrame, category: str, order: Sequence[str], recent: Column) -> DataFrame:
    """One row per listed category in a fixed order, with all and recent items."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"), F.count_if(recent).alias("n_recent"))
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in order])).alias("ordinal", category))
    return listed.join(counts, category, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_recent": F.coalesce("n_recent", F.lit(0))})


def export_order(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Total order for an export: (column, ascending); missing values go last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])
