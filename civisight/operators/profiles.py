"""Profiles of registries and snapshots, and gates between two snapshots."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions.money import ratio
from civisight.functions.text import ColumnOrName, as_col, is_masked, plausible_year
from civisight.session import settle


def registry_profile(df: DataFrame, key: str, cancelled: str, document: str, operator: str, state: str, year: str) -> DataFrame:
    """One-row profile: volumes, masked documents, operators, plausible years, states."""
    y = plausible_year(year)
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col(cancelled).isNull()).alias("active"),
        F.count_if(F.col(cancelled).isNotNull()).alias("cancelled"),
        F.count_if(F.col(document).isNotNull()).alias("with_document"),
        F.count_if(is_masked(document)).alias("masked_documents"),
        F.count_distinct(operator).alias("operators"), F.count_if(F.col(state).isNull()).alias("without_state"),
        F.min(y).alias("first_year"), F.max(y).alias("last_year"),
        F.sort_array(F.collect_set(state)).alias("states"),
    )


def set_change(old: DataFrame, new: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """One row: keys added, removed and shared, Jaccard index, first sorted samples."""
    a = old.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_old", F.lit(True))
    b = new.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_new", F.lit(True))
    both = settle(a.join(b, key, "full"))
    added, removed = F.col("_old").isNull(), F.col("_new").isNull()

    def first(mask: Column) -> Column:
        head = both.filter(mask).select(key).orderBy(key).limit(sample)
        return head.agg(F.sort_array(F.collect_list(key))).scalar()

    counts = both.agg(
        F.count_if(added).alias("added"), F.count_if(removed).alias("removed"),
        F.count_if(~added & ~removed).alias("shared"), F.count("*").alias("union"))
    return counts.select(
        "added", "removed", "shared",
        F.when(F.col("union") > 0, F.round(ratio("shared", "union"), 6)).otherwise(F.lit(1.0)).alias("jaccard"),
        first(added).alias("added_sample"), first(removed).alias("removed_sample"),
    )


def accept_snapshot(candidate: DataFrame, current: DataFrame, expected: Sequence[str], key: str, names: str, min_rows: int = 1000, min_ratio: float = 0.9) -> DataFrame:
    """One row: may the candidate replace the current snapshot, why not, does it differ."""
    absent = sorted(set(expected) - set(candidate.columns))

    def values(df: DataFrame, tag: int) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(d).alias("d"), v.cast("string").alias("v")) for d, v in (
            ("row", F.lit(None)), ("key", F.col(key)), ("name", F.col(names)))])
        return df.select(F.explode(parts).alias("x"), F.lit(tag).alias("new")).select("x.*", "new")

    # each side is read once: rows per value on either side, then sums over the values
    sides = values(candidate, 1).unionByName(values(current, 0)).groupBy("d", "v").agg(
        F.sum("new").alias("n"), F.sum(1 - F.col("new")).alias("o"))
    moved = F.col("v").isNotNull() & (F.col("d") != "row") & ((F.col("n") > 0) != (F.col("o") > 0))
    new = sides.agg(
        F.coalesce(F.sum(F.when(F.col("d") == "row", F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("d") == "row", F.col("o"))), F.lit(0)).alias("current_rows"), F.count_if(moved).alias("_moved"))
    vs = ratio("rows", "current_rows")
    reason = (
        F.when(F.lit(bool(absent)), F.lit("missing columns: " + ", ".join(absent)))
        .when(F.col("rows") < min_rows, F.lit("too few rows"))
        .when((F.col("current_rows") > 0) & (vs < min_ratio), F.lit("too small against current"))
        .otherwise(F.lit("ok"))
    )
    return new.select(
        "rows", "current_rows", vs.alias("ratio"), reason.alias("reason"), (reason == "ok").alias("accepted"),
        ((F.col("rows") != F.col("current_rows")) | (F.col("_moved") > 0)).alias("changed"),
    )


def recency_counts(df: DataFrame, date: ColumnOrName, asof: dt.date, days: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the last n days for several n; dates in the future do not count."""
    age = F.date_diff(F.lit(asof), as_col(date))
    aggs = [F.count_if(age.between(0, n)).alias(f"last_{n}_days") for n in days]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def corpus_profile(df: DataFrame, dims: Sequence[str], top: int = 20, labels: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(dimension, label, n): counts of several dimensions in one pass, the ``top`` largest of each
    besides the listed labels, which always stay, with zeros where there are none."""
    from civisight.operators.windows import top_per_group

    labels = labels or {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("label")) for d in dims
    ])).alias("x")).select("x.*")
    counts = long.groupBy("dimension", "label").agg(F.count("*").alias("n"))
    if not labels:
        return top_per_group(counts, ["dimension"], [F.col("n").desc(), F.col("label")], top)
    fixed = [F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("label")) for d, vs in labels.items() for v in vs]
    listed = df.sparkSession.range(1).select(F.explode(F.array(*fixed)).alias("x")).select("x.*").distinct().withColumn("listed", F.lit(True))
    counts = counts.join(listed, ["dimension", "label"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    cut = top_per_group(counts.filter("listed is null"), ["dimension"], [F.col("n").desc(), F.col("label")], top)
    return cut.unionByName(counts.filter("listed")).drop("listed")


def snapshot_label(df: DataFrame, source: str, date: str) -> DataFrame:
    """One date when all sources agree, else ``source date; ...`` sorted by source."""
    per = df.groupBy(source).agg(F.max(date).alias("_d"))
    day = F.date_format("_d", "yyyy-MM-dd")
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col(source), day))), "; ")
    return per.agg(F.when(F.count_distinct("_d") == 1, F.max(day)).otherwise(listed).alias("snapshot_label"))


def clean_state(df: DataFrame, name: str, month: str, amounts: Sequence[str], default: str) -> DataFrame:
    """Repair a stored state: months 1-12 only, blank names to a default, amounts re-summed."""
    label = F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(default))
    number = F.col(month).cast("string").try_cast("int")
    return (
        df.withColumn(name, label).withColumn(month, number).filter(number.between(1, 12))
        .groupBy(name, month).agg(*[F.sum(a).alias(a) for a in amounts])
    )


def coverage_counts(samples: DataFrame, top_keys: DataFrame, key: str, label: str, top: int = 20) -> DataFrame:
    """Largest labels with the rows that belong to listed keys."""
    marked = samples.join(top_keys.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    counts = marked.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("_in")).alias("n_in_top"))
    return counts.orderBy(F.col("n").desc(), F.col(label)).limit(top)
