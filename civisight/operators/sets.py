"""Set operations between sources and snapshots."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by name with a source tag; columns a source lacks are null."""
    out: DataFrame | None = None
    for name, df in sources.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def intersect_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def except_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def dataset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``copies`` = copies in a minus copies in b."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_w")).unionByName(b.select(*cols, F.lit(-1).alias("_w")))
    return both.groupBy(*cols).agg(F.sum("_w").alias("copies")).filter(F.col("copies") != 0)


def same_dataset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are the two equal as bags of rows; how many distinct rows differ."""
    return dataset_diff(a, b).agg(F.count("*").alias("different_rows")).withColumn("same", F.col("different_rows") == 0)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, low, high) that tells bags of rows apart: their number and the sums of two hashes of each.

    It does not depend on the order of rows or columns, counts copies, and merges (``merge_fingerprints``); rows are
    summed within tasks, so nothing is shuffled but one row per task. Different bags agree with a chance of about 2^-126.
    """
    parts = [x for c in sorted(columns or df.columns) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), total(F.xxhash64(*parts)).alias("low"), total(F.xxhash64(F.lit("second"), *parts)).alias("high"))


def merge_fingerprints(prints: DataFrame) -> DataFrame:
    """Fingerprint of several parts put together."""
    return prints.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "low", "high")])


def unchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two data sets agree, by their fingerprints; ``same_dataset`` compares them row by row."""
    both = fingerprint(a).unionByName(fingerprint(b, a.columns))
    return both.agg((F.count_distinct("rows", "low", "high") == 1).alias("same"))


def union_values(df: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Distinct values over all rows of a key, one row per value."""
    return df.select(*keys, F.explode(array).alias("value")).filter("value is not null and value <> ''").distinct()
