"""Sinks: record files, reports, keyed upserts, partition refresh."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civisight.operators.windows import dedupe_last, top_per_group
from civisight.session import settle
from civisight.sources.landed import corpus_store, write_corpus
from civisight.sources.readers import read_state


def drop_empty_fields(df: DataFrame) -> DataFrame:
    """Empty strings and empty lists to null, so that JSON writers leave them out."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            col = F.nullif(col, F.lit(""))
        elif isinstance(field.dataType, T.ArrayType):
            col = F.when(F.size(col) > 0, col)
        out.append(col.alias(field.name))
    return df.select(out)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact gzip JSON lines without empty fields and without all-empty rows."""
    drop_empty_fields(df).dropna("all").write.mode("overwrite").option("compression", "gzip").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per report table. Tables are written as they come, in parallel parts."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_table_csv(df: DataFrame, path: str, columns: Sequence[str], sep: str = ";") -> None:
    """Selected columns in order, quoted, with header."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", True).csv(path)


def write_text_corpus(df: DataFrame, path: str, text: str, key: str) -> None:
    """One text file per row, in as many tasks as a shuffle has; what files cost goes by their number, not by their bytes.

    Each task fills a folder of its own, so that the job is committed, and listed again, by folder and not by file. Files are
    opened without Spark's writer, which asks the store several times for each, where the store is one that can be opened here.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(text).alias("value"), key).repartition(tasks, key).select("value")
    uri = corpus_store(df.sparkSession, path)
    if not (uri and write_corpus(rows, uri)):
        rows.withColumn("folder", F.spark_partition_id()).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


def union_typed(parts: dict[str, DataFrame], kind: str = "row_kind") -> DataFrame:
    """Rows of several shapes in one export, tagged by kind; absent columns are null."""
    out: DataFrame | None = None
    for name, part in parts.items():
        tagged = part.withColumn(kind, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Updates replace target rows of the same key; among updates the last by ``order`` wins."""
    latest = dedupe_last(updates, keys, order)
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest.select(*target.columns), allowMissingColumns=True)


def upsert_buckets(updates: DataFrame, path: str, keys: Sequence[str], order: str, buckets: int = 256, newest: bool = False) -> int:
    """Updates into a keyed table at rest, bucketed by key hash; only the buckets that updates touch are rewritten.

    Of equal keys the last update by ``order`` wins; against a stored row it always wins, or with ``newest`` only if its
    ``order`` is not smaller. The merged buckets are settled before the old ones are replaced, so a run that
    is cut off can be run again. Returns the number of buckets rewritten. Read the table with ``read_buckets``.
    """
    spark = updates.sparkSession
    fresh = settle(dedupe_last(updates, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return 0
    stored = read_buckets(spark, path, updates.schema).filter(F.col("bucket").isin(touched))
    rows = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    first = [F.col(order).desc(), F.col("_new").desc()] if newest else [F.col("_new").desc(), F.col(order).desc()]
    merged = settle(top_per_group(rows, keys, first, 1).drop("_new"))
    write_partitions(merged, path, ["bucket"])
    return len(touched)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of ``upsert_buckets`` with its bucket numbers; empty if it was never written."""
    fields = [f for f in schema.fields if f.name != "bucket"]
    return read_state(spark, path, T.StructType([*fields, T.StructField("bucket", T.IntegerType())]))


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``. Rows are rebalanced by partition value: a heavy
    value is split over as many writers as its size asks for, small ones share a writer."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def refresh_partitions(
    wanted: Iterable[int], present: dict[int, int], version: int, current: int, force: bool = False,
) -> list[int]:
    """Partition values to rebuild: forced, current, absent, or stored under another schema version."""
    return sorted(y for y in wanted if force or y == current or present.get(y) != version)
