"""Stream forms of the monitors: new-key alerts, snapshot deltas, first-seen feeds.

Increments use Spark's own keyed state (stateful deduplication), or a table bucketed by key of which a batch rewrites
the buckets it touches. Where a batch is a whole snapshot, it is kept as a table in a shared folder, in two slots that take
turns: batch n reads slot (n-1) mod 2 and overwrites slot n mod 2. A batch that is run again after a lost driver or
executor reads the same state and writes the same files, so every key is reported once.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civisight.functions.arrays import short_id
from civisight.functions.text import clean_text, first_line, word_count
from civisight.operators.lookups import new_keys, snapshot_diff
from civisight.sources.readers import read_state
from civisight.sources.sinks import upsert_buckets


class StateSlots:
    """The last two snapshots of one streaming job; ``seed`` is the one before batch 0."""

    def __init__(self, path: str, seed: DataFrame | None = None):
        self.path, self.seed = path, seed

    def read(self, spark: SparkSession, batch: int) -> DataFrame | None:
        if batch == 0:
            return self.seed
        return spark.read.parquet(f"{self.path}/slot={(batch - 1) % 2}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/slot={batch % 2}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there, then stop (the reference schedules its monitors as batches)."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_key_alert(stream: DataFrame, keys: Sequence[str], path: str, seed: DataFrame | None = None, snapshot: bool = True) -> str:
    """Every key is reported once. Without a seed the first batch only fills the state.

    ``snapshot`` batches are complete lists: the state becomes the current keys, so a key that
    went away and comes back is reported again. Otherwise batches are increments: keys met before are dropped by
    Spark's state store, those of the seed by a join. Returns the folder of alerts, one sub-folder per batch.
    """
    out = f"{path}/alerts"

    def report(alerts: DataFrame, number: int) -> None:
        alerts.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    if not snapshot:
        fresh = stream.select(*keys).dropDuplicates(list(keys))
        if seed is not None:
            fresh = fresh.join(seed.select(*keys).distinct(), list(keys), "left_anti")

        def increment(batch: DataFrame, number: int) -> None:
            # a silent first batch must still go through the state, so its filter is none that Spark can resolve beforehand
            report(batch if seed is not None or number > 0 else batch.filter(F.spark_partition_id() < 0), number)

        run_available(fresh, increment, f"{path}/checkpoint")
        return out
    slots = StateSlots(f"{path}/state", seed)

    def each(batch: DataFrame, number: int) -> None:
        seen = slots.read(batch.sparkSession, number)
        current = batch.select(*keys).distinct()
        first = seen is None
        report(new_keys(current, current if first else seen.select(*keys), keys, first_run=first), number)
        slots.write(current, number)

    run_available(stream, each, f"{path}/checkpoint")
    return out


def append_first_seen(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row of each key of an append-only feed; state is dropped after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def snapshot_delta(
    stream: DataFrame, totals: Callable[[DataFrame], DataFrame], keys: Sequence[str], value: str, path: str,
    seed: DataFrame | None = None, version: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Change per key between consecutive snapshots, and a history row per batch.

    ``totals`` reduces a batch to one row per key. ``version`` gives a one-column table of the
    source's version; an unchanged one leaves the state alone and adds a history row of zeros.
    Returns the folder of deltas; history rows are in ``<path>/history``.
    """
    slots, versions = StateSlots(f"{path}/state", seed), StateSlots(f"{path}/version")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        previous = slots.read(spark, number)
        current = totals(batch)
        changed = True
        if version is not None:
            stamp, before = version(batch), versions.read(spark, number)
            changed = before is None or not stamp.exceptAll(before).isEmpty() or not before.exceptAll(stamp).isEmpty()
            versions.write(stamp, number)
        now = current if changed or previous is None else previous
        base = now if previous is None else previous
        delta = snapshot_diff(now, base, keys, value)
        delta.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{path}/delta/batch={number}")
        up = F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).cast("double")
        history = spark.read.parquet(f"{path}/delta/batch={number}").agg(
            F.lit(number).alias("batch_id"), up.alias("delta_positive"), F.coalesce(F.sum("delta"), F.lit(0)).cast("double").alias("delta_net"),
            F.lit(changed).alias("source_changed"))
        history.write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        slots.write(now, number)

    run_available(stream, each, f"{path}/checkpoint")
    return f"{path}/delta"


def upsert_stream(stream: DataFrame, keys: Sequence[str], order: str, path: str, seed: DataFrame | None = None, buckets: int = 256) -> str:
    """Keyed table kept by a stream of updates, the largest ``order`` wins, also over batches; a batch rewrites
    the buckets of its keys only. Returns the folder of the table, empty if there were no updates yet."""
    spark, out = stream.sparkSession, f"{path}/table"

    def each(batch: DataFrame, number: int) -> None:
        rows = seed.unionByName(batch, allowMissingColumns=True) if number == 0 and seed is not None else batch
        upsert_buckets(rows, out, keys, order, buckets, newest=True)

    run_available(stream, each, f"{path}/checkpoint")
    if read_state(spark, out, stream.schema).isEmpty():
        rows = spark.createDataFrame([], stream.schema) if seed is None else seed
        if not upsert_buckets(rows, out, keys, order, buckets):
            rows.write.mode("overwrite").parquet(f"{out}/bucket=0")
    return out


# -------------------------------------------------------------- posts feed

POST_SCHEMA = T.StructType([T.StructField("post", T.StructType([
    T.StructField("uri", T.StringType()), T.StructField("cid", T.StringType()),
    T.StructField("record", T.StructType([T.StructField("text", T.StringType()), T.StructField("createdAt", T.StringType())])),
]))])


def read_posts(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """A folder of JSON lines with posts."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(POST_SCHEMA).json(path)


def posts_to_records(posts: DataFrame, source: str, kind: str, default_title: str, id_prefix: str) -> DataFrame:
    """Posts to corpus records: hashed id, first line as title, no empty texts."""
    text = F.trim(F.col("post.record.text"))
    made = F.try_to_timestamp(F.col("post.record.createdAt"))
    return posts.select(
        short_id("post.uri", 18, id_prefix).alias("id"), F.col("post.uri").alias("url"), F.lit(source).alias("source"), F.lit(kind).alias("type"),
        F.to_date(made).alias("date"), first_line("post.record.text", 120, default_title).alias("title"), text.alias("text"),
        word_count(text).alias("word_count"), made.alias("updated_at"),
    ).filter(clean_text("text").isNotNull())
