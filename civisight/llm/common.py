"""Shared helpers: tables settled in the shared folder, packed exchanges, components."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civisight.session import CLEAN as _CLEAN
from civisight.session import shared_dir, tune

# Runtime filters let a scan skip rows that a later join drops; Spark bounds their size itself.
_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    # a batch is held several times over by its worker
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings these operators rely on."""
    tune(spark)
    for key, value in _CONF.items():
        spark.conf.set(key, value)
    return spark


class Shelf:
    """Intermediate tables of one run, written to the shared folder so that lost executors cost nothing.

    ``put`` writes and rereads a table, ``drop`` deletes one that is no longer needed. What a write has shuffled goes with
    its end, not when the driver happens to collect its garbage; only for writes, as a DataFrame of the user may be run twice.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = prepare(spark), f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shelf_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.shelf_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Shuffle width of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


PACK = "part int, kind int, a binary, b binary, c binary, d binary"


def pack(part: np.ndarray, *columns: np.ndarray, kind: int = 0, table: bytes = b"") -> pa.RecordBatch | None:
    """Rows (part, columns as blobs): entries of one chunk grouped by part, at most three columns and a table."""
    if not len(part):
        return None
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    cut = np.append(first, len(part))
    blobs = []
    for column in columns:
        column = column[order]
        blobs.append(pa.array([column[cut[i]:cut[i + 1]].tobytes() for i in range(len(ids))], pa.binary()))
    while len(blobs) < 3:
        blobs.append(pa.array([b""] * len(ids), pa.binary()))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), kind), pa.int32()), *blobs,
         pa.array([table] * len(ids), pa.binary())], names=["part", "kind", "a", "b", "c", "d"])


def exchange(packed: DataFrame, partitions: int, reduce: Callable, schema: str) -> DataFrame:
    """Bring the blobs of each part together; ``reduce(rows)`` gets one part at a time, as tuples, and yields batches."""
    def run(batches: Iterator[pa.RecordBatch]):
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in columns)
                if row[0] != now and rows:
                    yield from reduce(rows)
                    rows = []
                now = row[0]
                rows.append(row)
        if rows:
            yield from reduce(rows)

    return packed.repartitionById(partitions, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def components(shelf: Shelf, nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label): label is the smallest id reachable over edges (a, b); min-label hooking with pointer jumps.

    Given the ``labels`` of former edges, only the new edges are looked at.
    """
    labels = shelf.put(nodes.select("id", F.col("id").alias("label")) if labels is None else labels, "labels")
    while True:
        ends = (edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
                .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
                .filter("la <> lb"))
        hooks = shelf.put(ends.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("up"))
                          .groupBy("label").agg(F.min("up").alias("up")), "hooks")
        if hooks.isEmpty():
            return labels
        for _ in range(3):
            over = hooks.select(F.col("label").alias("up"), F.col("up").alias("further"))
            hooks = hooks.join(over, "up", "left").select("label", F.coalesce("further", "up").alias("up"))
        hooks = shelf.put(hooks, "jumped")  # settled, so that the join below can split a hot label
        new = shelf.put(labels.join(hooks, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
        shelf.drop(labels)
        labels = new


def smallest_hashes(df: DataFrame, k: int, id: str = "doc_id", per: str | None = None) -> DataFrame:
    """At most k rows of df (of each value of ``per``), those with the smallest hash of their id.

    Rows are counted first, so that only about 4 k candidates (of each value) are ordered, at any size.
    """
    place = F.shiftrightunsigned(F.xxhash64(id), 11) / F.lit(float(1 << 53))
    if per is None:
        n = max(df.count(), 1)
        return df.withColumn("_place", place).filter(F.col("_place") < 4 * k / n).orderBy("_place", id).limit(k).drop("_place")
    counts = df.groupBy(per).agg(F.count("*").alias("_n"))
    near = df.withColumn("_place", place).join(counts, per).filter(F.col("_place") < 4 * k / F.col("_n"))
    order = W.partitionBy(per).orderBy("_place", id)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_place", "_n", "_r")


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs with (``left_semi``) or without (``left_anti``) an id in ids(doc_id); null equals null."""
    key = f"_{uuid.uuid4().hex}"
    ids = ids.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[key]), how)
