"""Hard-negative mining by Strassen products of integer tiles.

1. Vectors become integers, floor(scale * x). Rows are ordered by label and id over the cluster and cut into tiles
   of at most ``ROWS`` rows of one label; the anchors among them form tiles of their own.
2. Tiles meet in the cells of a grid: anchors in waves, candidates in groups, each cell a few tiles of either side, so no
   task holds more than one cell's anchors and one tile of candidates. A tile pair is one product of int64
   matrices by Strassen's recursion, padded with zeros: seven products and eighteen sums of half the size, all
   exact (integer sums wrap, so a score is right wherever it fits in 64 bits itself, less the factor of 100 of the bounds).
3. Heaps: a cell keeps each anchor's first ``positives`` rows of its label (first pass) or, for each positive, the
   first ``negatives`` rows of other labels inside the positive's window of scores (second pass). Heaps of the
   cells of an anchor merge by rank, which Spark limits before the shuffle.

Rows with a null id, label or vector or a null or non-finite component take no part. Rows that repeat an id with the
same label are one row (that with the least vector); with different labels they are rows of their own, anchors too,
and never each other's positives. Ties go to the smaller id. Shorter vectors are padded with zeros. A label
may hold any share of the rows; further columns are ignored; no rows or no anchors give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civisight.llm.common import Shelf, width

ROWS = 512  # rows of a tile
ANCHORS = 256  # rows of a tile of anchors
LEAF = 32
_TILE = "tile string, label long, anchor boolean, ids binary, dims int, matrix binary"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by Strassen's recursion down to a side of ``leaf``; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    half = [(x + 1) // 2 for x in (m, k, n)]
    a = np.pad(a, ((0, 2 * half[0] - m), (0, 2 * half[1] - k)))
    b = np.pad(b, ((0, 2 * half[1] - k), (0, 2 * half[2] - n)))
    h, i, j = half
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k allowed entries: higher scores first, ties by the smaller id."""
    low = np.iinfo(np.int64).min
    held = np.where(allowed, scores, low)
    least = np.partition(held, held.shape[1] - k, axis=1)[:, -k] if held.shape[1] > k else np.full(len(held), low)
    row, column = np.nonzero(allowed & (scores >= least[:, None]))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]


def _matrix(tile: dict, key: str) -> np.ndarray:
    return np.frombuffer(tile["matrix"], np.int64).reshape(-1, tile["dims"]) if tile["dims"] else np.zeros((len(tile[key]) // 8, 0), np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]):
    """Tiles of rows (label, id, name, anchor, vector) that come sorted by label, name, id and vector."""
    held: list[tuple] = []
    anchors: list[tuple] = []  # over the tiles of a label, so that products are large enough for the recursion
    last, count, prefix = None, 0, None

    def tile(rows: list[tuple], anchor: bool):
        nonlocal count
        count += 1
        dims = max(len(r[3]) for r in rows)
        matrix = np.zeros((len(rows), dims), np.int64)
        for m, r in zip(matrix, rows):
            m[:len(r[3])] = r[3]
        return (f"{prefix}-{count}", rows[0][0], anchor, np.array([r[1] for r in rows], np.int64).tobytes(), dims, matrix.tobytes())

    def flush(rows: list[tuple], anchor: bool):
        made = [tile(rows, anchor)]
        rows.clear()
        columns = list(zip(*made))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=["tile", "label", "anchor", "ids", "dims", "matrix"])

    for batch in batches:
        for label, id, anchor, vector in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("label", "id", "anchor", "vector"))):
            if (label, id) == last:
                continue
            if held and (label != held[0][0] or len(held) == ROWS):
                yield flush(held, False)
            if anchors and (label != anchors[0][0] or len(anchors) == ANCHORS):
                yield flush(anchors, True)
            prefix, last = prefix or f"{label}:{id}", (label, id)
            held.append((label, id, anchor, vector))
            if anchor:
                anchors.append(held[-1])
    if held:
        yield flush(held, False)
    if anchors:
        yield flush(anchors, True)


def _cells(batches: Iterator[pa.RecordBatch], k: int, window: tuple[int, int] | None):
    """Heaps of the cells; rows come sorted by cell, the cell's anchors first, then its candidates, tile by tile."""
    cell, anchors = None, []
    for batch in batches:
        out: list[tuple] = []
        for tile in batch.to_pylist():
            if tile["cell"] != cell:
                cell, anchors = tile["cell"], []
            ids, matrix = np.frombuffer(tile["ids"], np.int64), _matrix(tile, "ids")
            if tile["anchor"]:
                anchors.append((tile, ids, matrix))
                continue
            for a, a_ids, a_matrix in anchors:
                if (a["label"] == tile["label"]) is not (window is None):
                    continue
                dims = min(matrix.shape[1], a_matrix.shape[1])  # beyond it one of the two is zero
                scores = strassen(np.ascontiguousarray(a_matrix[:, :dims]), np.ascontiguousarray(matrix[:, :dims].T))
                if window is None:
                    row, column = best(scores, a_ids[:, None] != ids[None, :], ids, k)
                    out += zip([a["tile"]] * len(row), row.tolist(), a_ids[row].tolist(), [None] * len(row), [None] * len(row),
                               ids[column].tolist(), scores[row, column].tolist())
                    continue
                for at, positive, top in (w.values() for w in a["wanted"] or ()):
                    # a window is a row of the product of its own: positives that share an anchor differ in bounds
                    mine = scores[at][None, :]
                    _, column = best(mine, (100 * mine >= window[0] * top) & (100 * mine <= window[1] * top), ids, k)
                    out += ((a["tile"], at, int(a_ids[at]), positive, top, int(ids[c]), int(scores[at, c])) for c in column)
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                         names=["tile", "at", "anchor_id", "positive_id", "positive_score", "other_id", "score"])


_HEAP = "tile string, at int, anchor_id long, positive_id long, positive_score long, other_id long, score long"


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Rows here are tiles of up to 256 KB, so few of them go to Python at once."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _grid(anchors: DataFrame, candidates: DataFrame, key: str | None, per_cell: int = 8) -> DataFrame:
    """Anchor and candidate tiles dealt to the cells of a grid, of each value of ``key`` or of all tiles; tiles are
    counted first, so that cells stay small."""
    tiles = lambda name: F.ceil(F.count("*") / per_cell).cast("int").alias(name)
    if key:
        sizes = anchors.groupBy(key).agg(tiles("waves")).join(candidates.groupBy(key).agg(tiles("groups")), key)
        a, c, prefix = anchors.join(sizes, key), candidates.join(sizes, key), [F.col(key)]
    else:
        counts = {"waves": anchors.agg(tiles("n")).scalar(), "groups": candidates.agg(tiles("n")).scalar()}
        a, c, prefix = anchors.withColumns(counts), candidates.withColumns(counts), []
    cell = lambda wave, group: F.concat_ws(":", *prefix, wave, group).alias("cell")
    spread = lambda by: F.pmod(F.xxhash64("tile"), F.col(by))
    every = lambda by: F.explode(F.when(F.col(by) > 0, F.sequence(F.lit(0), F.col(by) - 1)))
    a, c = a.withColumn("_i", every("groups")), c.withColumn("_i", every("waves"))
    names = ["tile", "label", "anchor", "ids", "dims", "matrix", "wanted"]
    return (a.select(cell(spread("waves"), F.col("_i")), *names)
            .unionByName(c.select(cell(F.col("_i"), spread("groups")), *names)))


def hard_negatives(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows(id, vector, label).

    Anchors are the rows where ``anchor`` holds; a negative's score lies between ``window`` per cent of its positive's.
    """
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession)
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = (rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .filter("id is not null and label is not null and vector is not null").filter(whole)
            .withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("long")))
            .withColumn("name", F.xxhash64("id")))
    order = ["label", "name", "id"]
    with _small_batches(spark, 1000):
        tiles = shelf.put(base.repartitionByRange(*order).sortWithinPartitions(*order, "vector")
                          .select("label", "id", "anchor", "vector").mapInArrow(_tiles, _TILE), "tiles")
    candidates = tiles.filter("not anchor").withColumn("wanted", F.lit(None).cast("array<struct<at:int,id:long,score:long>>"))
    anchors = tiles.filter("anchor")

    def heaps(anchors: DataFrame, key: str | None, k: int, bounds, by: list[str]) -> DataFrame:
        grid = _grid(anchors, candidates, key)
        with _small_batches(spark, 64):
            found = shelf.put(grid.repartition(width(spark), "cell").sortWithinPartitions("cell", F.desc("anchor"))
                              .mapInArrow(lambda b: _cells(b, k, bounds), _HEAP), "heaps")
        first = W.partitionBy("tile", "at", *by).orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    near = shelf.put(heaps(anchors.withColumn("wanted", F.lit(None).cast("array<struct<at:int,id:long,score:long>>")),
                           "label", positives, None, []), "positives")
    wanted = near.groupBy("tile").agg(F.collect_list(F.struct("at", F.col("other_id").alias("id"), "score")).alias("wanted"))
    asked = shelf.put(anchors.join(wanted, "tile"), "asked")
    far = heaps(asked, None, negatives, window, ["positive_id"])
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))
