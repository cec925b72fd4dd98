"""Packing token sequences: cutting-stock column generation over the histogram of lengths.

Documents are cut into full sequences and one remainder. The remainders' lengths, in units of
``unit`` tokens, give a histogram of bounded size; a linear program over patterns (what goes
into one sequence) is solved by column generation, with a knapsack dynamic program that prices new
patterns. Patterns are rounded down, what is left over is packed largest first, and the ranked
pieces of each length class are dealt to the patterns' slots.

A null text is empty and has the closing id only; very long texts are cut; pieces of repeated ids are
packed like any others; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civisight.llm.common import Shelf
from civisight.llm.words import Words, slices

_loaded: dict[object, object] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and its process was forked
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class WordCodes:
    """Ids of the distinct words a worker has met; started anew when it holds ``limit`` words."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.path, self.limit = path, limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def of(self, hashes: np.ndarray, text) -> np.ndarray:
        """Places of the words (distinct hashes, ascending); ``text(i)`` gives the i-th word."""
        if len(self.hashes) + len(hashes) > self.limit:
            self.clear()
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[place] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            coded = [e.ids for e in _tokenizer(self.path).encode_batch([text(i) for i in new.tolist()], add_special_tokens=False)]
            size = np.array([len(c) for c in coded], np.int64)
            order = np.argsort(both := np.concatenate([self.hashes, hashes[new]]))
            self.hashes = both[order]
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.flat = np.concatenate([self.flat, np.array([i for c in coded for i in c], "<u4")])
        return np.searchsorted(self.hashes, hashes)


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows in a row, offsets): the tokenizer ignores case and never joins over white space
    or between ASCII letters and signs, so each distinct piece is encoded once."""
    # names of special tokens are read as they are written
    plain = b"<|" not in data.tobytes()
    words = Words(data, offsets, lower=plain, split=plain)
    hashes, where, back = np.unique(words.hash, return_index=True, return_inverse=True)
    raw, start, end = words.data.tobytes(), words.start[where].tolist(), words.end[where].tolist()
    codes = _loaded.setdefault((path, "codes"), WordCodes(path))
    at = codes.of(hashes, lambda i: raw[start[i]:end[i]].decode()) if len(hashes) else np.zeros(0, np.int64)
    size, begin, flat = codes.size[at], codes.begin[at], codes.flat
    each = size[back] if len(back) else np.zeros(0, np.int64)
    # one closing id after the last word of each row
    ends = np.append(0, np.cumsum(each))[words.first]
    out_offsets = ends + np.arange(len(offsets))
    ids = np.full(int(out_offsets[-1]), closing, "<u4")
    total = int(each.sum())
    if total:
        inside = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
        place = np.arange(total) + np.repeat(words.row, each)
        ids[place] = flat[np.repeat(begin[back], each) + inside]
    return ids, out_offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batches: Iterator[pa.RecordBatch], size: int, path: str, closing: int):
    for batch in batches:
        for rows, data, offsets in slices(batch, limit=4 << 20):
            ids, cut = token_ids(data, offsets, path, closing)
            raw, out = ids.tobytes(), []
            for doc, a, b in zip(rows.column(0).to_pylist(), cut[:-1].tolist(), cut[1:].tolist()):
                for s in range(a, b, size):
                    e = min(s + size, b)
                    out.append((doc, s - a, e - s, zlib.crc32(raw[4 * s:4 * e]), b - a))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def _price(duals: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best pattern for the duals of sizes 1 to ``room``: unbounded knapsack."""
    value, chosen = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for r in range(1, room + 1):
        gain = value[r - 1::-1] + duals[:r]
        k = int(gain.argmax())
        value[r], chosen[r] = (gain[k], k + 1) if gain[k] > value[r - 1] else (value[r - 1], 0)
    pattern, r = np.zeros(room), room
    while r > 0:
        pattern[chosen[r] - 1] += chosen[r] > 0
        r -= max(chosen[r], 1)
    return value[room], pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product without BLAS, whose threads do not survive the driver's fork of the JVM."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        k = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, m:]


def _first_fit(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """A starting basis: largest sizes first, each pattern used until a size is exhausted."""
    m = len(sizes)
    left, basis = demand.astype(float), [None] * m
    while (left > 1e-9).any():
        p, free = np.zeros(m), room
        for i in range(m - 1, -1, -1):
            if left[i] > 1e-9:
                p[i] = min(max(1, int(left[i])), free // sizes[i])
                free -= int(p[i]) * sizes[i]
        on = np.flatnonzero(p)
        share = left[on] / p[on]
        left[on] -= p[on] * share.min()
        done = on[share <= share.min() + 1e-12]
        left[done] = 0
        basis[done[-1]] = p
        for i in done[:-1]:  # sizes that end together: all but one get a pattern of their own
            basis[i] = np.where(np.arange(m) == i, room // sizes[i], 0).astype(float)
    return basis


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 1500, gap: float = 0.001) -> list[tuple[np.ndarray, int]]:
    """[(pattern, times)] that cover the demand exactly; sizes ascending, in units.

    Columns are generated until the program is within ``gap`` of its bound (or for ``rounds`` pivots).
    """
    m = len(sizes)
    if not m:
        return []
    basis = _first_fit(sizes, demand, room)
    inverse = _inverse(np.column_stack(basis))
    x, volume = np.maximum(_times(inverse, demand), 0), sizes / room
    bound = (volume * demand).sum()
    for turn in range(rounds):
        if turn % 200 == 199:
            inverse = _inverse(np.column_stack(basis))
            x = np.maximum(_times(inverse, demand), 0)
        if x.sum() <= bound * (1 + gap):
            break
        # prices pulled towards the volume's keep the columns from swinging; the true ones decide at last
        duals = inverse.sum(0)
        for pull in (0.9, 0.6, 0.0):
            prices = np.full(room, -1.0)
            prices[sizes - 1] = pull * volume + (1 - pull) * duals
            best, new = _price(prices, room)
            new = new[sizes - 1]
            if (duals * new).sum() > 1 + 1e-6:
                break
        else:
            break
        if not pull:
            bound = max(bound, x.sum() / best)
        way = _times(inverse, new)
        ok = way > 1e-9
        if not ok.any():
            break
        leave = int(np.argmin(np.where(ok, x / np.where(ok, way, 1), np.inf)))
        step = x[leave] / way[leave]
        x = np.maximum(x - step * way, 0)
        x[leave] = step
        row = inverse[leave] / way[leave]
        inverse = inverse - way[:, None] * row
        inverse[leave] = row
        basis[leave] = new
    left, out = demand.astype(np.int64).copy(), []
    for p, times in zip(basis, x):
        p = p.astype(np.int64)
        times = min([int(max(times, 0) + 1e-6), *(left[p > 0] // p[p > 0])])
        if times > 0:
            out.append((p, times))
            left -= p * times
    out += _largest_first(sizes, left, room)
    plain = _largest_first(sizes, demand.astype(np.int64), room)
    return min(out, plain, key=lambda plan: sum(times for _, times in plan))


def _largest_first(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    left, out = left.copy(), []
    while left.any():
        p, free = np.zeros(len(sizes), np.int64), room
        for i in range(len(sizes) - 1, -1, -1):
            p[i] = min(left[i], free // sizes[i])
            free -= p[i] * sizes[i]
        times = int(min(left[p > 0] // p[p > 0]))
        out.append((p, times))
        left -= p * times
    return out


def pack_documents(docs: DataFrame, size: int = 2048, unit: int = 8, path: str | None = None, closing: int = 1, per_rank: int = 50_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of docs(doc_id, text)."""
    shelf, path = Shelf(docs.sparkSession), path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = shelf.put(docs.mapInArrow(lambda b: _pieces(b, size, path, closing), PIECES), "pieces")
    pieces = pieces.withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    # at most size / unit rows: the histogram does not grow with the documents
    histogram = dict(pieces.groupBy("units").count().collect())
    sizes = np.array(sorted(histogram), np.int64)
    plan = patterns(sizes, np.array([histogram[s] for s in sizes.tolist()], np.int64), size // unit)
    slots: dict[int, list[np.ndarray]] = {}
    first = 0
    for p, times in plan:
        for i in np.flatnonzero(p):
            slots.setdefault(int(sizes[i]), []).append(np.array([p[i] * times, p[i], first], np.int64))
        first += times
    tables = {u: np.array(rows).T for u, rows in slots.items()}
    starts = {u: np.cumsum(t[0]) - t[0] for u, t in tables.items()}

    # ranks within a length class, counted per bucket so that no class is sorted in one task
    buckets = max(1, -(-sum(histogram.values()) // per_rank))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = pieces.groupBy("units", "bucket").count().withColumn(
        "before", F.sum("count").over(W.partitionBy("units").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    ranked = (pieces.withColumn("rank", F.row_number().over(W.partitionBy("units", "bucket").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")) - 1)
              .join(shelf.put(before.select("units", "bucket", F.coalesce("before", F.lit(0)).alias("before")), "before"), ["units", "bucket"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", (F.col("rank") + F.col("before")).alias("rank")))

    def dealt(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            units, rank = np.array(batch.column(5)), np.array(batch.column(6))
            sequence = np.zeros(len(units), np.int64)
            for u in np.unique(units).tolist():
                mine = units == u
                at = np.searchsorted(starts[u], rank[mine], "right") - 1
                sequence[mine] = tables[u][2][at] + (rank[mine] - starts[u][at]) // tables[u][1][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)], names=[*batch.schema.names[:5], "sequence_id"])

    placed = shelf.put(ranked.mapInArrow(dealt, PIECES + ", sequence_id long"), "placed")
    inside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long")))
