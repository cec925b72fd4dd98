"""Substring dedup: repeated word windows as edges of a de Bruijn graph, compacted to paths.

1. Every window of k words is represented by its smallest m-gram hash (minimiser). A minimiser
   seen in one document only cannot lie in a repeated window: only documents with shared ones go on.
2. Their windows (edges) with shared minimisers are grouped by hash and each gets the coordinates of
   its first occurrence: the smallest document id. Windows in a row that step in a row through the
   same source are one path; a minimiser keeps neighbours together, so most of the compaction happens
   before the shuffle, and paths are joined end to end per document after it.
3. Each path is verified: the words at the source coordinates are read and compared by digest.

Words covered by a window that also starts in a document with a smaller id are removed, all judged
on the input. A row is named by its id and a hash of its text, so rows that repeat an id keep their own words: none of
them has a smaller id than the others, and each may be the source of later ones. Parts answer with the shared minimisers
of all rows of a bucket at once; rows meet these answers in their bucket. A path whose words do not agree with its
source's is not proven and removes nothing. Null texts have no words, texts shorter than k words are left whole,
repeats inside one document stay; rows with a null id are left whole; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import PACK, Shelf, exchange, pack, width
from civisight.llm.words import Words, mix, slices

_U = np.uint64
PATHS = "doc_id long, row long, start long, windows long, source long, source_row long, source_start long"
_KEY = np.dtype([("doc", "<i8"), ("row", "<i8")])  # a row: its id and the hash that tells rows of one id apart
REPLY = 1 << 16


def _minimisers(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word index, 64-bit hash, 32 further bits, minimiser) of every window of k words."""
    n = len(words.start) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64))
    gram = np.zeros(len(words.start) - m + 1, np.uint64)
    for i in range(m):
        gram = gram * _U(0xD1342543DE82EF95) + words.hash[i:i + len(gram)]
    least, span, want = mix(gram), 1, k - m + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at, hashes = words.windows(k)
    other = np.zeros(n, np.uint64)
    for i in range(k):
        other = other * _U(0xA24BAED4963EE407) + words.hash[i:i + n]
    return at, hashes, (mix(other[at]) >> _U(32)).astype(np.uint32), least[at]


def _marks(batches: Iterator[pa.RecordBatch], k: int, m: int, parts: int):
    """Distinct minimisers of each document, packed by part."""
    for batch in batches:
        for rows, data, offsets in slices(batch, limit=4 << 20):
            words = Words(data, offsets)
            at, _, _, least = _minimisers(words, k, m)
            row = words.row[at]
            new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]))[:len(at)]
            least, row = least[new], row[new]
            order = np.lexsort((row, least))
            least, row = least[order], row[order]
            new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]))[:len(least)]
            yield from _packed(least[new] % _U(parts), _keys(rows), row[new], least[new])


def _keys(rows: pa.RecordBatch) -> np.ndarray:
    out = np.empty(rows.num_rows, _KEY)
    for name, column in (("doc", "doc_id"), ("row", "row")):
        out[name] = rows.column(rows.schema.names.index(column)).to_numpy()
    return out


def _packed(part: np.ndarray, ids: np.ndarray, row: np.ndarray, *columns: np.ndarray):
    """Blobs of one chunk; the ids that a blob needs travel with it."""
    part = part.astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, row, columns = part[order], row[order], [c[order] for c in columns]
    found, first = np.unique(part, return_index=True)
    for i, (f, e) in enumerate(zip(first, np.append(first[1:], len(part)))):
        used, local = np.unique(row[f:e], return_inverse=True)
        local = local.astype(np.uint16 if len(used) < 65536 else np.uint32)
        out = pack(np.full(e - f, found[i]), local, *[c[f:e] for c in columns[:2]], kind=local.itemsize, table=ids[used].tobytes())
        yield out


def _owners(rows: list[tuple]) -> np.ndarray:
    """Keys of the entries of packed rows."""
    return np.concatenate([np.frombuffer(r[5], _KEY)[np.frombuffer(r[2], np.uint16 if r[1] == 2 else np.uint32)] for r in rows])


def _shared(rows: list[tuple], buckets: int):
    """(bucket, rows, marks): the marks that more than one document has, for all rows of a bucket together."""
    marks, owner = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows]), _owners(rows)
    order = np.argsort(marks, kind="stable")
    marks, owner = marks[order], owner[order]
    first = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
    size = np.diff(np.append(first, len(marks)))
    many = np.repeat((size > 1) & (np.minimum.reduceat(owner["doc"], first) != np.maximum.reduceat(owner["doc"], first)), size)
    row, marks = owner["row"][many], marks[many]
    bucket = row % buckets
    order = np.lexsort((row, bucket))
    row, marks, bucket = row[order], marks[order], bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[:len(bucket)]
    cuts = [(f, min(f + REPLY, e)) for a, e in zip(first, np.append(first[1:], len(bucket))) for f in range(a, e, REPLY)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([bucket[f] for f, _ in cuts], pa.int32()), pa.array([row[f:e].tobytes() for f, e in cuts], pa.binary()),
         pa.array([marks[f:e].tobytes() for f, e in cuts], pa.binary())], names=["bucket", "rows", "marks"])


_EDGE = np.dtype([("hash", "<u8"), ("more", "<u4"), ("at", "<u4")])


def _met(batches: Iterator[pa.RecordBatch]):
    """(answers, texts) of each bucket, a batch of texts at a time; input rows are (bucket, kind, row, doc_id, text, rows,
    marks), the bucket's answers (kind 0) first, then its texts by row; texts that no answer names and repeats are left out."""
    now, blobs, answers, last = None, [], None, None
    for batch in batches:
        bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.append(0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1)
        for f, e in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows]):
            if f == e:
                continue
            if bucket[f] != now:
                now, blobs, answers, last = bucket[f], [], None, None
            part = batch.slice(f, e - f)
            if kind[f] == 0:
                blobs += zip(part.column(5).to_pylist(), part.column(6).to_pylist())
                continue
            if answers is None:
                row = np.frombuffer(b"".join(r for r, _ in blobs), np.int64)
                mark = np.frombuffer(b"".join(m for _, m in blobs), np.uint64)
                order = np.lexsort((mark, row))
                answers, blobs = (row[order], mark[order]), []
            row = part.column(2).to_numpy()
            place = np.minimum(np.searchsorted(answers[0], row), max(len(answers[0]) - 1, 0))
            named = answers[0][place] == row if len(answers[0]) else np.zeros(len(row), bool)
            named &= np.append(row[:1] != last if last is not None else True, row[1:] != row[:-1])
            last = row[-1]
            if named.any():
                yield answers, part.filter(pa.array(named)).select([2, 3, 4])


def _edges(batches: Iterator[pa.RecordBatch], k: int, m: int, parts: int):
    """Windows with shared minimisers, packed by minimiser."""
    for (owner, marks), some in _met(batches):
        for rows, data, offsets in slices(some, limit=2 << 20):
            words = Words(data, offsets)
            at, hashes, more, least = _minimisers(words, k, m)
            row, keys = words.row[at], _keys(rows)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            from_, to = np.searchsorted(owner, keys["row"]), np.searchsorted(owner, keys["row"], "right")
            keep = np.zeros(len(at), bool)
            for i in range(rows.num_rows):
                wanted, mine = marks[from_[i]:to[i]], least[cut[i]:cut[i + 1]]
                place = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                keep[cut[i]:cut[i + 1]] = wanted[place] == mine
            edge = np.empty(int(keep.sum()), _EDGE)
            edge["hash"], edge["more"] = hashes[keep], more[keep]
            edge["at"] = at[keep] - words.first[row[keep]]
            yield from _packed(mix(least[keep]) % _U(parts), keys, row[keep], edge)


def _paths(rows: list[tuple]):
    """Compacted runs of windows whose first occurrence lies in a document with a smaller id."""
    edge, owner = np.concatenate([np.frombuffer(r[3], _EDGE) for r in rows]), _owners(rows)
    order = np.lexsort((edge["at"], owner["row"], owner["doc"], edge["more"], edge["hash"]))
    edge, owner = edge[order], owner[order]
    new = np.append(True, (edge["hash"][1:] != edge["hash"][:-1]) | (edge["more"][1:] != edge["more"][:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(edge)))
    source, source_at = np.repeat(owner[first], size), np.repeat(edge["at"][first], size).astype(np.int64)
    later = owner["doc"] != source["doc"]
    at = edge["at"][later].astype(np.int64)
    yield from _runs(owner[later], at, np.ones(len(at), np.int64), source[later], source_at[later])


def _runs(owner, at, windows, source, source_at):
    """Join paths that follow each other in the document and in its source."""
    if not len(owner):
        return
    order = np.lexsort((at, source_at - at, source["row"], source["doc"], owner["row"], owner["doc"]))
    owner, at, windows, source, source_at = (x[order] for x in (owner, at, windows, source, source_at))
    end = at + windows
    new = np.append(True, (owner[1:] != owner[:-1]) | (source[1:] != source[:-1]) | (source_at[1:] - at[1:] != source_at[:-1] - at[:-1]) | (at[1:] != end[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    columns = (owner["doc"][first], owner["row"][first], at[first], end[last] - at[first], source["doc"][first], source["row"][first], source_at[first])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns],
                                     names=["doc_id", "row", "start", "windows", "source", "source_row", "source_start"])


def _joined(batches: Iterator[pa.RecordBatch]):
    """Paths of each row joined end to end; input rows are (doc_id, row, list of paths)."""
    for batch in batches:
        flat, count = batch.column(2).flatten(), np.diff(np.array(batch.column(2).offsets))
        owner, source = np.empty(len(flat), _KEY), np.empty(len(flat), _KEY)
        owner["doc"], owner["row"] = (np.repeat(batch.column(i).to_numpy(), count) for i in (0, 1))
        start, windows, source["doc"], source["row"], source_start = (np.array(flat.field(i), np.int64) for i in range(5))
        yield from _runs(owner, start, windows, source, source_start)


def _digests(batches: Iterator[pa.RecordBatch], k: int):
    """Digest of the words at (start, windows) of each row's text; rows are (doc_id, row, text, start, windows)."""
    for batch in batches:
        held, out = (None, []), []
        for text, start, windows in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            if text is not held[0]:
                held = (text, text.encode().split())
            out.append(hashlib.blake2b(b" ".join(held[1][start:start + windows + k - 1]), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(out, pa.binary())],
                                         names=["source", "source_row", "source_start", "windows", "digest"])


def _kept(batches: Iterator[pa.RecordBatch], k: int):
    """Result rows; input rows are (doc_id, text, list of verified paths or null)."""
    for batch in batches:
        n_words, removed, sha, texts = [], [], [], []
        for text, paths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int32)
            for p in paths or ():
                span = slice(p["start"], p["start"] + p["windows"] + k - 1)
                if hashlib.blake2b(b" ".join(words[span]), digest_size=16).digest() != p["digest"]:
                    continue  # not proven
                gone[span.start] += 1
                gone[span.stop] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            kept = [w for w, x in zip(words, keep.tolist()) if x] if paths else words
            n_words.append(len(words))
            removed.append(len(words) - len(kept))
            body = b" ".join(kept)
            sha.append(hashlib.sha256(body).hexdigest())
            texts.append(body.decode() if text is not None else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_paths(docs: DataFrame, k: int = 13, m: int = 6, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, row, start, windows, source, source_row, source_start) over docs(doc_id, row, text), in words: each a maximal
    run of windows whose first occurrence is in ``source``, with a smaller id."""
    spark = docs.sparkSession
    shelf, n = shelf or Shelf(spark), width(spark)
    base = docs.filter("doc_id is not null").select("doc_id", "row", "text")
    marks = base.mapInArrow(lambda b: _marks(b, k, m, n), PACK)
    answers = shelf.put(exchange(marks, n, lambda rows: _shared(rows, n), "bucket int, rows binary, marks binary"), "answers")
    none = lambda kind: F.lit(None).cast(kind)
    both = (answers.select("bucket", F.lit(0).alias("kind"), none("long").alias("row"), none("long").alias("doc_id"), none("string").alias("text"), "rows", "marks")
            .unionByName(base.select(F.pmod("row", F.lit(n)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "row", "doc_id", "text",
                                     none("binary").alias("rows"), none("binary").alias("marks"))))
    met = both.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind", "row")
    paths = exchange(met.mapInArrow(lambda b: _edges(b, k, m, n), PACK), n, _paths, PATHS)
    per_row = paths.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows", "source", "source_row", "source_start")).alias("paths"))
    out = shelf.put(per_row.mapInArrow(_joined, PATHS), "paths")
    shelf.drop(answers)
    return out


def substring_dedup(docs: DataFrame, k: int = 13, m: int = 6) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row per row of docs(doc_id, text)."""
    shelf = Shelf(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    paths = repeated_paths(base, k, m, shelf)
    asked = paths.select(F.col("source").alias("doc_id"), F.col("source_row").alias("row"), F.col("source_start").alias("start"), "windows").distinct()
    digests = (base.join(asked, ["doc_id", "row"]).select("doc_id", "row", "text", "start", "windows")
               .mapInArrow(lambda b: _digests(b, k), "source long, source_row long, source_start long, windows long, digest binary")
               .dropDuplicates(["source", "source_row", "source_start", "windows"]))
    digests = shelf.put(digests, "digests")  # settled, so that the join below can split a source that many paths name
    proven = paths.join(digests, ["source", "source_row", "source_start", "windows"])
    cuts = shelf.put(proven.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows", "digest")).alias("paths")), "cuts")
    shelf.drop(paths, digests)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    held = base.join(cuts, ["doc_id", "row"], "left").select("doc_id", "text", "paths")
    return held.mapInArrow(lambda b: _kept(b, k), out)
