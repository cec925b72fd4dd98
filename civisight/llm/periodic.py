"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words long, that no
neighbouring word extends. On the diagonal of lag q (word i against word i + q) such a run is a stretch of at least
max(least - q, (times - 1) * q) equal pairs, its guaranteed overlap.

1. Index: lags are taken in classes [2^j, 2^(j+1)). Every run of a class holds two occurrences of a gram of
   (times - 1) * 2^j words, the least overlap guaranteed in it, at a distance of exactly its period. Such a gram is
   at least as long as any lag of its class, so between these two it cannot occur again (a nearer occurrence
   would give the run a smaller period): next neighbours among the occurrences of a gram are all the pairs needed,
   and their number is linear. A gram of the next class is two grams of this one, so only places whose gram
   occurs again in their text go on.
2. Extend: seeds are taken by lag and place and grown on their diagonal to both sides, word by word. A table of
   the furthest place covered on each lag skips the seeds that a former extension has covered.

Each text is worked on whole and alone, so nothing is shuffled. Words are 64-bit hashes; equality of hashes stands
for equality. Null and empty texts have no runs; repeated rows and rows with a null id are treated like any
other, each on its own; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.llm.words import Words, mix, slices

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
RUN = "struct<start:long,length:long,period:long>"


def _again(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[place] == values


def seeds(word: np.ndarray, row: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the next neighbours among the occurrences of each class's grams."""
    n, found, lags = len(word), [], []
    # lag 1: words that equal the next one
    k = max(least - 1, times - 1)
    if n > k:
        equal = np.append(0, np.cumsum((word[1:] == word[:-1]) & (row[1:] == row[:-1])))
        found.append(np.flatnonzero(equal[k:] - equal[:-k] == k))
        lags.append(np.ones(len(found[0]), np.int64))
    lag, k = 2, 2 * (times - 1)
    if n < k:
        return (np.concatenate(found), np.concatenate(lags)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    gram = mix(row[:n - k + 1].astype(np.uint64) + _U(1))  # texts of a slice do not meet
    for i in range(k):
        gram = mix(gram * _BASE + word[i:i + len(gram)])
    place = np.flatnonzero(row[:n - k + 1] == row[k - 1:])
    while len(place):
        place = place[_again(gram[place])]
        order = np.argsort(gram[place], kind="stable")
        at = place[order]
        gap = at[1:] - at[:-1]
        hit = (gram[at[1:]] == gram[at[:-1]]) & (gap >= lag) & (gap < 2 * lag)
        found.append(at[:-1][hit])
        lags.append(gap[hit])
        # a gram twice as long occurs again only where both of its halves do
        alive = np.zeros(n + 1, bool)
        alive[place] = True
        place = place[place + 2 * k <= n]
        place = place[alive[place + k] & (row[place] == row[place + 2 * k - 1])]
        gram[place] = mix(gram[place] * _BASE + gram[place + k])
        lag, k = 2 * lag, 2 * k
    return np.concatenate(found), np.concatenate(lags)


def _reach(left: np.ndarray, right: np.ndarray) -> int:
    """Number of equal pairs at the beginning of two stretches."""
    done, step = 0, 64
    while done < len(left):
        differ = np.flatnonzero(left[done:done + step] != right[done:done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return len(left)


def find_runs(word: np.ndarray, row: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int, int]]:
    """(row, start, length, period) of the runs, ordered; ``first`` holds each row's first word and the end."""
    place, lag = seeds(word, row, least, times)
    order = np.lexsort((place, lag, row[place]))
    place, lag = place[order], lag[order]
    # neighbouring seeds of a lag lie on one diagonal: the first of them is grown
    lone = np.append(True, (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1))[:len(place)]
    out, covered, now = [], {}, -1
    for i, q in zip(place[lone].tolist(), lag[lone].tolist()):
        if row[i] != now:
            covered, now = {}, int(row[i])
        if i < covered.get(q, -1):
            continue
        low, high = int(first[now]), int(first[now + 1])
        end = i + _reach(word[i:high - q], word[i + q:high])
        begin = i - _reach(word[low:i][::-1], word[low + q:i + q][::-1])
        covered[q] = end
        if end + q - begin >= max(least, times * q):
            out.append((now, begin - low, end + q - begin, q))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _join(data: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place after each word) of words joined by one space; ``last`` words are followed by none."""
    size = end - start + ~last
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - stop + size, size)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[(stop - 1)[~last]] = 32
    return out, stop


def _collapsed(batches: Iterator[pa.RecordBatch], least: int, times: int):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            words = Words(data, offsets)
            runs = find_runs(words.hash, words.row, words.first, least, times)
            keep = np.ones(len(words.start), bool)
            for r, s, length, q in runs:
                keep[words.first[r] + s + q:words.first[r] + s + length] = False
            row = words.row[keep]
            last = np.append(row[1:] != row[:-1], True)[:len(row)]
            text, stop = _join(data, words.start[keep], words.end[keep], last)
            count = np.searchsorted(row, np.arange(rows.num_rows + 1))
            cut = np.append(0, stop)[count]
            runs = np.array(runs, np.int64).reshape(-1, 4)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(runs[:, 0], np.arange(rows.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]))
            body = pa.LargeStringArray.from_buffers(rows.num_rows, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, body.cast(pa.string())], names=["doc_id", "runs", "collapsed_text"])


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed_text), one row per row of docs(doc_id, text).

    runs are ordered by start, then period, in words from 0; collapsed_text holds the words that no run contains
    after its first period, joined by one space. ``times`` is 3 at least.
    """
    if times < 3:
        raise ValueError("times must be 3 at least: below it, neighbouring occurrences do not find every run")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(lambda b: _collapsed(b, least, times), f"doc_id long, runs array<{RUN}>, collapsed_text string")


def tile_words(docs: DataFrame) -> DataFrame:
    """docs with the words of every tenth text, by a checksum of its id, from some word on repeated with a period.

    With h the CRC-32 of the decimal id and g = h div 10: where h is divisible by 10, word i >= a becomes
    word a + (i - a) % p, a = g % n and p = 1 + (n - a) div (3 + g % 8). Rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    some = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w"))
    some = some.withColumn("_a", F.when(F.col("_n") > 0, F.expr("cast((crc32(cast(doc_id as string)) div 10) % _n as int)")))
    some = some.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + (crc32(cast(doc_id as string)) div 10) % 8) as int)"))
    tiled = F.expr("""concat_ws(' ', slice(_w, 1, _a),
        slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast(ceil((_n - _a) / _p) as int))), 1, _n - _a))""")
    return some.withColumn("text", F.when(F.col("_a").isNotNull(), tiled).otherwise(F.col("text"))).drop("_w", "_n", "_a", "_p")


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each row of ``periodic_runs``, and digests of its runs and its collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as l, -r.start as s, -r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.l").alias("length"),
        (-F.col("_b.p")).alias("period"), F.expr("1000 * _b.l div -_b.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
