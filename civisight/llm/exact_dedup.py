"""Exact dedup: distributed MSD radix partitioning of normalised texts.

A text is read as its length followed by its bytes. Texts are split by successive digits of
that string - the length and the first bytes, then longer and longer pieces - until a group is
a single text or its bytes have ended. Members of an ended group agreed on every digit, so they
are equal without any digest. Only groups of two and more go on to the next digit.

Nulls count as empty texts, empty texts equal each other, rows with a null id take part (a null
is the smallest id), repeated rows are copies, further columns are ignored, no rows give no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import Shelf, by_id
from civisight.llm.words import LOWER, slices

FIRST = 32
GROWTH = 64


def _normalised(batches: Iterator[pa.RecordBatch], with_text: bool):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            low = LOWER[data].tobytes()
            texts = [low[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [rows.column(0), pa.array([len(t) for t in texts], pa.int64()),
                       pa.array([t[:FIRST] for t in texts], pa.binary()),
                       pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "length", "digit", "text_sha256"]
            if with_text:
                columns.append(pa.array([t[FIRST:] for t in texts], pa.binary()))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs(doc_id, text).

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays
    (of rows that repeat that id, one).
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, length long, digit binary, text_sha256 string"
    heads = shelf.put(docs.mapInArrow(lambda b: _normalised(b, False), schema), "heads")
    shared = shelf.put(heads.groupBy("length", "digit").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    alone = heads.join(shared, ["length", "digit"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    done = [alone]

    # a group is named after the number of one of its rows; numbers are fixed by writing them
    rows = docs.mapInArrow(lambda b: _normalised(b, True), schema + ", rest binary").join(
        shared.select("length", "digit"), ["length", "digit"], "left_semi")
    rows = shelf.put(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
    names = shelf.put(rows.groupBy("length", "digit").agg(F.max("number").alias("group")), "names")
    active, read, step = rows.join(names, ["length", "digit"]).drop("digit"), FIRST, FIRST * GROWTH
    while True:
        active = shelf.put(active, "active")
        ended = active.filter(F.col("length") <= read)
        best = shelf.put(ended.groupBy("group").agg(
            F.max(F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "number")).alias("best"), F.count("*").alias("group_size"),
            F.max("doc_id").alias("keep_id")), "best")
        done.append(ended.join(best, "group").select(
            "doc_id", "keep_id", "group_size", (F.col("number") == F.col("best.number")).alias("kept"), "text_sha256"))
        going = active.filter(F.col("length") > read)
        if going.isEmpty():
            break
        going = going.select("doc_id", "length", "text_sha256", "number", "group",
                             F.expr(f"substring(rest, 1, {step})").alias("digit"), F.expr(f"substring(rest, {step + 1})").alias("rest"))
        groups = shelf.put(going.groupBy("group", "digit").agg(F.count("*").alias("n"), F.max("number").alias("next")), "groups")
        split = going.join(groups, ["group", "digit"])
        done.append(split.filter("n = 1").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))
        active = split.filter("n > 1").select("doc_id", "length", "text_sha256", "number", F.col("next").alias("group"), "rest")
        read, step = read + step, min(step * GROWTH, 1 << 24)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Rows of docs whose text is the one that stays of its group, by id; all columns are kept."""
    return by_id(docs, exact_groups(docs).filter("kept"), "left_semi")
