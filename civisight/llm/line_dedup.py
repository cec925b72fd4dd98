"""Line dedup: repeated runs of lines, found by prefix doubling over sequences of line ids.

Each non-blank line gets the name of its first occurrence. Blocks of 2^(k+1) lines are named after pairs
of blocks of 2^k; only blocks that occur more than once go on to the next doubling, so a table of names is
a suffix array's ranks for the suffixes that still share a prefix. Blocks of ``min_lines`` lines that
also start earlier (by id, then by line) are later copies; their runs are deleted, blank lines stay.
``longest_run`` is the length of the longest block (a power of two) that is repeated from the document.

A null text has no lines; rows with a null id are left whole; rows that repeat an id are told apart by
their text, rows that repeat both are left whole after the first occurrence's rule as one document;
further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civisight.llm.common import Shelf

_TRIM = "trim(BOTH ' \\t\\r\\u000b\\f' FROM line)"


def _names(shelf: Shelf, blocks: DataFrame, by: list[str]) -> DataFrame:
    """(doc_id, at, name) of blocks that occur more than once; the name is the first occurrence."""
    groups = shelf.put(blocks.groupBy(*by).agg(F.min(F.struct("doc_id", "at")).alias("name"), F.count("*").alias("n"))
                       .filter("n > 1").drop("n"), "groups")
    return shelf.put(blocks.join(groups, by).select("doc_id", "at", "name"), "names")


def _pairs(names: DataFrame, step: int) -> DataFrame:
    """Blocks as pairs of named blocks, ``step`` lines apart."""
    right = names.select("doc_id", (F.col("at") - step).alias("at"), F.col("name").alias("second"))
    return names.withColumnRenamed("name", "first").join(right, ["doc_id", "at"])


def repeated_runs(docs: DataFrame, min_lines: int = 2, shelf: Shelf | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, longest): runs(doc_id, first_line, last_line) are later copies, in line numbers from 0;
    longest(doc_id, longest_run)."""
    shelf = shelf or Shelf(docs.sparkSession)
    lines = (docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
             .withColumn("line", F.expr(_TRIM)).filter("line <> ''")
             .select("doc_id", "number", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.reverse("line")).alias("b")))
    # the place of a line among the non-blank lines of its document
    lines = shelf.put(lines.dropDuplicates(["doc_id", "number"]).withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("number")).cast("long")), "lines")
    names, size, longest, wanted = _names(shelf, lines.select("doc_id", "at", "a", "b"), ["a", "b"]), 1, None, None
    while True:
        own = names.filter("name.doc_id <> doc_id or name.at <> at").groupBy("doc_id").agg(F.lit(size).cast("long").alias("size"))
        longest = own if longest is None else longest.unionByName(own)
        if size <= min_lines < 2 * size:
            wanted = names if size == min_lines else _names(shelf, _pairs(names, min_lines - size), ["first", "second"])
        if size >= min_lines and names.isEmpty():
            break
        names, size = _names(shelf, _pairs(names, size), ["first", "second"]), 2 * size
    copies = wanted.filter("name.doc_id <> doc_id or name.at <> at").select("doc_id", "at")
    # overlapping and touching copies are one run
    order = W.partitionBy("doc_id").orderBy("at")
    runs = (copies.withColumn("new", F.when(F.col("at") <= F.lag("at").over(order) + min_lines, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "run").agg(F.min("at").alias("low"), (F.max("at") + min_lines - 1).alias("high")))
    place = lines.select("doc_id", "at", "number")
    runs = (runs.join(place.select("doc_id", F.col("at").alias("low"), F.col("number").alias("first_line")), ["doc_id", "low"])
            .join(place.select("doc_id", F.col("at").alias("high"), F.col("number").alias("last_line")), ["doc_id", "high"]))
    return shelf.put(runs.select("doc_id", "first_line", "last_line"), "runs"), longest.groupBy("doc_id").agg(F.max("size").alias("longest_run"))


def line_dedup(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_removed, longest_run, kept_text), one row per row of docs(doc_id, text)."""
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs, longest = repeated_runs(docs, min_lines, shelf)
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first_line", "last_line")).alias("runs"))
    # blank lines inside a run stay, so a line goes if it lies in a run and is not blank
    cut = (docs.join(shelf.put(per_doc.join(longest, "doc_id", "full"), "cuts"), "doc_id", "left")
           .withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
           .withColumn("kept", F.expr(f"""case when runs is null then lines else filter(lines, (line, i) ->
               {_TRIM} = '' or not exists(runs, r -> i between r.first_line and r.last_line)) end""")))
    return cut.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.coalesce("longest_run", F.lit(0).cast("long")).alias("longest_run"),
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"))
