"""Quality rules with cross-document line frequency, in DataFrame functions only.

1. Every text is read once, for its counts and its lines: a line's name is the 64-bit hash of its normal form
   (A-Z lower-cased, digits as 0, runs of blanks as one). Lines without a word have no name.
2. Frequency: the distinct texts of a host that hold a line. Exact copies count once, so that copies alone
   make no line frequent; a document's lines are made distinct before they are counted, and Spark counts within tasks
   before it shuffles.
3. A line above the limits (in more than ``floor`` texts of the host, and in more than ``share`` per cent of them) is
   removed. A document that loses more than ``lost`` per cent of its words to that, or has fewer than ``min_words``
   left, is depleted and rejected, as is one that fails the base rules on length and repetition.

The verdict depends on host and text alone, so it is reached once per distinct text of a host; texts are told apart by
their MD5 digest. Null and empty texts have no words and fail the base rules; documents without a host form
one of their own; repeated rows and rows with a null id get the verdict of their text; further columns are
ignored; no rows give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import Shelf

_BLANK = r"[ \\t\\x0B\\f\\r]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
SYMBOLS = "#*$%&|<>"

# Places of the 3-word windows that occur again: windows sorted by hash, next to an equal one.
_AGAIN = """filter(transform(_s, (s, i) -> if(s.g = get(_s, i - 1).g or s.g = get(_s, i + 1).g, s.i, null)), x -> x is not null)"""


def document_facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, key, counts, lines) of docs(doc_id, text, host): key is a digest of the text, lines its
    named lines (h, w) with their number of words, in order, null for lines without a word."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    t = (t.withColumn("_w", F.expr(r"filter(split(_t, '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')"))
         .withColumn("_raw", F.expr(r"filter(split(_t, '\\n'), l -> l rlike '[^ \\t\\x0B\\f\\r]')"))
         .withColumn("_norm", F.expr(rf"transform(split(regexp_replace(translate(_t, '{_UPPER}', '{_LOWER}'), '{_BLANK}', ' '), '\\n'), l -> trim(l))")))
    t = t.withColumn("_n", F.size("_w")).withColumn("_g", F.expr(
        "if(_n < 3, array(), transform(slice(_w, 1, _n - 2), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))))"))
    t = t.withColumn("_s", F.expr(
        "if(size(array_distinct(_g)) = size(_g), null, sort_array(transform(_g, (g, i) -> struct(g, i))))"))
    repeats = f"coalesce(size(array_distinct(flatten(transform({_AGAIN}, p -> array(p, p + 1, p + 2))))), 0)"
    return t.select(
        "doc_id", "host", F.unhex(F.md5("_t")).alias("key"),
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(if(_s is null, 0, {repeats}) as long)").alias("n_repeat_words"),
        F.expr("""transform(_norm, l -> if(l = '', null, struct(xxhash64(l) as h,
                  length(l) - length(replace(l, ' ', '')) + 1 as w)))""").alias("lines"))


def frequent_lines(texts: DataFrame, floor: int = 10, share: int = 5) -> DataFrame:
    """(host, h) of the lines above both limits in texts(host, lines), one row per distinct text of a host."""
    held = texts.select("host", F.explode(F.expr("array_distinct(filter(lines, l -> l is not null).h)")).alias("h"))
    counts = held.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > floor)
    hosts = texts.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("all"))
    return (counts.join(hosts, counts["host"].eqNullSafe(hosts["_host"])).filter(100 * F.col("n") > share * F.col("all"))
            .select("host", "h"))


def quality_rules(docs: DataFrame, host: str = "source", floor: int = 10, share: int = 5, min_words: int = 50,
                  repeated: int = 50, lost: int = 50, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, n_words_removed,
    kept), one row per row of docs(doc_id, text, host); with ``texts`` also kept_text, the text without removed lines."""
    shelf = Shelf(docs.sparkSession)
    facts = shelf.put(document_facts(docs, host), "facts")
    distinct = shelf.put(facts.select("host", "key", "lines").dropDuplicates(["host", "key"]), "texts")
    high = shelf.put(frequent_lines(distinct, floor, share).select(F.col("host").alias("_host"), F.col("h").alias("_h")), "high")
    lines = distinct.select("host", "key", F.posexplode("lines").alias("at", "l")).select("host", "key", "at", "l.h", "l.w")
    hit = lines.join(high, lines["host"].eqNullSafe(high["_host"]) & (lines["h"] == high["_h"]))
    gone = shelf.put(hit.groupBy(F.col("host").alias("_host"), F.col("key").alias("_key")).agg(
        F.sum("w").cast("long").alias("n_words_removed"), F.array_sort(F.collect_list("at")).alias("removed")), "gone")
    found = facts.drop("lines").join(gone, facts["host"].eqNullSafe(gone["_host"]) & (facts["key"] == gone["_key"]), "left")
    words_removed = F.coalesce("n_words_removed", F.lit(0)).cast("long")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words"))
    left = F.col("n_words") - words_removed
    out = found.select(
        "doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_lines_removed"), words_removed.alias("n_words_removed"),
        (~base_failed & (left >= min_words) & (100 * words_removed <= lost * F.col("n_words"))).alias("kept"), "removed")
    if texts:
        mine = docs.select(F.col(host).cast("string").alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        mine = mine.withColumn("_key", F.unhex(F.md5("text"))).dropDuplicates(["_host", "_key"])
        body = out.select("*").join(mine, out["host"].eqNullSafe(mine["_host"]) & (out["key"] == mine["_key"])).withColumn("_l", F.split("text", "\n"))
        # what stays are the stretches between the removed lines
        cut = F.expr("""array_join(flatten(transform(sequence(0, size(removed)), i ->
            slice(_l, coalesce(get(removed, i - 1), -1) + 2, coalesce(get(removed, i), size(_l)) - coalesce(get(removed, i - 1), -1) - 1))), '\\n')""")
        out = body.withColumn("kept_text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut)).drop("_host", "_key", "_l", "text")
    return out.drop("host", "key", "removed")
