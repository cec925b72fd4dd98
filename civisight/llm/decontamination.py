"""Benchmark decontamination: template windows with typed slots.

Numbers, names and units become placeholders, so an item whose values were changed still has the
item's template. Every window of ``window`` canonical tokens of an item is keyed by its longest literal
token (the anchor); documents are joined on anchors, then the next longest, then windows are compared. A document matches an
item when enough of the item's windows occur at one distance and the values found in the
slots correspond one to one within a role (slot consistency), or when enough windows are verbatim but for case.
Types are given by the item alone: a number's or a unit's slot takes the same value or another of its type, a name's slot any word.

Items shorter than a window are one window; windows without a literal token are not looked for. Null and empty
texts match nothing, repeated documents give equal rows once per id, repeated item ids count as one
item, further columns are ignored, empty tables give no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import Shelf, by_id

# Units of measure that may stand in a slot.
UNITS = ["km", "kg", "cm", "mm", "ml", "mg", "kmh", "mph", "miles", "mile", "metres", "meters", "metre", "meter", "feet", "foot",
         "inches", "inch", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "weeks", "months", "years", "litres",
         "liters", "grams", "pounds", "dollars", "euros", "cents", "percent"]
EDGE = ".,;:!?()[]{}\"'*"
BROADCAST_ROWS = 1_000_000
PIECE = 512


def tokens(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def bare(token: Column | str) -> Column:
    return F.btrim(token if isinstance(token, Column) else F.col(token), F.lit(EDGE))


def capitalised(word: Column) -> Column:
    return word.rlike("^\\p{Lu}\\p{Ll}+$")


def value_type(word: Column) -> Column:
    """<num> or <unit>, else null; does not depend on case or neighbours."""
    return F.when(word.rlike("^[-+$€£]?[0-9][0-9.,:/]*%?$"), "<num>").when(F.lower(word).isin(UNITS), "<unit>")


def canonical(token: Column, before: Column) -> Column:
    """Placeholder or lower-cased literal of an item's token; ``before`` is the token before it, empty at the start."""
    word = bare(token)
    inside = (before != "") & ~before.rlike("[.!?:][\"')]*$")
    return F.coalesce(value_type(word), F.when(capitalised(word) & inside, "<name>"), F.lower(word))


def _template(raw: Column) -> Column:
    """Canonical tokens of ``raw``, whose first entry is only the token before."""
    return F.transform(F.sequence(F.lit(1), F.size(raw) - 1), lambda i: canonical(F.get(raw, i), F.get(raw, i - 1)))


def fits_slot(want: Column, own: Column, word: Column) -> Column:
    """Whether a document's ``word`` can stand where an item has the template token ``want`` with the value ``own``.

    Types are those of the item: a name's slot takes any word, so that the document's case and sentences do not matter.
    """
    return (~want.startswith("<") | (F.lower(own) == F.lower(word)) | F.coalesce(value_type(word) == want, F.lit(False))
            | (want == "<name>") & word.rlike("\\p{L}"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, place, offset, anchor, second_offset, second, template, raw, windows) of every window of the items."""
    base = (items.select(F.col("item_id").cast("long").alias("item_id"), tokens().alias("t")).dropDuplicates(["item_id"])
            .filter(F.size("t") > 0)
            .withColumn("size", F.least(F.lit(window), F.size("t"))).withColumn("windows", F.size("t") - F.col("size") + 1)
            .withColumn("t", F.concat(F.array(F.lit("")), "t")).withColumn("typed", _template(F.col("t"))))
    # a name is a name at the start of a sentence too, if the item also has it within one
    words = F.transform("t", lambda x: bare(x))
    base = base.withColumn("names", F.filter(F.transform("typed", lambda x, i: F.when(x == "<name>", F.get(words, i + 1))), lambda x: x.isNotNull()))
    base = base.withColumn("typed", F.transform("typed", lambda x, i: F.when(F.array_contains("names", F.get(words, i + 1)), "<name>").otherwise(x)))
    rows = (base.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
            .withColumn("raw", F.slice("t", F.col("place") + 2, F.col("size"))).withColumn("template", F.slice("typed", F.col("place") + 1, F.col("size"))))
    # the two longest literals, ties by the first
    literal = F.filter(F.transform("template", lambda x, i: F.struct(F.when(x.startswith("<"), 0).otherwise(F.length(x)).alias("n"), (-i).alias("i"), x.alias("x"))),
                       lambda s: s["n"] > 0)
    ranked = F.sort_array(literal, asc=False)
    return (rows.withColumn("best", F.get(ranked, F.lit(0))).withColumn("next", F.get(ranked, F.lit(1))).filter("best is not null")
            .select("item_id", "place", (-F.col("best.i")).alias("offset"), F.col("best.x").alias("anchor"), (-F.col("next.i")).alias("second_offset"),
                    F.col("next.x").alias("second"), "template", "raw", "windows"))


def template_matches(docs: DataFrame, items: DataFrame, window: int = 8, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots, changed), one row per document id and matched item.

    ``changed`` tells whether some slot holds another value than in the item.
    """
    shelf = Shelf(docs.sparkSession)
    wanted = shelf.put(item_windows(items, window), "windows")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # long texts are cut into overlapping pieces, so that a row holds no more than a piece
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens().alias("t"))
    pieces = docs.select("doc_id", "t", F.explode(F.expr(f"sequence(0, (size(t) - 1) div {PIECE})")).alias("piece")).select(
        "doc_id", (F.col("piece") * PIECE).alias("base"), F.expr(f"greatest(piece * {PIECE} - {window}, 0)").alias("low"),
        F.expr(f"slice(t, greatest(piece * {PIECE} - {window}, 0) + 1, {PIECE + 2 * window})").alias("part"))
    at = (pieces.select("doc_id", "base", "low", "part", F.posexplode("part").alias("i", "token"))
          .filter((F.col("low") + F.col("i") >= F.col("base")) & (F.col("low") + F.col("i") < F.col("base") + PIECE))
          .withColumn("anchor", F.lower(bare("token"))))
    # the join's condition is plain comparisons, so that it runs inside the scan's generated code and only
    # places with all literals of a window leave it; the typed slots are compared on those
    own = F.col("i") - F.col("offset")
    literals = F.lit(True)
    for k in range(window):
        want = F.get("template", F.lit(k))
        literals &= (F.size("template") <= k) | want.startswith("<") | (F.lower(bare(F.get("part", own + k))) == want)
    fits = (own >= 0) & (own + F.size("template") <= F.size("part"))
    next_one = F.col("second").isNull() | (F.lower(bare(F.get("part", own + F.col("second_offset")))) == F.col("second"))
    seen = (at.join(wanted, "anchor").filter(fits & next_one & literals)
            .withColumn("mine", F.slice("part", F.greatest(own, F.lit(0)) + 1, F.size("template")))
            .withColumn("begin", F.col("low") + own))
    value = lambda name, i: bare(F.get(name, i))
    seen = (seen.withColumn("ok", F.forall(F.transform("template", lambda x, i: fits_slot(x, value("raw", i), value("mine", i))), lambda x: x))
            .withColumn("same", F.forall(F.transform("raw", lambda x, i: F.lower(bare(x)) == F.lower(value("mine", i))), lambda x: x)))
    # the slots of a window, as (role, value in the item, value in the document)
    slots = F.filter(F.transform("template", lambda x, i: F.struct(
        x.alias("role"), F.when(x.startswith("<"), F.lower(value("raw", i))).alias("item"), F.lower(value("mine", i)).alias("doc"))), lambda s: s["item"].isNotNull())
    hits = seen.select("doc_id", "item_id", "windows", (F.col("begin") - F.col("place")).alias("shift"), "place", "ok", "same", slots.alias("slots"))
    # groups are bounded by the windows of one item
    by_shift = (hits.groupBy("doc_id", "item_id", "shift").agg(
        F.first("windows").alias("n_windows"), F.count_distinct(F.when(F.col("ok"), F.col("place"))).alias("n_matched"),
        F.count_distinct(F.when(F.col("same"), F.col("place"))).alias("n_same"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ok"), F.col("slots"))))).alias("slots"))
        .withColumn("items", F.size(F.array_distinct(F.transform("slots", lambda s: s.dropFields("doc")))))
        .withColumn("docs", F.size(F.array_distinct(F.transform("slots", lambda s: s.dropFields("item")))))
        # values correspond one to one within a role; enough verbatim windows need no other evidence
        .filter((F.col("n_same") >= coverage * F.col("n_windows"))
                | (F.col("n_matched") >= coverage * F.col("n_windows")) & (F.col("items") == F.size("slots")) & (F.col("docs") == F.size("slots"))))
    best = F.max(F.struct("n_matched", F.size("slots").alias("n_slots"), F.exists("slots", lambda s: s["item"] != s["doc"]).alias("changed"))).alias("best")
    return by_shift.groupBy("doc_id", "item_id").agg(F.first("n_windows").cast("long").alias("n_windows"), best).select(
        "doc_id", "item_id", "n_windows", F.col("best.n_matched").alias("n_matched"), F.col("best.n_slots").cast("long").alias("n_slots"), "best.changed")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of docs that match no item; rows without an id stay; all columns are kept."""
    return by_id(docs, template_matches(docs, items, **options).filter("doc_id is not null"), "left_anti")
