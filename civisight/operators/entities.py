"""People in documents: alias generation, ambiguity, mention counting, directory."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civisight.functions.text import ColumnOrName, array_unique_folded, clean_text, fold, match_text, match_tokens
from civisight.operators.lookups import key_bits, may_hold
from civisight.session import settle

# Particles and suffixes of Portuguese names.
PARTICLES = ("a", "as", "da", "das", "de", "del", "della", "di", "do", "dos", "du", "e")
SUFFIXES = ("filho", "neto", "junior")


@dataclass(frozen=True)
class AliasRules:
    """Which kinds get which aliases, and what a single-word alias must satisfy."""
    pair_kinds: Sequence[str] = ()          # pairs of name words, and one or two single words
    first_name_kinds: Sequence[str] = ()    # pairs, and the first word
    strict_kinds: Sequence[str] = ()        # never a single word, never a leading particle
    banned: Sequence[str] = ()              # single words that mean something else
    min_single: int = 5
    min_single_by_kind: dict[str, int] = field(default_factory=dict)


def person_tokens(c: ColumnOrName) -> Column:
    """Words of a name without particles, spelling kept."""
    words = F.split(F.coalesce(clean_text(c), F.lit("")), r"(?U)[^\w]+")
    return F.filter(words, lambda t: (t != "") & ~fold(t).isin(list(PARTICLES)))


def _at(a: Column, i: Column | int) -> Column:
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def _pairs(tokens: Column) -> Column:
    """Adjacent, first, last and suffix pairs of name words."""
    last = F.size(tokens) - 1
    positions = F.when(last >= 1, F.sequence(F.lit(0), last - 1))

    def from_left(i: Column) -> Column:
        def joined(j: Column) -> Column:
            left, right = _at(tokens, i), _at(tokens, j)
            wanted = (j == i + 1) | (i == 0) | (j == last) | fold(right).isin(list(SUFFIXES))
            long = (F.length(left) >= 3) & (F.length(right) >= 3)
            ends = (i == 0) & (j == last)
            suffix_end = (j == last) & (i == last - 1) & fold(right).isin(list(SUFFIXES))
            return F.when((wanted & long) | ends | suffix_end, F.concat_ws(" ", left, right))
        return F.transform(F.sequence(i + 1, last), joined)

    return F.filter(F.coalesce(F.flatten(F.transform(positions, from_left)), F.array().cast("array<string>")), lambda x: x.isNotNull())


def _suffix_pair(tokens: Column) -> Column:
    n = F.size(tokens)
    ok = (n >= 2) & fold(_at(tokens, n - 1)).isin(list(SUFFIXES))
    return F.when(ok, F.array(F.concat_ws(" ", _at(tokens, n - 2), _at(tokens, n - 1)))).otherwise(F.array().cast("array<string>"))


def candidate_aliases(entities: DataFrame, rules: AliasRules) -> DataFrame:
    """(entity_id, kind, alias, alias_key): source aliases, both names, derived word pairs."""
    none = F.array().cast("array<string>")
    work = entities.withColumns({
        "_display": F.coalesce(clean_text("name"), clean_text("official_name"), F.lit("")),
        "_official": F.coalesce(clean_text("official_name"), clean_text("name"), F.lit("")),
    }).withColumns({"_dt": person_tokens("_display"), "_ot": person_tokens("_official")})
    d, o = F.col("_dt"), F.col("_ot")
    pairs = F.concat(_pairs(o), F.when(d != o, _pairs(d)).otherwise(none))
    base = F.when(F.size(d) > 0, d).otherwise(o)
    singles = F.when(F.size(base) == 2, base).otherwise(F.slice(base, 1, 1))
    derived = (
        F.when(F.col("kind").isin(list(rules.first_name_kinds)), F.concat(pairs, F.slice(base, 1, 1)))
        .when(F.col("kind").isin(list(rules.pair_kinds)), F.concat(pairs, singles))
        .otherwise(F.concat(_suffix_pair(d), _suffix_pair(o))))
    every = F.concat(F.coalesce("aliases_source", none), F.array("_display", "_official"), derived)
    rows = work.select(
        F.col("id").alias("entity_id"), "kind", match_text("_display").alias("_dk"), match_text("_official").alias("_ok"),
        F.explode(array_unique_folded(every)).alias("alias"))
    return rows.withColumn("alias_key", match_text("alias")).filter(F.length("alias_key") >= 3)


def alias_owner_counts(candidates: DataFrame) -> DataFrame:
    """In how many entities an alias occurs."""
    return candidates.groupBy("alias_key").agg(F.count_distinct("entity_id").alias("owners"))


def token_owner_counts(candidates: DataFrame) -> DataFrame:
    """In how many entities a name word occurs."""
    words = candidates.select("entity_id", F.explode(F.transform(person_tokens("alias"), lambda t: match_text(t))).alias("token"))
    return words.filter("token <> ''").groupBy("token").agg(F.count_distinct("entity_id").alias("token_owners"))


def alias_table(entities: DataFrame, rules: AliasRules) -> DataFrame:
    """Aliases that identify one entity, ranked longest first: (entity_id, alias, alias_key,
    alias_rank, n_tokens)."""
    cand = candidate_aliases(entities, rules)
    words = F.split("alias_key", " ")
    single = F.size(words) == 1
    cand = cand.join(alias_owner_counts(cand), "alias_key", "left")
    cand = cand.join(token_owner_counts(cand.select("entity_id", "alias")), F.col("alias_key") == F.col("token"), "left")
    floor = F.lit(rules.min_single)
    for kind, n in rules.min_single_by_kind.items():
        floor = F.when(F.col("kind") == kind, F.lit(n)).otherwise(floor)
    strict = F.col("kind").isin(list(rules.strict_kinds))
    good_single = (F.length("alias_key") >= floor) & (F.col("token_owners") == 1) & ~F.col("alias_key").isin(list(rules.banned)) & ~strict
    own_name = F.col("alias_key").isin(F.col("_dk"), F.col("_ok"))
    good_phrase = ((F.col("owners") <= 1) | own_name) & ~(strict & _at(words, 0).isin(list(PARTICLES)))
    kept = cand.filter(F.coalesce(F.when(single, good_single).otherwise(good_phrase), F.lit(False)))
    order = Window.partitionBy("entity_id").orderBy(
        F.size(person_tokens("alias")).desc(), F.length("alias").desc(), fold("alias"), F.col("alias"))
    return kept.select(
        "entity_id", "alias", "alias_key", F.row_number().over(order).alias("alias_rank"), F.size(words).alias("n_tokens"))


def token_frequencies(docs: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """(token, docs): in how many documents each word of an alias occurs."""
    wanted = aliases.select(F.explode(F.split("alias_key", " ")).alias("token")).distinct()
    seen = docs.select(F.explode(F.array_distinct(match_tokens(text))).alias("token")).filter(may_hold(key_bits(wanted, "token"), "token"))
    return seen.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("docs"))


def alias_anchors(aliases: DataFrame, frequencies: DataFrame) -> DataFrame:
    """aliases with their rarest word as ``token`` and its place as ``token_at``; an alias with a word
    that no document has cannot occur and is left out."""
    words = aliases.select("*", F.posexplode(F.split("alias_key", " ")).alias("token_at", "token"))
    rare = F.min(F.struct("docs", (-F.length("token")).alias("_long"), "token_at", "token")).alias("_a")
    keys = ["entity_id", "alias", "alias_key", "alias_rank", "n_tokens"]
    found = words.join(frequencies, "token").groupBy(*keys).agg(rare, F.count("*").alias("_n")).filter("_n = n_tokens")
    return found.select(*keys, "_a.token", "_a.token_at")


def alias_hits(docs: DataFrame, aliases: DataFrame, doc: str = "doc_id", text: str = "text", frequencies: DataFrame | None = None) -> DataFrame:
    """(doc, entity_id, alias, alias_rank, start, end) of every alias occurrence.

    After folding, an alias at token boundaries is a token n-gram. Each alias is looked up by its anchor, the
    word that the fewest documents have (``frequencies``, of ``token_frequencies``; counted when not given). Words
    are tested against the anchors' bits where they are read, then joined with the anchors; only around the few places
    left the whole alias is compared. Aliases and anchors are settled once, so that neither is worked out for every use.
    """
    aliases = settle(aliases)
    anchors = settle(alias_anchors(aliases, token_frequencies(docs, aliases, text) if frequencies is None else frequencies))
    reach = aliases.agg(F.coalesce(F.max("n_tokens"), F.lit(1))).scalar()
    places = docs.select(doc, match_tokens(text).alias("_t")).select(doc, "_t", F.posexplode("_t").alias("at", "token")).filter(may_hold(key_bits(anchors, "token"), "token"))
    before = F.least(F.col("at"), reach - 1)
    around = F.slice("_t", F.col("at") - before + 1, 2 * reach - 1)
    places = places.select(doc, "at", "token", before.alias("before"), around.alias("around"))
    hits = places.join(anchors, "token").filter("before >= token_at and array_join(slice(around, before - token_at + 1, n_tokens), ' ') = alias_key")
    start = F.col("at") - F.col("token_at")
    return hits.select("alias_key", doc, start.alias("start"), (start + F.col("n_tokens")).alias("end"), "entity_id", "alias", "alias_rank")


def accepted_mentions(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Occurrences left after overlaps are resolved in favour of the better-ranked alias.

    Overlaps can only happen inside a run of touching spans, so each run is resolved on its
    own: what is collected is one run, not all hits of a document.
    """
    spans = Window.partitionBy(doc, "entity_id").orderBy("start", "end", "alias_rank")
    reach = F.max("end").over(spans.rowsBetween(Window.unboundedPreceding, -1))
    work = hits.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    work = work.withColumn("_run", F.sum("_new").over(spans.rowsBetween(Window.unboundedPreceding, 0)))
    run = work.groupBy(doc, "entity_id", "_run").agg(F.array_sort(F.collect_list(F.struct("alias_rank", "start", "end", "alias"))).alias("_s"))
    empty = F.slice(F.col("_s"), 1, 0)

    def take(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda a: (x["start"] < a["end"]) & (a["start"] < x["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    return run.select(doc, "entity_id", F.explode(F.aggregate("_s", empty, take)).alias("m")).select(doc, "entity_id", "m.alias", "m.start", "m.end")


def mention_counts(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mentions per document and entity, with the aliases seen."""
    return mentions.groupBy(doc, "entity_id").agg(
        F.count("*").alias("occurrences"), F.sort_array(F.collect_set("alias")).alias("matched_aliases"))


def alias_statistics(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    return mentions.groupBy("entity_id", "alias").agg(F.count("*").alias("occurrences"), F.count_distinct(doc).alias("docs"))


def entity_directory(mentions: DataFrame, entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per mentioned entity: occurrences, documents, and the best display name (an observed
    alias of two words or more: most documents, then occurrences, then words, then name)."""
    from civisight.operators.windows import top_per_group

    # an accepted mention belongs to one alias, but a document may hold several aliases
    totals = mentions.groupBy("entity_id").agg(F.count("*").alias("occurrences"), F.count_distinct(doc).alias("docs"))
    words = F.size(person_tokens("alias"))
    stats = alias_statistics(mentions, doc).filter(words >= 2)
    best = top_per_group(stats, ["entity_id"], [F.col("docs").desc(), F.col("occurrences").desc(), words.desc(), F.col("alias")], 1)
    named = entities.select(F.col("id").alias("entity_id"), "kind", F.coalesce(clean_text("name"), clean_text("official_name"), F.lit("")).alias("_n"))
    return totals.join(best.select("entity_id", "alias"), "entity_id", "left").join(named, "entity_id").select(
        "entity_id", "kind", F.coalesce("alias", "_n").alias("display_name"), "occurrences", "docs")
