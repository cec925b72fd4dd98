"""Scored search over registries, filters over archives, and an inverted token index.

A batch of queries meets the records through their n-grams: every hit of a query holds all n-grams of its words, so
the one that the fewest records hold is enough to find candidates. N-grams are counted first, then records are joined
with queries on each query's rarest, and only those pairs are scored.
"""
from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civisight.functions.arrays import owners, share_number
from civisight.functions.text import case_when, compact_key, fold, fold_text, match_tokens
from civisight.operators.lookups import key_bits, may_hold
from civisight.operators.windows import top_per_group
from civisight.session import settle

GRAM, WORDS = 3, 1 << 12
_QUERY = ("struct<id:int,way:string,query:string,norm:string,compact:string,digits:string,"
          "tokens:array<struct<t:string,c:string>>,grams:array<string>>")


def _plain_grams(way: str, words: Sequence[str]) -> list[str]:
    """N-grams of words, each tagged with the way it is looked up; a word shorter than an n-gram is one itself."""
    return sorted({f"{way}:{w[i:i + GRAM]}" for w in words for i in range(max(1, len(w) - GRAM + 1))})


def _queries(spark: SparkSession, queries: Sequence[str], ways: dict[str, object]) -> DataFrame:
    """One row per query and way; ``ways[way](row)`` gives the words whose n-grams a hit holds, or None if the
    query cannot be answered that way."""
    rows = []
    for q in queries:
        norm = fold_text(q)
        row = {"query": q, "norm": norm, "compact": re.sub(r"[^a-z0-9]+", "", norm), "digits": re.sub(r"\D+", "", q),
               "tokens": [{"t": t, "c": re.sub(r"[^a-z0-9]+", "", t)} for t in norm.split(" ") if t]}
        rows += [row | {"way": way, "grams": _plain_grams(way, words)} for way, f in ways.items() if (words := f(row)) is not None]
    table = json.dumps([r | {"id": i} for i, r in enumerate(rows)])
    return spark.range(1).select(F.explode(F.from_json(F.lit(table), f"array<{_QUERY}>")).alias("_q"))


def _grams(records: DataFrame, columns: Sequence[str], text: Column, way: str, sizes: Sequence[int], bits: Column) -> DataFrame:
    """columns and ``_gram``: the tagged n-grams of a text that ``bits`` may hold, each once per record; the empty one is in
    every text. N-grams are cut and tested place by place, so that none of them is kept that nobody asks for."""
    at, size = F.col("_at"), F.length("_s")
    rows = records.withColumn("_s", text).select(*columns, "_s", F.explode(F.sequence(F.lit(0), size)).alias("_at"))
    cut = [F.when((at > 0) & (at + (n - 1) <= size), F.substring("_s", at, F.lit(n))) for n in sizes if n]
    rows = rows.select(*columns, "_s", "_at", F.explode(F.array(F.when(at == 0, ""), *cut)).alias("_g")).filter("_g is not null")
    rows = rows.withColumn("_gram", F.concat(F.lit(f"{way}:"), "_g")).filter(may_hold(bits, "_gram", WORDS))
    return rows.filter((at == 0) | (F.call_function("instr", F.col("_s"), F.col("_g")) == at)).select(*columns, "_gram")


def candidates(records: DataFrame, texts: Sequence[tuple[str, Column, Sequence[int]]], queries: DataFrame) -> DataFrame:
    """records with each query (``_q``) whose rarest n-gram they hold, once per query and text (way, column, sizes of n-grams).

    Records are tested against the n-grams' bits where they are cut, so what is looked up in the table of queries are
    candidates only.
    """
    def held(columns: Sequence[str], keys: DataFrame) -> DataFrame:
        bits = key_bits(keys, "_gram", WORDS)
        parts = [_grams(records, columns, text, way, sizes, bits) for way, text, sizes in texts]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    asked = queries.select("_q", F.explode("_q.grams").alias("_gram"))
    wanted = asked.select("_gram").distinct()
    counts = held([], wanted).join(wanted, "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    # an n-gram that no record holds rules its query out
    rarest = settle(asked.join(counts, "_gram", "left").groupBy("_q.id")
                    .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"), F.first("_q").alias("_q"))
                    .filter("_r.n > 0").select("_q", F.col("_r.gram").alias("_gram")))
    return held(records.columns, rarest).join(rarest, "_gram").drop("_gram")


def _spread(records: DataFrame) -> DataFrame:
    """Records over all tasks: keys and n-grams cost far more than the bytes by which a scan is split."""
    return records.hint("rebalance")


def _sizes(queries: Sequence[str]) -> list[int]:
    """Lengths of the n-grams that the words of queries are looked up by."""
    words = [re.sub(r"[^a-z0-9]+", "", t) for q in queries for t in fold_text(q).split(" ")]
    return sorted({min(GRAM, len(w)) for w in words} | {GRAM})


def _first(*rules: tuple[Column, int]) -> Column:
    """Weight of the first rule that holds, else zero."""
    return case_when([(test, F.lit(weight)) for test, weight in rules], F.lit(0))


def search_registry(
    df: DataFrame, queries: Sequence[str], limit: int, prefix: str = "prefix", operator: str = "operator", document: str = "document",
    owners_text: str = "owners", models: Sequence[str] = ("model", "manufacturer", "icao_type"),
    more: Sequence[str] = (), more_compact: Sequence[str] = (), cancelled: str = "cancel_date",
    tie: str | None = None,
) -> DataFrame:
    """Best records per query by weighted hits over several fields.

    Every token of a query must hit somewhere or the record is out. ``more`` fields only take
    part in the weakest matches.
    """
    share = F.transform(owners(owners_text), lambda o: F.concat_ws(
        " ", F.nullif(o["name"], F.lit("")), F.nullif(o["document"], F.lit("")),
        F.when(o["share"] != "", F.concat(F.coalesce(F.replace(F.format_string("%.10g", F.round(share_number(o["share"]), 2)), F.lit("."), F.lit(",")), o["share"]), F.lit("%")))))
    listed = F.concat_ws(" ", F.array_join(share, " "), F.col(owners_text))
    # fixed values: weights of the registry search
    keys = {
        "_pre": compact_key(prefix), "_doc": compact_key(F.concat_ws(" ", document, owners_text)), "_op": fold(operator),
        "_own": fold(listed), "_mod": fold(F.concat_ws(" ", *models)),
        "_text": fold(F.concat_ws(" ", F.col(prefix), F.col(operator), F.col(document), F.col(owners_text), F.array_join(share, " "), *[F.col(c) for c in (*models, *more)])),
        "_comp": compact_key(F.concat_ws(" ", F.col(prefix), F.col(operator), F.col(document), F.col(owners_text), F.array_join(share, " "), *[F.col(c) for c in (*models, *more_compact)])),
    }
    # a word that hits any field is, without its signs, part of one of the two compact texts
    sizes = _sizes(queries)
    ask = _queries(df.sparkSession, queries, {"c": lambda row: [x["c"] for x in row["tokens"]]})
    # which of the two only matters where fields differ between them
    whole = F.col("_comp") if tuple(more) == tuple(more_compact) else F.concat_ws(" ", F.col("_comp"), F.regexp_replace("_text", "[^a-z0-9]+", ""))
    work = candidates(_spread(df).withColumns(keys), [("c", whole, sizes)], ask)
    q, pre, doc = F.col("_q"), F.col("_pre"), F.col("_doc")
    c, n = q["compact"], q["norm"]
    some = c != ""
    by_prefix = _first((some & (pre == c), 500), (pre.startswith(c) & (F.length(c) >= 2), 320), (pre.contains(c) & (F.length(c) >= 2), 220))
    by_doc = _first((some & (doc == c), 460), (doc.contains(c) & (F.length(c) >= 4), 260))
    by_all = _first((F.col("_comp").contains(c) & (F.length(c) >= 3), 48))
    words = n != ""
    by_words = _first((words & F.col("_op").contains(n), 180)) + _first((words & F.col("_own").contains(n), 160)) + _first((words & F.col("_mod").contains(n), 95))

    def token_score(x: Column) -> Column:
        t, k = x["t"], x["c"]
        strong = F.greatest(
            _first(((k != "") & pre.contains(k), 110)), _first((doc.contains(k) & (F.length(k) >= 3), 105)),
            _first((F.col("_op").contains(t), 62)), _first((F.col("_own").contains(t), 58)), _first((F.col("_mod").contains(t), 36)))
        weak = _first((F.col("_text").contains(t), 20), (F.col("_comp").contains(k) & (F.length(k) >= 2), 14))
        return F.when(strong > 0, strong).otherwise(weak)

    scored = work.withColumn("_ts", F.transform(q["tokens"], token_score))
    base = by_prefix + by_doc + by_all + by_words
    tokens = F.aggregate("_ts", F.lit(0), lambda a, x: a + x)
    active = F.col(cancelled).isNull()
    scored = scored.withColumn("_hit", base + tokens).filter((F.col("_hit") > 0) & F.forall("_ts", lambda s: s > 0))
    scored = scored.select(F.col("_q.query").alias("query"), (F.col("_hit") + F.when(active, 6).otherwise(0)).alias("score"), active.alias("is_active"), *df.columns)
    return top_per_group(scored, ["query"], [F.col("score").desc(), F.col("is_active").desc(), F.col(tie or prefix)], limit, rank="position")


def search_sanctions(df: DataFrame, queries: Sequence[str], name: str, document: str, active: str, fields: Sequence[str], key: str, limit: int = 60) -> DataFrame:
    """Best records per query by name (3 characters or more) or document digits (5 or more)."""
    keyed = _spread(df).withColumns({
        "_text": fold(F.concat_ws(" ", *[F.col(f) for f in fields])), "_digits": F.coalesce(F.regexp_replace(document, r"\D+", ""), F.lit(""))})
    ask = _queries(df.sparkSession, queries, {
        "d": lambda row: [row["digits"]] if len(row["digits"]) >= 5 else None, "t": lambda row: [row["norm"]] if len(row["norm"]) >= 3 else None})
    work = candidates(keyed, [("d", F.col("_digits"), [GRAM]), ("t", F.col("_text"), [GRAM])], ask)
    q, text, digits = F.col("_q"), F.col("_text"), F.col("_digits")
    by_doc = (F.length(q["digits"]) >= 5) & digits.contains(q["digits"])
    by_text = (F.length(q["norm"]) >= 3) & text.contains(q["norm"])
    # fixed values: weights of the sanction search
    score = (
        _first((F.col(active), 100))
        + _first(((q["digits"] != "") & (digits == q["digits"]), 60), ((q["digits"] != "") & digits.contains(q["digits"]), 30))
        + _first((text.startswith(q["norm"]), 20), (text.contains(q["norm"]), 10)))
    # a record found both ways counts once, as found by its digits
    hits = work.filter(F.when(q["way"] == "d", by_doc).otherwise(by_text & ~by_doc)).select(F.col("_q.query").alias("query"), score.alias("score"), *df.columns)
    return top_per_group(hits, ["query"], [F.col("score").desc(), F.col(name), F.col(key)], limit, rank="position")


def filter_items(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Items whose folded fields contain the query; order is the caller's."""
    wanted = fold_text(query)
    return df if not wanted else df.filter(fold(F.concat_ws(" ", *[F.col(f) for f in fields])).contains(wanted))


def facet_filter(df: DataFrame, preset: dict[str, str | int | None]) -> DataFrame:
    """Conjunction of the facets that are set; an empty facet matches everything."""
    for column, value in preset.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == F.lit(value))
    return df


# ------------------------------------------------------------ inverted index

def build_index(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Postings (token, document, tf). One row per pair, so that a word found in every
    document is many rows and not one list."""
    tokens = docs.select(F.col(key), F.explode(match_tokens(F.concat_ws(" ", *[F.col(c) for c in columns]))).alias("token"))
    return tokens.groupBy("token", key).agg(F.count("*").alias("tf"))


def write_index(postings: DataFrame, key: str, path: str, buckets: int = 256) -> None:
    """Bucketed by token hash and sorted, so a lookup reads one bucket's row groups; a heavy bucket is split
    over as many writers as its size asks for."""
    work = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    work.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_index(postings: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """Documents that hold every token, with the summed frequency."""
    wanted = sorted({fold_text(t) for t in tokens})
    hits = postings.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.count("*").alias("_n"), F.sum("tf").alias("tf"))
    return hits.filter(F.col("_n") == len(wanted)).drop("_n")
