"""Registries on parts, customers and orders: activity, profiles, snapshots, search, cleaning."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions import arrays, dates, money, text
from civisight.operators import clean, profiles, ranking, search, sets
from civisight.operators.windows import rank_page

ASOF = dt.date(1998, 6, 30)
SPAN_SQL = """span AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS s, max(CAST(l_shipdate AS DATE)) AS e FROM orders LEFT JOIN
 (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
act AS (SELECT *, s <= DATE '1998-06-30' AND (e IS NULL OR e >= DATE '1998-06-30') AS active FROM span)"""


def spans(t: Tables) -> DataFrame:
    """Interval from the order to its last returned line; open without one."""
    ends = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("e"))
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("s"))
    return rows.join(ends, F.col("key") == F.col("l_orderkey"), "left").select("key", "s", "e", clean.is_active("s", "e", ASOF).alias("active"))


@query("active_intervals", f"""WITH {SPAN_SQL} SELECT key, active FROM act""")
def active_intervals(t: Tables) -> DataFrame:
    return spans(t).select("key", "active")


@query("retention_filter", f"""WITH {SPAN_SQL} SELECT key, active FROM act WHERE active OR greatest(s, e) >= DATE '1998-06-30' - INTERVAL '24 months'""")
def retention_filter(t: Tables) -> DataFrame:
    """Active, or with a date in the last two years."""
    return spans(t).filter(clean.recent_or_active("active", ["s", "e"], ASOF, 2)).select("key", "active")


@query("encoded_size", "SELECT count(*) AS rows, sum(octet_length(('{\"k\":' || n_nationkey || ',\"v\":\"' || n_name || '\"}')::BLOB))::BIGINT AS bytes FROM nation")
def encoded_size(t: Tables) -> DataFrame:
    """Size of a table as it would be published."""
    return clean.encoded_size(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))


@query("recency_counts", """SELECT o_orderstatus AS status, count(*) FILTER (d BETWEEN 0 AND 30) AS last_30_days, count(*) FILTER (d BETWEEN 0 AND 90) AS last_90_days
FROM (SELECT o_orderstatus, DATE '1998-06-30' - CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ALL""")
def recency_counts(t: Tables) -> DataFrame:
    rows = t.orders.withColumnRenamed("o_orderstatus", "status")
    return profiles.recency_counts(rows, "o_orderdate", ASOF, (30, 90), ["status"])


@query("registry_profile", """WITH p AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'c' END AS cancelled, CASE WHEN p_size > 3 THEN p_name END AS doc, p_brand, CASE WHEN p_type <> 'PROMO' THEN p_type END AS st, 1885 + p_size * 5 AS y FROM part)
SELECT count(*) AS rows, count(*) FILTER (cancelled IS NULL) AS active, count(cancelled) AS cancelled, count(doc) AS with_document, count(*) FILTER (contains(doc, 'x')) AS masked_documents,
 count(DISTINCT p_brand) AS operators, count(*) FILTER (st IS NULL) AS without_state, min(y) FILTER (y BETWEEN 1900 AND 2100)::INTEGER AS first_year, max(y) FILTER (y BETWEEN 1900 AND 2100)::INTEGER AS last_year,
 array_to_string(list_sort(list(DISTINCT st) FILTER (st IS NOT NULL)), ',') AS states FROM p""")
def registry_profile(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 40, "c").alias("cancelled"), F.when(F.col("p_size") > 3, F.col("p_name")).alias("doc"),
        "p_brand", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("st"), (F.lit(1885) + F.col("p_size") * 5).cast("string").alias("y"))
    out = profiles.registry_profile(rows, "key", "cancelled", "doc", "p_brand", "st", "y")
    return out.withColumn("states", F.array_join("states", ","))


@query("set_change", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < DATE '1998-06-01'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= DATE '1998-06-01'),
n AS (SELECT k FROM b EXCEPT SELECT k FROM a), r AS (SELECT k FROM a EXCEPT SELECT k FROM b), s AS (SELECT k FROM a INTERSECT SELECT k FROM b)
SELECT (SELECT count(*) FROM n) AS added, (SELECT count(*) FROM r) AS removed, (SELECT count(*) FROM s) AS shared,
 round((SELECT count(*) FROM s) / ((SELECT count(*) FROM n) + (SELECT count(*) FROM r) + (SELECT count(*) FROM s))::DOUBLE, 6) AS jaccard,
 (SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT k FROM n ORDER BY k LIMIT 10)) AS added_sample,
 (SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT k FROM r ORDER BY k LIMIT 10)) AS removed_sample""")
def set_change(t: Tables) -> DataFrame:
    old = t.orders.filter(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"))
    new = t.orders.filter(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    out = profiles.set_change(old, new, "o_custkey")
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("added_sample", "removed_sample")})


@query("snapshot_gate", """WITH c AS (SELECT * FROM orders WHERE o_totalprice < 480000), n AS (SELECT count(*) AS rows, (SELECT count(*) FROM orders) AS current_rows FROM c)
SELECT rows, current_rows, rows / current_rows::DOUBLE AS ratio, CASE WHEN rows < 1000 THEN 'too few rows' WHEN rows / current_rows::DOUBLE < 0.9 THEN 'too small against current' ELSE 'ok' END AS reason,
 rows >= 1000 AND rows / current_rows::DOUBLE >= 0.9 AS accepted, rows <> current_rows AS changed FROM n""")
def snapshot_gate(t: Tables) -> DataFrame:
    candidate = t.orders.filter("o_totalprice < 480000")
    return profiles.accept_snapshot(candidate, t.orders, ["o_orderkey", "o_custkey"], "o_orderkey", "o_custkey")


@query("snapshot_gate_missing_column", """SELECT count(*) AS rows, count(*) AS current_rows, 1.0::DOUBLE AS ratio, 'missing columns: c_phone' AS reason, false AS accepted, false AS changed FROM customer""")
def snapshot_gate_missing_column(t: Tables) -> DataFrame:
    return profiles.accept_snapshot(t.customer, t.customer, ["c_custkey", "c_phone"], "c_custkey", "c_name")


# ------------------------------------------------------------------- search

SEARCHES = ("Brand#2 widget", "blue", "12", "ring promo", "economy 101", "red bolt 7")
REG_SQL = """r AS (SELECT p_partkey AS key, p_brand AS prefix, CASE WHEN p_size <= 40 THEN NULL ELSE 'x' END AS cancelled, p_partkey::VARCHAR AS document, p_name AS operator,
  p_name || '|' || p_size || '|50' AS owners, p_type AS model FROM part),
f AS (SELECT *, regexp_replace(lower(prefix), '[^a-z0-9]+', '', 'g') AS pre, regexp_replace(lower(document || ' ' || owners), '[^a-z0-9]+', '', 'g') AS doc, lower(operator) AS op,
  lower(operator || ' ' || split_part(owners, '|', 2) || ' 50% ' || owners) AS own, lower(model) AS mdl,
  lower(prefix || ' ' || operator || ' ' || document || ' ' || owners || ' ' || operator || ' ' || split_part(owners, '|', 2) || ' 50% ' || model) AS txt FROM r),
g AS (SELECT *, regexp_replace(txt, '[^a-z0-9]+', '', 'g') AS comp FROM f),
q AS (SELECT query, lower(query) AS n, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') AS c FROM (VALUES ('Brand#2 widget'), ('blue'), ('12'), ('ring promo'), ('economy 101'), ('red bolt 7')) v(query)),
tok AS (SELECT query, unnest(string_split(n, ' ')) AS t FROM q),
ts AS (SELECT g.key, tok.query, CASE
   WHEN contains(pre, regexp_replace(t, '[^a-z0-9]+', '', 'g')) THEN 110 WHEN length(regexp_replace(t, '[^a-z0-9]+', '', 'g')) >= 3 AND contains(doc, regexp_replace(t, '[^a-z0-9]+', '', 'g')) THEN 105
   WHEN contains(op, t) THEN 62 WHEN contains(own, t) THEN 58 WHEN contains(mdl, t) THEN 36 WHEN contains(txt, t) THEN 20
   WHEN length(regexp_replace(t, '[^a-z0-9]+', '', 'g')) >= 2 AND contains(comp, regexp_replace(t, '[^a-z0-9]+', '', 'g')) THEN 14 ELSE 0 END AS s FROM g CROSS JOIN tok),
tt AS (SELECT key, query, sum(s) AS s FROM ts GROUP BY ALL HAVING min(s) > 0),
sc AS (SELECT g.key, q.query, prefix, g.cancelled IS NULL AS is_active, tt.s
   + CASE WHEN pre = c THEN 500 WHEN length(c) >= 2 AND starts_with(pre, c) THEN 320 WHEN length(c) >= 2 AND contains(pre, c) THEN 220 ELSE 0 END
   + CASE WHEN doc = c THEN 460 WHEN length(c) >= 4 AND contains(doc, c) THEN 260 ELSE 0 END + CASE WHEN length(c) >= 3 AND contains(comp, c) THEN 48 ELSE 0 END
   + CASE WHEN contains(op, n) THEN 180 ELSE 0 END + CASE WHEN contains(own, n) THEN 160 ELSE 0 END + CASE WHEN contains(mdl, n) THEN 95 ELSE 0 END
   + CASE WHEN g.cancelled IS NULL THEN 6 ELSE 0 END AS score FROM tt JOIN g USING (key) JOIN q USING (query))"""


@query("registry_search", f"""WITH {REG_SQL}
SELECT query, score::INTEGER AS score, document, is_active, position::INTEGER AS position FROM (SELECT query, score, key::VARCHAR AS document, is_active,
 row_number() OVER (PARTITION BY query ORDER BY score DESC, is_active DESC, prefix || '/' || key) AS position FROM sc) WHERE position <= 20""")
def registry_search(t: Tables) -> DataFrame:
    """Weighted search over several fields for a batch of queries."""
    rows = t.part.select(
        F.concat_ws("/", "p_brand", "p_partkey").alias("ident"), F.col("p_brand").alias("prefix"), F.when(F.col("p_size") > 40, "x").alias("cancel_date"),
        F.col("p_partkey").cast("string").alias("document"), F.col("p_name").alias("operator"),
        F.concat(F.col("p_name"), F.lit("|"), F.col("p_size").cast("string"), F.lit("|50")).alias("owners"), F.col("p_type").alias("model"))
    found = search.search_registry(rows, SEARCHES, 20, models=["model"], tie="ident")
    return found.select("query", "score", "document", "is_active", "position")


@query("name_or_doc_search", """WITH c AS (SELECT *, lower(c_name || ' ' || c_mktsegment) AS txt, regexp_replace(c_name, '[^0-9]+', '', 'g') AS dig, c_acctbal > 0 AS act FROM customer),
q AS (SELECT query, lower(query) AS n, regexp_replace(query, '[^0-9]+', '', 'g') AS d FROM (VALUES ('building'), ('000000123'), ('Customer#0000001'), ('ab')) v(query)),
h AS (SELECT query, c_custkey AS key, CASE WHEN act THEN 100 ELSE 0 END + CASE WHEN d <> '' AND dig = d THEN 60 WHEN d <> '' AND contains(dig, d) THEN 30 ELSE 0 END
  + CASE WHEN starts_with(txt, n) THEN 20 WHEN contains(txt, n) THEN 10 ELSE 0 END AS score, c_name FROM c, q
 WHERE (length(d) >= 5 AND contains(dig, d)) OR (length(n) >= 3 AND contains(txt, n)))
SELECT query, key, score::INTEGER AS score, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, c_name, key) AS position FROM h) WHERE position <= 60""")
def name_or_doc_search(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cat"), F.col("c_name").alias("doc"), (F.col("c_acctbal") > 0).alias("act"))
    found = search.search_sanctions(rows, ["building", "000000123", "Customer#0000001", "ab"], "name", "doc", "act", ["name", "cat"], "key")
    return found.select("query", "key", "score", "position")


@query("contains_search", """SELECT doc_id, source FROM documents WHERE contains(trim(regexp_replace(lower(strip_accents(text || ' ' || lang)), '\\s+', ' ', 'g')), 'of the')""")
def contains_search(t: Tables) -> DataFrame:
    return search.filter_items(t.documents, "Óf the", ["text", "lang"]).select("doc_id", "source")


@query("rank_page", """SELECT c_custkey AS key, c_acctbal AS balance, position FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position BETWEEN 41 AND 60""")
def third_page(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return rank_page(rows, [F.col("balance").desc(), F.col("key")], 3, 20)


# ----------------------------------------------------------------- cleaning

@query("clean_values", """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE '1 ' || o_orderpriority END AS cleaned, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderpriority END AS present FROM orders""")
def clean_values(t: Tables) -> DataFrame:
    """Whitespace, BOM and null markers; first non-empty of alternatives."""
    dirty = F.when(F.col("o_orderpriority") == "5-LOW", " #NULO# ").otherwise(F.concat(F.lit("﻿ 1 \t\n "), F.col("o_orderpriority"), F.lit("  ")))
    status = F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", text.clean_text(dirty, ["#nulo#", "#ne#", "null"]).alias("cleaned"), text.first_present(status, F.lit(""), default="none").alias("present"))


@query("parsed_money_and_dates", """SELECT o_orderkey, o_totalprice AS amount, CAST(o_orderdate AS DATE)::VARCHAR AS d1, CAST(o_orderdate AS DATE)::VARCHAR AS d2, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE)::VARCHAR END AS d3,
 CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS n FROM orders""")
def parsed_money_and_dates(t: Tables) -> DataFrame:
    """Local money text, three date spellings, whole numbers with a silent zero."""
    price = F.replace(F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit("_")), F.lit("."), F.lit(",")), F.lit("_"), F.lit("."))
    spelled = [F.date_format("o_orderdate", f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd/MM/yy")]
    third = F.when(F.col("o_orderstatus") == "F", "31/02/2020").otherwise(spelled[2])
    number = F.when(F.col("o_orderstatus") == "F", "12x").otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select(
        "o_orderkey", money.parse_money(F.concat(F.lit("R$ "), price)).cast("double").alias("amount"),
        *[dates.parse_date(c).cast("string").alias(f"d{i}") for i, c in enumerate([spelled[0], spelled[1], third], 1)], money.safe_int(number).alias("n"))


@query("plausible_values", """SELECT p_partkey, CASE WHEN 1885 + p_size * 5 BETWEEN 1900 AND 2100 THEN (1885 + p_size * 5)::INTEGER END AS year, upper('p' || substr(p_brand, 1, 1)) || '-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS mark,
 'BR-' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || '/2026' AS ident FROM part""")
def plausible_values(t: Tables) -> DataFrame:
    """Years in range, registration marks and protocol numbers."""
    mark = F.concat(F.lit("p"), F.substring("p_brand", 1, 1), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    ident = F.concat(F.lit("BR"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("2026"))
    return t.part.select("p_partkey", text.plausible_year(F.lit(1885) + F.col("p_size") * 5).alias("year"), text.format_prefix(mark).alias("mark"), text.format_id(ident).alias("ident"))


@query("masked_documents", """SELECT p_partkey, contains(p_name, 'x') AS masked, regexp_replace(p_brand, '[^0-9]+', '', 'g') AS digits FROM part""")
def masked_documents(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.is_masked("p_name").alias("masked"), text.doc_digits("p_brand").alias("digits"))


@query("owner_list_explode", """SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS name, unnest([o_custkey::VARCHAR, '']) AS document, unnest(['50,5', '']) AS share FROM orders""")
def owner_list_explode(t: Tables) -> DataFrame:
    """``name|document|share; name`` to rows."""
    raw = F.concat(F.col("o_orderpriority"), F.lit(" | "), F.col("o_custkey").cast("string"), F.lit("|50,5; ;"), F.col("o_orderstatus"), F.lit(" "))
    return t.orders.select("o_orderkey", F.explode(arrays.owners(raw)).alias("o")).select("o_orderkey", "o.*")


@query("pair_up", """SELECT c_custkey, c_mktsegment AS role, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'second', c_mktsegment FROM customer""")
def pair_up(t: Tables) -> DataFrame:
    items = F.array("c_mktsegment", "c_name", F.lit("second"), F.col("c_mktsegment"), F.lit("odd"))
    return t.customer.select("c_custkey", F.explode(arrays.pair_up(items)).alias("p")).select("c_custkey", "p.*")


@query("project_map", """SELECT c_custkey AS key, c_name AS n, nullif(c_mktsegment, 'BUILDING') AS s FROM customer""")
def project_map(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("seg", F.when(F.col("c_mktsegment") == "BUILDING", "null").otherwise(F.col("c_mktsegment")))
    return clean.project_map(rows.withColumnRenamed("c_custkey", "key"), {"c_name": "n", "seg": "s"}, keep=["key"])


@query("stable_ids", """SELECT p_partkey, substr(sha1(p_name), 1, 20) AS short_id, sha256(p_name) AS full_hash FROM part""")
def stable_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", arrays.short_id("p_name", 20).alias("short_id"), arrays.content_hash("p_name").alias("full_hash"))


# ------------------------------------------------------------ set operations

@query("union_tagged", """SELECT 'suppliers' AS source, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customers', c_name, c_acctbal, c_mktsegment FROM customer""")
def union_tagged(t: Tables) -> DataFrame:
    return sets.union_tagged({
        "suppliers": t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "customers": t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
    }).select("source", "name", "balance", "segment")


@query("key_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_intersection(t: Tables) -> DataFrame:
    rows = t.orders.withColumnRenamed("o_custkey", "k")
    return sets.intersect_keys(rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus = 'P'"), ["k"])


@query("key_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_difference(t: Tables) -> DataFrame:
    return sets.except_keys(t.customer.withColumnRenamed("c_custkey", "k"), t.orders.filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "k"), ["k"])


@query("union_values", "SELECT DISTINCT l_suppkey AS k, unnest([l_returnflag, l_linestatus]) AS value FROM lineitem")
def union_values(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), F.array("l_returnflag", "l_linestatus", F.lit("")).alias("a"))
    return sets.union_values(rows, ["k"], "a")


@query("semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def semi_join(t: Tables) -> DataFrame:
    from civisight.operators import lookups

    keys = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return lookups.semi_join(t.lineitem, keys, ["l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("snapshot_label", """WITH d AS (SELECT o_orderstatus AS s, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY ALL)
SELECT CASE WHEN count(DISTINCT d) = 1 THEN max(d)::VARCHAR ELSE string_agg(s || ' ' || d::VARCHAR, '; ' ORDER BY s) END AS snapshot_label FROM d""")
def snapshot_label(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("d", F.col("o_orderdate").cast("date"))
    return profiles.snapshot_label(rows, "o_orderstatus", "d")


@query("exact_distinct", "SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def exact_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("ranked_categories", "SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL ORDER BY n DESC, category LIMIT 3")
def ranked_categories(t: Tables) -> DataFrame:
    from civisight.operators import rollups

    rows = t.customer.withColumnRenamed("c_mktsegment", "category")
    return ranking.top_n(rollups.value_counts(rows, ["category"], F.col("c_acctbal") > 0), "n", "category", 3)
