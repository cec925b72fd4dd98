"""Tables taken through the forms in which public data lands and is stored, and read back."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions.dates import prev_closed_month, weekday_label, years_ago
from civisight.functions.text import strip_tags
from civisight.operators import clean, rollups, sets
from civisight.operators.windows import last_page, numbered
from civisight.plans.alignment import landed_votes
from civisight.session import shared_dir
from civisight.sources import landed, readers, sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


# -------------------------------------------------------------------- scans

@query("delimited_headers", """SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 2 THEN c_nationkey::VARCHAR END AS c_nationkey FROM customer""")
def delimited_headers(t: Tables) -> DataFrame:
    """Files whose headers differ in order and in columns, matched by name."""
    path, rows = _folder(t, "delimited"), _text(customers(t))
    heads = [["c_name", "c_custkey"], ["c_custkey", "c_mktsegment", "c_name"], ["c_nationkey", "c_name", "c_custkey", "c_mktsegment"]]
    for i, names in enumerate(heads):
        sinks.write_table_csv(rows.filter(F.col("c_custkey").cast("long") % 3 == i), f"{path}/{i}", names)
    return readers.read_delimited(t.spark, [f"{path}/{i}" for i in range(len(heads))]).drop("row_no")


@query("utf16_delimited", """SELECT doc_id::VARCHAR AS doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text <> ''""")
def utf16_delimited(t: Tables) -> DataFrame:
    """Whole texts, line breaks, quotes and all, through UTF-16 files."""
    path = _folder(t, "utf16")
    rows = t.documents.filter("text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    options = {"header": True, "sep": ";", "quoteAll": True, "escape": '"', "encoding": "UTF-16"}
    rows.write.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_delimited(t.spark, path, encoding="UTF-16", multiline=True).drop("row_no")


@query("archive_members", """SELECT c_custkey::VARCHAR AS "C CustKey", c_name AS "Ç Name", NULL::VARCHAR AS absent, 'data.csv' AS member FROM customer""")
def archive_members(t: Tables) -> DataFrame:
    """A member of each of several archives; headers match after folding."""
    path = _folder(t, "archives")
    for half in range(2):
        landed.write_archives(customers(t).filter(F.col("c_custkey") % 2 == half).hint("rebalance"), path)
    return landed.read_archives(t.spark, path, ["C CustKey", "Ç Name", "absent"], contains=["data"]).drop("file", "row_no")


@query("document_archives", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, lang FROM documents WHERE NOT contains(text, chr(0))")
def document_archives(t: Tables) -> DataFrame:
    """Whole texts through archives: line breaks and quotes stay inside their row."""
    path = _folder(t, "texts")
    landed.write_archives(t.documents.filter("not contains(text, char(0))").select("doc_id", "text", "lang").hint("rebalance"), path)
    return landed.read_archives(t.spark, path, ["doc_id", "text", "lang"]).select("doc_id", F.md5("text").alias("text"), "lang")


@query("preamble_files", """SELECT c_custkey::VARCHAR AS c_custkey, c_name, '2024-05-06' AS source_date FROM customer UNION ALL SELECT 'c_custkey', 'c_name', '2024-05-06' UNION ALL SELECT 'Updated: 2024-05-06', 'two' || chr(10) || 'lines', '2024-05-06'""")
def preamble_files(t: Tables) -> DataFrame:
    """Files with a dated first line: one has only that, one a row like its header, one a row like its preamble with a quoted line break."""
    path, title = _folder(t, "preamble"), "Updated: 2024-05-06"
    odd = t.spark.createDataFrame([("c_custkey", "c_name"), (title, "two\nlines")], "c_custkey string, c_name string")
    rows = _text(customers(t).select("c_custkey", "c_name"))
    landed.write_preamble(rows.hint("rebalance").unionByName(odd), path, title)
    t.spark.range(1).select(F.lit(title).alias("value")).coalesce(1).write.mode("append").text(path)
    out = readers.read_with_preamble(t.spark, path)
    return out.select("c_custkey", "c_name", F.col("source_date").cast("string").alias("source_date"))


@query("jsonl_rows", """SELECT doc_id, nullif(lang, '') AS lang, CASE WHEN text <> '' THEN md5(text) END AS text FROM documents""")
def jsonl_rows(t: Tables) -> DataFrame:
    """Compact JSON lines and back; empty fields were left out."""
    path = _folder(t, "jsonl")
    sinks.write_jsonl(t.documents.select("doc_id", "lang", "text"), path)
    return readers.read_jsonl(t.spark, path, "doc_id bigint, lang string, text string").withColumn("text", F.md5("text"))


@query("state_tables", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def state_tables(t: Tables) -> DataFrame:
    """A stored state, and one that was never written."""
    path, schema = _folder(t, "state"), "k bigint, v string"
    t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")).write.parquet(path)
    return readers.read_state(t.spark, path, schema).unionByName(readers.read_state(t.spark, f"{path}-never", schema))


@query("text_files", "SELECT md5(text) AS text FROM documents WHERE text <> ''")
def text_files(t: Tables) -> DataFrame:
    """One text file per document, read back whole."""
    path = _folder(t, "corpus")
    sinks.write_text_corpus(t.documents.filter("text <> ''"), path, "text", "doc_id")
    return readers.read_text_corpus(t.spark, path).select(F.md5(F.regexp_replace("text", r"\n\z", "")).alias("text"))


# -------------------------------------------------------------------- sinks

@query("report_tables", """SELECT 'flags' AS part, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'states', o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def report_tables(t: Tables) -> DataFrame:
    path = _folder(t, "report")
    parts = {"flags": rollups.value_counts(t.lineitem.withColumnRenamed("l_returnflag", "label"), ["label"]),
             "states": rollups.value_counts(t.orders.withColumnRenamed("o_orderstatus", "label"), ["label"])}
    sinks.write_report(parts, path)
    return sets.union_tagged({k: t.spark.read.schema("label string, n bigint").json(f"{path}/{k}") for k in parts}, "part")


@query("partition_refresh", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, CASE WHEN year(o_orderdate) >= 1995 THEN 2 ELSE 1 END AS version FROM orders WHERE year(o_orderdate) <= 1996""")
def partition_refresh(t: Tables) -> DataFrame:
    """Years stored in an old version, and the current one, are rebuilt; the others stay."""
    path, current = _folder(t, "years"), 1996
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")).filter(F.col("year") <= current)
    sinks.write_partitions(rows.withColumn("version", F.lit(1)), path, ["year"])
    years = [r.year for r in rows.select("year").distinct().collect()]
    again = sinks.refresh_partitions(years, {y: 1 if y == 1995 else 2 for y in years}, 2, current)
    sinks.write_partitions(rows.filter(F.col("year").isin(again)).withColumn("version", F.lit(2)), path, ["year"])
    return t.spark.read.schema("o_orderkey bigint, version int, year int").parquet(path).select("o_orderkey", "year", "version")


@query("bucket_upsert", """WITH u AS (SELECT c_custkey AS k, max(o_orderdate)::DATE::VARCHAR AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY ALL)
SELECT c_custkey AS k, coalesce(u.v, c_mktsegment) AS v FROM customer LEFT JOIN u ON u.k = c_custkey""")
def bucket_upsert(t: Tables) -> DataFrame:
    """Updates into a keyed table at rest, twice: the second time nothing changes."""
    path = _folder(t, "keyed")
    start = t.customer.select(F.col("c_custkey").cast("long").alias("k"), F.col("c_mktsegment").alias("v"), F.lit("0").alias("o"))
    day = F.col("o_orderdate").cast("date").cast("string")
    updates = t.orders.filter("o_totalprice > 300000").join(t.customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("long").alias("k"), day.alias("v"), day.alias("o"))
    for rows in (start, updates, updates):
        sinks.upsert_buckets(rows, path, ["k"], "o", buckets=64)
    return sinks.read_buckets(t.spark, path, start.schema).select("k", "v")


# -------------------------------------------------------- order and counts

@query("numbered_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS place FROM lineitem")
def numbered_rows(t: Tables) -> DataFrame:
    """The place of every line in one order over the whole table."""
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")]]
    return numbered(t.lineitem, order, "place").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "place")


@query("rank_last_page", """WITH r AS (SELECT c_custkey AS key, c_acctbal AS balance, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position, count(*) OVER () AS n FROM customer)
SELECT key, balance, position FROM r WHERE position > (ceil(n / 40.0) - 1) * 40""")
def rank_last_page(t: Tables) -> DataFrame:
    """The last page, at the price of the first."""
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return last_page(rows, [F.col("balance").desc(), F.col("key")], 40)


@query("merged_distinct", """SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL""")
def merged_distinct(t: Tables) -> DataFrame:
    """Distinct orders per flag from partials per flag and year of shipping; an order of two years counts once."""
    numbers = rollups.dense_numbers(t.lineitem, "l_orderkey")
    rows = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year")).join(numbers, "l_orderkey")
    path = _folder(t, "partials")
    rollups.distinct_bitmaps(rows, ["flag", "year"], "number").write.partitionBy("year").parquet(path)
    return rollups.bitmap_counts(t.spark.read.schema("flag string, bucket bigint, bits binary, year int").parquet(path), ["flag"], "orders")


@query("distinct_cubes", """SELECT CASE WHEN grouping(flag) = 0 THEN 'flag' WHEN grouping(status) = 0 THEN 'status' ELSE 'year' END AS grain, flag, status, year, count(DISTINCT l_partkey) AS parts
FROM (SELECT l_partkey, l_returnflag AS flag, l_linestatus AS status, year(l_shipdate)::INTEGER AS year FROM lineitem) GROUP BY GROUPING SETS ((flag), (status), (year))""")
def distinct_cubes(t: Tables) -> DataFrame:
    """Exact distinct parts over three key sets by one shuffle of bitmaps."""
    rows = t.lineitem.select("l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year"))
    return rollups.roll_up_distinct(rows, {"flag": ["flag"], "status": ["status"], "year": ["year"]}, "l_partkey", "parts")


@query("dataset_fingerprints", """WITH a AS (SELECT user_id, event_type FROM events), v(variant, k) AS (VALUES ('same', 0), ('copy', 1), ('less', 2), ('parts', 3))
SELECT variant, CASE variant WHEN 'copy' THEN (SELECT count(*) FROM a) = 0 WHEN 'less' THEN (SELECT count(*) FROM events WHERE value >= 60) = 0 ELSE true END AS same FROM v""")
def dataset_fingerprints(t: Tables) -> DataFrame:
    """Fingerprints of a table against itself in another order, with rows twice, with rows missing, and merged from two parts."""
    rows = t.events.select("user_id", "event_type")
    less = t.events.filter("value < 60").select("event_type", "user_id")
    whole = sets.fingerprint(rows)
    parts = sets.fingerprint(less).unionByName(sets.fingerprint(t.events.filter("not (value < 60)"), ["user_id", "event_type"]))
    found = {"same": sets.unchanged(rows, rows.orderBy("event_type").select("event_type", "user_id")), "copy": sets.unchanged(rows, rows.unionByName(rows)),
             "less": sets.unchanged(rows, less),
             "parts": whole.unionByName(sets.merge_fingerprints(parts)).agg((F.count_distinct("rows", "low", "high") == 1).alias("same"))}
    return sets.union_tagged(found, "variant").select("variant", "same")


# -------------------------------------------------------------- small rules

@query("resolved_columns", """SELECT c_custkey::VARCHAR AS id, c_name AS name, NULL::VARCHAR AS missing, c_mktsegment AS "Segment" FROM customer""")
def resolved_columns(t: Tables) -> DataFrame:
    """Headers found by words, and wanted columns in order."""
    raw = _text(customers(t)).withColumnsRenamed({"c_custkey": "Código do Cliente", "c_name": "NOME COMPLETO DO CLIENTE", "c_mktsegment": "SEGMENTO"})
    spec = {"id": {"exact": ["codigo do cliente"]}, "name": {"contains": [["nome", "cliente"]]}, "missing": {"contains": [["xyz"]]}}
    out = readers.select_resolved(raw, spec, keep=["SEGMENTO"]).withColumnRenamed("SEGMENTO", "Segment")
    return readers.select_available(out, ["id", "NAME", "missing", "Segment"]).withColumnRenamed("NAME", "name")


@query("rejected_null_keys", """SELECT l_orderkey::VARCHAR AS event_id, 'name::' || l_shipmode AS person_id, CASE l_returnflag WHEN 'R' THEN 'SP' END AS state FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) WHERE l_returnflag <> 'A'""")
def rejected_null_keys(t: Tables) -> DataFrame:
    """Landed votes: rows without an event are left out, a person without an id goes by name."""
    null = F.lit(None).cast("string")
    raw = t.lineitem.select(
        F.when(F.col("l_returnflag") != "A", F.col("l_orderkey").cast("string")).alias("idVotacao"), F.lit(" ").alias("deputado_id"), F.col("l_linestatus").alias("deputado_nome"),
        null.alias("deputado_siglaPartido"), F.when(F.col("l_returnflag") == "R", " SP ").alias("deputado_siglaUf"), F.lit("Sim").alias("voto"), F.lit(0).alias("row_no"))
    return landed_votes(raw).select("event_id", "person_id", "state")


@query("display_labels", """SELECT doc_id, upper(trim(lang)) AS lang, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE source END AS source FROM documents""")
def display_labels(t: Tables) -> DataFrame:
    source = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source"))
    return t.documents.select("doc_id", clean.label_missing("lang", "--", upper=True).alias("lang"), clean.label_missing(source, "none").alias("source"))


@query("stripped_tags", r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&aacute;', 'á'), '&amp;', '&'), '[\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '') AS text FROM pages""")
def stripped_tags(t: Tables) -> DataFrame:
    """Real pages without their tags."""
    return t.pages.select("page_id", strip_tags("html").alias("text"))


@query("closed_months", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL '24 months' AS DATE)::VARCHAR AS before, CAST(o_orderdate AS DATE) < DATE '1998-06-01' AS closed, isodow(o_orderdate)::INTEGER AS weekday FROM orders""")
def closed_months(t: Tables) -> DataFrame:
    """Two years before, whether the month was closed on a day of July 1998, and the weekday."""
    day = F.col("o_orderdate").cast("date")
    names = F.array(*[weekday_label(F.lit(f"2024-01-0{i}").cast("date")) for i in range(1, 8)])
    return t.orders.select(
        "o_orderkey", years_ago(day, 2).cast("string").alias("before"), (day < F.lit(prev_closed_month(dt.date(1998, 7, 9)))).alias("closed"),
        F.array_position(names, weekday_label(day)).cast("int").alias("weekday"))
