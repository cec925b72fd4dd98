"""Monitors on the event feed and on orders: new keys, changed versions, statuses, streams."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions.arrays import short_id
from civisight.functions.html import repair_json
from civisight.functions.money import money
from civisight.operators import clean, lookups, ranking, sets, state
from civisight.operators.windows import dedupe_last
from civisight.session import shared_dir
from civisight.sources.readers import flatten_json
from civisight.sources.sinks import upsert
from civisight.streaming import monitors as streams

CUT = "2024-01-20"


def ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


KEYS = ["user_id", "band"]
NEW_SQL = f"""WITH k AS (SELECT ts, user_id, CAST(floor(value) AS BIGINT) AS band FROM events)
SELECT user_id, band FROM k WHERE ts >= TIMESTAMP '{CUT}' EXCEPT SELECT user_id, band FROM k WHERE ts < TIMESTAMP '{CUT}'"""


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("band", F.floor("value"))


@query("new_keys", NEW_SQL)
def new_keys(t: Tables) -> DataFrame:
    """(user, whole value) pairs not seen before the cut."""
    rows = keyed(t.events)
    current = rows.filter(F.col("ts") >= ts(CUT)).select(*KEYS).distinct()
    return lookups.new_keys(current, rows.filter(F.col("ts") < ts(CUT)), KEYS)


@query("new_keys_first_run", "SELECT user_id FROM events WHERE false")
def new_keys_first_run(t: Tables) -> DataFrame:
    return lookups.new_keys(t.events.select("user_id").distinct(), t.events.filter("false"), ["user_id"], first_run=True)


@query("changed_rows", f"""WITH l AS (SELECT user_id, max(event_id) AS version FROM events GROUP BY ALL), r AS (SELECT user_id, max(event_id) AS version FROM events WHERE ts < TIMESTAMP '{CUT}' AND value < 60 GROUP BY ALL)
SELECT l.user_id, l.version FROM l LEFT JOIN r USING (user_id) WHERE r.version IS DISTINCT FROM l.version""")
def changed_rows(t: Tables) -> DataFrame:
    """Local versions the remote side lacks or has in another state."""
    local = t.events.groupBy("user_id").agg(F.max("event_id").alias("version"))
    remote = t.events.filter((F.col("ts") < ts(CUT)) & (F.col("value") < 60)).groupBy("user_id").agg(F.max("event_id").alias("version"))
    return lookups.changed_rows(local, remote, "user_id", "version")


@query("pending_work", """WITH w AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, max_by(event_type, event_id) AS status, max(value) FILTER (event_type = 'purchase' AND value > 50) AS spend
  FROM events WHERE event_type <> 'view' AND value > 20 GROUP BY user_id)
SELECT w.user_id, CASE WHEN c.user_id IS NULL THEN 'absent' WHEN status = 'error' THEN 'failed' ELSE 'incomplete' END AS reason FROM w LEFT JOIN c USING (user_id)
WHERE c.user_id IS NULL OR status = 'error' OR spend IS NULL""")
def pending_work(t: Tables) -> DataFrame:
    """Users whose cached record is absent, failed or incomplete."""
    cache = t.events.filter("event_type <> 'view' and value > 20").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("status"), F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), F.col("value"))).alias("spend"))
    return lookups.pending(t.events.select("user_id").distinct(), cache, "user_id", ["spend"])


@query("first_last_seen", f"""WITH s AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY ALL), o AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '{CUT}' AND value > 80)
SELECT user_id, CAST(coalesce(f, TIMESTAMP '2024-02-01')::DATE AS VARCHAR) AS first_seen, CAST(CASE WHEN o.user_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE l END::DATE AS VARCHAR) AS last_seen FROM s FULL JOIN o USING (user_id)""")
def first_last_seen(t: Tables) -> DataFrame:
    before = t.events.filter(F.col("ts") < ts(CUT)).groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    observed = t.events.filter((F.col("ts") >= ts(CUT)) & (F.col("value") > 80))
    out = state.touch_seen(before, observed, "user_id", ts("2024-02-01"))
    return out.select("user_id", *[F.col(c).cast("date").cast("string").alias(c) for c in ("first_seen", "last_seen")])


@query("dataset_equal", "SELECT 0::BIGINT AS different_rows, true AS same")
def dataset_equal(t: Tables) -> DataFrame:
    """A table against itself in another order."""
    return sets.same_dataset(t.events, t.events.orderBy(F.col("value").desc()))


@query("dataset_changed", """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 200 GROUP BY ALL)
SELECT count(*) FILTER (a.n IS DISTINCT FROM b.n) AS different_rows, false AS same FROM a FULL JOIN b USING (user_id, event_type)""")
def dataset_changed(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type")
    return sets.same_dataset(rows, t.events.filter("value < 200").select("user_id", "event_type"))


@query("change_stamp", """WITH v(variant, low) AS (VALUES ('whole', 0), ('part', 100)),
d AS (SELECT variant, (SELECT count(*) FROM events WHERE low > 0 AND NOT coalesce(value < low, false)) > 0 AS changed FROM v)
SELECT variant, CASE WHEN changed THEN '2024-02-01' ELSE '2024-01-01' END AS changed_at, changed FROM d""")
def change_stamp(t: Tables) -> DataFrame:
    """The time stamp moves only if the data changed: the same rows in another order, and some of them."""
    rows = t.events.select("event_id", "value")
    found = {name: state.change_stamp(before, rows, F.lit("2024-01-01"), F.lit("2024-02-01"))
             for name, before in {"whole": rows.orderBy("value"), "part": rows.filter("value < 100")}.items()}
    return sets.union_tagged(found, "variant")


@query("status_machine", f"""WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN value < 30 THEN 'image_only' ELSE 'ok' END WHEN 'signup' THEN 'not_supplied' ELSE 'error' END AS status, ts FROM events),
s AS (SELECT user_id, max_by(status, event_id) AS status FROM o WHERE ts < TIMESTAMP '2024-01-05' GROUP BY user_id),
n AS (SELECT user_id, max_by(status, event_id) AS status FROM o WHERE ts >= TIMESTAMP '2024-01-05' AND user_id NOT IN (SELECT user_id FROM s WHERE status <> 'error') GROUP BY user_id)
SELECT user_id, coalesce(n.status, s.status) AS status FROM s FULL JOIN n USING (user_id)""")
def status_machine(t: Tables) -> DataFrame:
    """Terminal states stay, errors are tried again, the last attempt counts."""
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "signup", "not_supplied").otherwise("error")
    body = F.when(F.col("value") < 30, "short").otherwise(F.rpad(F.lit("long"), 300, "x"))
    seen = t.events.select("user_id", "event_id", "ts", state.observed_status(outcome, body).alias("status"))
    first = dedupe_last(seen.filter(F.col("ts") < ts("2024-01-05")), ["user_id"], "event_id").select("user_id", "status")
    later = seen.filter(F.col("ts") >= ts("2024-01-05"))
    return state.advance_status(first, later, "user_id", "event_id", retry_errors=True)


@query("failure_counter", """WITH s AS (SELECT user_id, count(*) AS failures FROM events WHERE ts < TIMESTAMP '2024-01-30' AND event_type = 'error' GROUP BY ALL),
o AS (SELECT user_id, max_by(event_type, event_id) <> 'error' AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY ALL),
x AS (SELECT user_id, CASE WHEN ok IS NULL THEN coalesce(failures, 0) WHEN ok THEN 0 ELSE coalesce(failures, 0) + 1 END::BIGINT AS failures FROM s FULL JOIN o USING (user_id))
SELECT user_id, failures, failures >= 5 AS blocked FROM x""")
def failure_counter(t: Tables) -> DataFrame:
    before = t.events.filter((F.col("ts") < ts("2024-01-30")) & (F.col("event_type") == "error")).groupBy("user_id").agg(F.count("*").alias("failures"))
    last = t.events.filter(F.col("ts") >= ts("2024-01-30")).groupBy("user_id").agg((F.max_by("event_type", "event_id") != "error").alias("ok"))
    return state.count_failures(before, last, "user_id", "ok", 5)


@query("refetch_rule", """SELECT event_id, event_type <> 'view' OR value < 10 OR value > 100 AS refetch FROM events""")
def refetch_rule(t: Tables) -> DataFrame:
    rule = state.must_refetch(F.nullif(F.col("event_type") == "view", F.lit(False)), F.col("value") < 10, F.col("value") > 100)
    return t.events.select("event_id", rule.alias("refetch"))


@query("fetch_priority", """WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id),
p AS (SELECT url, coalesce(failures, 0) AS failures FROM pages LEFT JOIN f ON page_id = user_id)
SELECT url, failures FROM p ORDER BY failures, CASE WHEN lower(url) LIKE '%/view%' OR lower(url) LIKE '%.pdf%' OR lower(url) LIKE '%@@download/file%' THEN 1 ELSE 0 END, length(url), lower(url) LIMIT 100""")
def fetch_priority(t: Tables) -> DataFrame:
    failures = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    rows = t.pages.join(failures, F.col("page_id") == F.col("user_id"), "left").select("url", F.coalesce("failures", F.lit(0)).alias("failures"))
    return ranking.fetch_priority(rows, "failures", "url", 100)


@query("keyed_upsert", """WITH u AS (SELECT l_suppkey AS k, max_by(l_quantity, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey, e := l_extendedprice)) AS v FROM lineitem WHERE l_shipdate >= DATE '2001-10-01' GROUP BY ALL)
SELECT s_suppkey AS k, coalesce(v, s_acctbal) AS v FROM supplier LEFT JOIN u ON k = s_suppkey""")
def keyed_upsert(t: Tables) -> DataFrame:
    """Latest update per key replaces the row of the target."""
    target = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    updates = t.lineitem.filter(F.col("l_shipdate") >= ts("2001-10-01")).select(
        F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    return upsert(target, updates, ["k"], "o")


@query("eligible_places", """SELECT p_partkey, p_name LIKE '%blue%' OR regexp_matches(p_type, 'SMALL') AND NOT regexp_matches(p_name, '\\bring\\b') AS eligible FROM part""")
def eligible_places(t: Tables) -> DataFrame:
    """A wanted word, or the remote word without an excluded one."""
    place = F.concat_ws(" ", F.col("p_name"), F.when(F.col("p_type") == "SMALL", "remote"))
    return t.part.select("p_partkey", clean.eligible_place(place, ["blue"], "remote", [r"\bring\b"]).alias("eligible"))


@query("json_repair", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k, event_type <> 'error' AS ok FROM events""")
def json_repair(t: Tables) -> DataFrame:
    """Replies as JSON, wrapped in prose, or unreadable."""
    reply = F.when(F.col("event_type") == "error", F.lit("no idea")).when(
        F.col("event_type") == "view", F.concat(F.lit("Sure! Here it is:\n"), F.col("props"), F.lit("\nDone."))).otherwise(F.col("props"))
    return t.events.select("event_id", repair_json(reply, "struct<k:int>").alias("r")).select("event_id", F.col("r.value.k").alias("k"), "r.ok")


@query("sanitized_records", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS n, upper(substr(event_type, 1, 2)) AS uf,
 CASE WHEN event_type IN ('view', 'click') THEN event_type END AS status, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS company FROM events""")
def sanitized_records(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    rows = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "many").otherwise(k).alias("n"), F.concat(F.lit(" "), F.col("event_type")).alias("uf"),
        F.initcap("event_type").alias("status"), F.col("event_type").alias("company"))
    out = clean.sanitize_record(rows, ["company"], ["n"], "uf", "status", ["view", "click"])
    return out.withColumn("company", clean.blank_echo("company", "CLI"))


@query("flattened_feed", """SELECT event_id, unnest([user_id, user_id + 1]) AS id, unnest([event_type, 'next']) AS name FROM events""")
def flattened_feed(t: Tables) -> DataFrame:
    """Nested arrays of JSON documents to rows."""
    docs = t.events.select(F.to_json(F.struct(F.array(
        F.struct("event_id", F.col("user_id").alias("id"), F.col("event_type").alias("name")),
        F.struct("event_id", (F.col("user_id") + 1).alias("id"), F.lit("next").alias("name"))).alias("items"))).alias("doc"))
    return flatten_json(docs, "doc", "struct<items:array<struct<event_id:bigint,id:bigint,name:string>>>", "items")


@query("slot_rows", """SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, unnest(['08:00', '09:00']) AS start, unnest([o_custkey, 1]) AS avail FROM orders""")
def slot_rows(t: Tables) -> DataFrame:
    """Availability maps to rows."""
    from civisight.plans.monitors import slots

    slot = lambda start, n: F.struct(F.col("o_orderkey").alias("id"), F.lit(start).alias("start"), n.alias("avail"))
    rows = t.orders.select(F.create_map(F.date_format("o_orderdate", "yyyy-MM-dd"), F.array(
        slot("08:00", F.col("o_custkey")), slot("09:00", F.lit(1).cast("bigint")))).alias("slots"))
    return slots(rows).select("id", "date", "start", "avail")


# ------------------------------------------------------------------ streams

def _stream(t: Tables, table: str) -> DataFrame:
    # a glob, so that the table may be one file or a folder of files
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("new_key_stream", NEW_SQL)
def new_key_stream(t: Tables) -> DataFrame:
    """Alerts of a file stream against a state seeded from earlier events."""
    seed = keyed(t.events.filter(F.col("ts") < ts(CUT))).select(*KEYS).distinct()
    stream = keyed(_stream(t, "events").filter(F.col("ts") >= ts(CUT)))
    out = streams.new_key_alert(stream, KEYS, _folder(t, "alerts"), seed)
    return t.spark.read.parquet(f"{out}/*").select(*KEYS)


@query("snapshot_delta_stream", f"""WITH c AS (SELECT user_id, sum(value::DECIMAL(20,2)) AS v FROM events GROUP BY ALL), p AS (SELECT user_id, sum(value::DECIMAL(20,2)) AS v FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY ALL)
SELECT user_id, c.v::DOUBLE AS value, coalesce(p.v, 0)::DOUBLE AS previous, (c.v - coalesce(p.v, 0))::DOUBLE AS delta FROM c LEFT JOIN p USING (user_id) WHERE abs(c.v - coalesce(p.v, 0)) > 0.005""")
def snapshot_delta_stream(t: Tables) -> DataFrame:
    """Growth of a streamed snapshot over the stored one."""
    totals = lambda df: df.groupBy("user_id").agg(F.sum(money("value")).alias("value"))
    seed = totals(t.events.filter(F.col("ts") < ts(CUT)))
    out = streams.snapshot_delta(_stream(t, "events"), totals, ["user_id"], "value", _folder(t, "delta"), seed)
    rows = t.spark.read.parquet(f"{out}/*")
    return rows.select("user_id", *[F.col(c).cast("double").alias(c) for c in ("value", "previous", "delta")])


@query("upsert_stream", """SELECT user_id, max_by(event_type, event_id) AS state FROM events GROUP BY user_id""")
def upsert_stream(t: Tables) -> DataFrame:
    """Latest state per user, kept by a stream."""
    stream = _stream(t, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    out = streams.upsert_stream(stream, ["user_id"], "event_id", _folder(t, "upsert"))
    return t.spark.read.parquet(out).select("user_id", "state")


@query("posts_to_records", """SELECT 'post_' || substr(sha1('at://' || conv_id || '/' || turn), 1, 18) AS id, left(trim(split_part(trim(text), chr(10), 1)), 120) AS title, '2024-01-31' AS date FROM conversations WHERE trim(text) <> ''""")
def posts_to_records(t: Tables) -> DataFrame:
    """Posts of a feed to corpus records."""
    uri = F.concat(F.lit("at://"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    posts = t.conversations.select(F.struct(
        uri.alias("uri"), short_id(uri).alias("cid"), F.struct(F.col("text"), F.lit("2024-01-31T10:00:00.000Z").alias("createdAt")).alias("record")).alias("post"))
    rows = streams.posts_to_records(posts, "posts", "post", "(untitled)", "post_")
    return rows.select("id", "title", F.col("date").cast("string").alias("date"))
