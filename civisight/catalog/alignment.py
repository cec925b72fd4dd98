"""Voting alignment on orders and line items: an order is a roll call, a line is a vote by its
supplier, the order status is the advice."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions.money import pct
from civisight.operators.lookups import annotate_present
from civisight.operators.ranking import rank_groups
from civisight.operators.rollups import pivot_counts
from civisight.sources.sinks import union_typed as export_rows
from civisight.operators.windows import carry_forward, dedupe_first, latest_known, missing_months
from civisight.plans import alignment as plan

PERIODS = [
    {"id": "p1", "label": "First", "start": "1995-01-01", "end": "1996-06-30"},
    {"id": "p2", "label": "Second", "start": "1997-01-01", "end": "1998-12-31"},
    {"id": "p3", "label": "Third", "start": "1999-01-01", "end": None},
]
PROCEDURAL = ("urgent", "high")

PERIOD_SQL = """CASE WHEN {d} BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 'p1'
 WHEN {d} BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 'p2' WHEN {d} >= DATE '1999-01-01' THEN 'p3' ELSE 'other' END"""
VOTES_SQL = f"""joined AS (
 SELECT l_orderkey AS event_id, l_suppkey AS person_id, n_name AS grp, l_linestatus AS value, o_orderstatus AS advice,
  CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'procedural' ELSE 'merit' END AS kind,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS rn
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
votes AS (SELECT *, value = advice AS pro, {PERIOD_SQL.format(d='d')} AS period, strftime(d, '%Y-%m') AS m, year(d) AS y FROM joined WHERE rn = 1)"""
SUMS_SQL = 'count(*) FILTER (pro) AS pro, count(*) FILTER (NOT pro) AS "anti", count(*) AS total'
PCT_SQL = "count(*) FILTER (pro) / CAST(count(*) AS DOUBLE) * 100 AS pct"


def events(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("description"))


def advice(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("advice"), F.lit(1).alias("row_no"))


def votes(t: Tables) -> DataFrame:
    group = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("group"))
    return t.lineitem.join(group, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("person_id"), "group", F.col("l_linestatus").alias("value"),
        F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice").alias("row_no"))


def aligned(t: Tables) -> DataFrame:
    return plan.aligned_votes(votes(t), events(t), advice(t), PERIODS, PROCEDURAL)


def redated(rows: DataFrame, year: int) -> DataFrame:
    """Move the rows of one year a year back."""
    moved = F.when(F.col("year") == year, F.add_months("date", -12)).otherwise(F.col("date"))
    return rows.withColumn("date", moved).withColumn("month", F.to_date(F.trunc("date", "month")))


def month_text(df: DataFrame, column: str = "month") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM"))


@query("alignment_by_period", f"""WITH v AS (
 SELECT l_orderkey, l_linestatus = o_orderstatus AS pro, {PERIOD_SQL.format(d='CAST(o_orderdate AS DATE)')} AS period
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT period, {SUMS_SQL}, count(DISTINCT l_orderkey) AS events, {PCT_SQL} FROM v GROUP BY period""")
def alignment_by_period(t: Tables) -> DataFrame:
    """Flagship: agreement with the advice per period."""
    from civisight.operators.lookups import join_orientation, period_of

    facts = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_linestatus").alias("value"))
    dated = events(t).select("event_id", period_of("date", PERIODS)["id"].alias("period"))
    joined = join_orientation(facts, dated, advice(t)).withColumn("pro", F.col("value") == F.col("advice"))
    return plan.alignment_by(joined, "period")


@query("alignment_time_cube", f"""WITH {VOTES_SQL},
tallies AS (SELECT event_id, m, y, period, kind, count(*) FILTER (pro) AS pro, count(*) FILTER (NOT pro) AS "anti", count(*) AS total
 FROM votes GROUP BY ALL)
SELECT CASE WHEN grouping(m)=0 AND grouping(kind)=0 THEN 'month_kind' WHEN grouping(m)=0 THEN 'month' WHEN grouping(y)=0 THEN 'year'
  WHEN grouping(kind)=0 THEN 'period_kind' ELSE 'period' END AS grain, m AS month, y::INTEGER AS year, period, kind,
 CAST(sum(pro) AS BIGINT) AS pro, CAST(sum("anti") AS BIGINT) AS "anti", CAST(sum(total) AS BIGINT) AS total, count(*) AS events,
 sum(pro) / CAST(sum(total) AS DOUBLE) * 100 AS pct
FROM tallies GROUP BY GROUPING SETS ((m), (m, kind), (y), (period), (period, kind))""")
def alignment_time_cube(t: Tables) -> DataFrame:
    return month_text(plan.time_cube(plan.event_tallies(aligned(t))))


def _member_sql(who: str, name: str) -> str:
    return f"""WITH {VOTES_SQL}
SELECT CASE WHEN grouping(period)=0 AND grouping(kind)=0 THEN '{name}_period_kind' WHEN grouping(period)=0 THEN '{name}_period'
  WHEN grouping(kind)=0 THEN '{name}_kind' ELSE '{name}' END AS grain, {who} AS {name}_label, period, kind, {SUMS_SQL}, {PCT_SQL}
FROM votes GROUP BY GROUPING SETS (({who}), ({who}, period), ({who}, kind), ({who}, period, kind))"""


@query("alignment_group_cube", _member_sql("grp", "group"))
def alignment_group_cube(t: Tables) -> DataFrame:
    return plan.member_cube(aligned(t), "group").withColumnRenamed("group", "group_label")


@query("alignment_person_cube", _member_sql("person_id", "person_id"))
def alignment_person_cube(t: Tables) -> DataFrame:
    return plan.member_cube(aligned(t), "person_id").withColumnRenamed("person_id", "person_id_label")


@query("alignment_monthly_filled", f"""WITH {VOTES_SQL},
kept AS (SELECT * EXCLUDE (d, m), CASE WHEN y = 1999 THEN CAST(d - INTERVAL '12 months' AS DATE) ELSE d END AS d, strftime(CASE WHEN y = 1999 THEN d - INTERVAL '12 months' ELSE d END, '%Y-%m') AS m FROM votes),
spine AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(d)) FROM kept), (SELECT date_trunc('month', max(d)) FROM kept), INTERVAL '1 month')) AS s),
months AS (SELECT m, count(*) FILTER (pro) AS pro, count(*) FILTER (NOT pro) AS "anti", count(*) AS total, count(DISTINCT event_id) AS events FROM kept GROUP BY m)
SELECT strftime(s, '%Y-%m') AS month, coalesce(pro, 0)::BIGINT AS pro, coalesce("anti", 0)::BIGINT AS "anti", coalesce(total, 0)::BIGINT AS total,
 coalesce(events, 0)::BIGINT AS events, (m IS NOT NULL) AS has_rows, pro / CAST(total AS DOUBLE) * 100 AS pct, {PERIOD_SQL.format(d='s')} AS period
FROM spine LEFT JOIN months ON strftime(s, '%Y-%m') = m""")
def alignment_monthly_filled(t: Tables) -> DataFrame:
    """Monthly series, filled. The roll calls of 1999 are dated a year earlier, which leaves a gap."""
    return month_text(plan.monthly_filled(plan.event_tallies(redated(aligned(t), 1999)), PERIODS))


@query("alignment_missing_months", f"""WITH {VOTES_SQL},
months AS (SELECT DISTINCT date_trunc('month', CASE WHEN y = 1997 THEN d - INTERVAL '12 months' ELSE d END) AS s FROM votes)
SELECT strftime(s, '%Y-%m') AS month, coalesce(date_diff('month', lag(s) OVER (ORDER BY s), s) - 1, 0)::BIGINT AS missing_before FROM months""")
def alignment_missing_months(t: Tables) -> DataFrame:
    """Gaps between consecutive months with votes."""
    return month_text(missing_months(redated(aligned(t), 1997).select("month").distinct(), "month"))


@query("group_ranking_top", f"""WITH {VOTES_SQL}
SELECT grp AS group_label, {SUMS_SQL}, {PCT_SQL} FROM votes WHERE period = 'p2' GROUP BY grp HAVING count(*) >= 200
ORDER BY pct DESC, total DESC, grp LIMIT 12""")
def group_ranking_top(t: Tables) -> DataFrame:
    cube = plan.slice_period(plan.member_cube(aligned(t), "group"), "group", "p2")
    return rank_groups(cube, "pct", "total", "group", 200, 12).select(F.col("group").alias("group_label"), "pro", "anti", "total", "pct")


@query("group_ranking_bottom", f"""WITH {VOTES_SQL}
SELECT grp AS group_label, {SUMS_SQL}, {PCT_SQL} FROM votes GROUP BY grp HAVING count(*) >= 200
ORDER BY pct, total, grp LIMIT 12""")
def group_ranking_bottom(t: Tables) -> DataFrame:
    cube = plan.slice_period(plan.member_cube(aligned(t), "group"), "group", None)
    return rank_groups(cube, "pct", "total", "group", 200, 12, bottom=True).select(F.col("group").alias("group_label"), "pro", "anti", "total", "pct")


@query("person_ranking", f"""WITH {VOTES_SQL}
SELECT person_id, {SUMS_SQL}, {PCT_SQL} FROM votes GROUP BY person_id HAVING count(*) >= 20 ORDER BY total DESC, pct DESC, person_id LIMIT 40""")
def person_ranking(t: Tables) -> DataFrame:
    cube = plan.slice_period(plan.member_cube(aligned(t), "person_id"), "person_id", None)
    return cube.filter("total >= 20").orderBy(
        F.col("total").desc(), F.col("pct").desc(), "person_id").limit(40).select("person_id", "pro", "anti", "total", "pct")


@query("recent_events", f"""WITH {VOTES_SQL}
SELECT event_id, CAST(d AS VARCHAR) AS date, period, kind, {SUMS_SQL}, {PCT_SQL}, count(*) FILTER (pro) / CAST(count(*) AS DOUBLE) * 100 < 50 AS lost
FROM votes GROUP BY event_id, d, period, kind ORDER BY d DESC, event_id DESC LIMIT 80""")
def recent_events(t: Tables) -> DataFrame:
    rows = plan.recent_events(plan.event_tallies(aligned(t)), 80)
    return rows.select("event_id", F.col("date").cast("string").alias("date"), "period", "kind", "pro", "anti", "total", "pct", "lost")


@query("slice_period", f"""WITH {VOTES_SQL}
SELECT kind, {SUMS_SQL}, count(DISTINCT event_id) AS events, {PCT_SQL} FROM votes WHERE period = 'p3' GROUP BY kind""")
def slice_period(t: Tables) -> DataFrame:
    """One period of the cube, by kind."""
    cube = plan.time_cube(plan.event_tallies(aligned(t)))
    return cube.filter("grain = 'period_kind' and period = 'p3'").select("kind", "pro", "anti", "total", "events", "pct")


@query("vote_dedupe_first", """SELECT l_orderkey AS event_id, l_suppkey AS person_id, l_linenumber AS line, l_linestatus AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS rn FROM lineitem)
WHERE rn = 1""")
def vote_dedupe_first(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("value"), F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice").alias("row_no"))
    return dedupe_first(rows, ["event_id", "person_id"], "row_no").drop("row_no")


@query("carry_forward_state", """SELECT event_id, user_id, coalesce(last_value(CASE WHEN value >= 50 THEN event_type END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'none') AS state FROM events""")
def carry_forward_state(t: Tables) -> DataFrame:
    """Last known state of a user, where only strong events set one."""
    rows = t.events.select("event_id", "user_id", F.when(F.col("value") >= 50, F.col("event_type")).alias("state"))
    return carry_forward(rows, ["user_id"], ["state"], "event_id", F.floor(F.col("event_id") / 50_000), {"state": "none"})


@query("latest_known_state", """SELECT user_id, coalesce(max_by(event_type, event_id) FILTER (WHERE value >= 50 AND event_type <> 'view'), 'view') AS state
FROM events GROUP BY user_id""")
def latest_known_state(t: Tables) -> DataFrame:
    """Latest state that is not the default."""
    rows = t.events.select("event_id", "user_id", F.when(F.col("value") >= 50, F.col("event_type")).alias("state"))
    return latest_known(rows, ["user_id"], ["state"], "event_id", {"state": "view"})


@query("first_known_state", """SELECT user_id, min_by(event_type, event_id) FILTER (WHERE value >= 50) AS state FROM events GROUP BY user_id""")
def first_known_state(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.when(F.col("value") >= 50, F.col("event_type")).alias("state"))
    return latest_known(rows, ["user_id"], ["state"], "event_id", first=True)


@query("person_directory", f"""WITH {VOTES_SQL}
SELECT person_id, max_by(grp, d) AS group_label FROM votes GROUP BY person_id""")
def person_directory(t: Tables) -> DataFrame:
    rows = aligned(t).withColumn("state", F.lit(plan.NO_STATE))
    return plan.person_directory(rows).select("person_id", F.col("group").alias("group_label"))


@query("alignment_summary", f"""WITH {VOTES_SQL}
SELECT 'all' AS kind, {SUMS_SQL}, count(DISTINCT event_id) AS events, {PCT_SQL} FROM votes WHERE period <> 'other'
UNION ALL SELECT kind, {SUMS_SQL}, count(DISTINCT event_id) AS events, {PCT_SQL} FROM votes GROUP BY kind""")
def alignment_summary(t: Tables) -> DataFrame:
    return plan.summary(plan.event_tallies(aligned(t)))


@query("value_breakdown", """SELECT l_orderkey AS event_id, count(*) FILTER (l_linestatus = 'F')::BIGINT AS f_votes, count(*) FILTER (l_linestatus = 'O')::BIGINT AS o_votes,
 count(*) FILTER (l_linestatus = 'P')::BIGINT AS p_votes FROM lineitem GROUP BY l_orderkey""")
def value_breakdown(t: Tables) -> DataFrame:
    return pivot_counts(t.lineitem.withColumnRenamed("l_orderkey", "event_id"), ["event_id"], "l_linestatus", {"F": "f_votes", "O": "o_votes", "P": "p_votes"})


@query("annotate_present", """SELECT n_name AS group_label, r_name AS note FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND l_quantity >= 50)""")
def annotate_groups(t: Tables) -> DataFrame:
    """Notes only for groups that occur in a result."""
    rows = t.lineitem.filter("l_returnflag = 'R' and l_quantity >= 50").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("group_label"))
    notes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("group_label"), F.col("r_name").alias("note"))
    return annotate_present(rows, notes, "group_label", "note")


@query("export_rows", f"""WITH {VOTES_SQL}
(SELECT 'group' AS row_kind, grp AS label, NULL::VARCHAR AS date, count(*) AS total, {PCT_SQL} FROM votes GROUP BY grp)
UNION ALL (SELECT 'person', CAST(person_id AS VARCHAR), NULL, count(*), {PCT_SQL} FROM votes GROUP BY person_id)
UNION ALL (SELECT 'event', CAST(event_id AS VARCHAR), CAST(d AS VARCHAR), count(*), {PCT_SQL} FROM votes GROUP BY event_id, d ORDER BY d DESC, event_id DESC LIMIT 80)""")
def export_all(t: Tables) -> DataFrame:
    """Groups, persons and recent roll calls in one export, tagged by kind."""
    base = aligned(t)
    groups = plan.slice_period(plan.member_cube(base, "group"), "group", None).select(F.col("group").alias("label"), "total", "pct")
    persons = plan.slice_period(plan.member_cube(base, "person_id"), "person_id", None).select(F.col("person_id").cast("string").alias("label"), "total", "pct")
    recent = plan.recent_events(plan.event_tallies(base), 80).select(
        F.col("event_id").cast("string").alias("label"), F.col("date").cast("string").alias("date"), "total", "pct")
    return export_rows({"group": groups, "person": persons, "event": recent}).select("row_kind", "label", "date", "total", "pct")
