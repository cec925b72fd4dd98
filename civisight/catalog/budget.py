"""Spending amendments on line items: the author is the supplier, the place its nation, the
document date the ship date; returned lines are what was paid."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions.money import money
from civisight.operators import concentration, lookups, periods, ranking, rollups, state, windows
from civisight.plans import budget as plan

DOC_SQL = """doc AS (SELECT CAST(l_shipdate AS DATE) AS d, s_name AS author, n_name AS place, CAST(l_extendedprice AS DECIMAL(20,2)) AS committed,
 CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(20,2)) ELSE 0 END AS paid
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def documents(t: Tables) -> DataFrame:
    who = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("author"), F.col("n_name").alias("place"))
    amount = money("l_extendedprice")
    return t.lineitem.join(who, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_shipdate").cast("date").alias("date"), F.year("l_shipdate").alias("year"), "author", "place", amount.alias("committed"),
        F.when(F.col("l_returnflag") == "R", amount).otherwise(F.lit(0).cast("decimal(20,2)")).alias("paid"))


def doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def day_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


@query("budget_totals", f"""WITH {DOC_SQL}
SELECT CASE WHEN grouping(author)=0 AND grouping(place)=0 THEN 'author_place' WHEN grouping(author)=0 THEN 'author' WHEN grouping(place)=0 THEN 'place' ELSE 'all' END AS grain,
 author, place, sum(committed)::DOUBLE AS committed, sum(paid)::DOUBLE AS paid, coalesce(sum(committed) FILTER (year(d) = 2000), 0)::DOUBLE AS committed_year,
 coalesce(sum(paid) FILTER (year(d) = 2000), 0)::DOUBLE AS paid_year
FROM doc WHERE committed <> 0 GROUP BY GROUPING SETS ((), (author), (place), (author, place))""")
def budget_totals(t: Tables) -> DataFrame:
    return doubles(plan.budget_totals(documents(t), 2000), "committed", "paid", "committed_year", "paid_year")


@query("budget_top_authors", f"""WITH {DOC_SQL} SELECT author, sum(committed)::DOUBLE AS committed FROM doc GROUP BY author ORDER BY sum(committed) DESC, author LIMIT 20""")
def budget_top_authors(t: Tables) -> DataFrame:
    totals = documents(t).groupBy("author").agg(F.sum("committed").alias("committed"))
    return doubles(ranking.top_n(totals, "committed", "author", 20), "committed")


@query("last_day_totals", f"""WITH {DOC_SQL} SELECT author, place, sum(committed)::DOUBLE AS committed FROM doc WHERE d = (SELECT max(d) FROM doc) AND committed > 0 GROUP BY ALL""")
def last_day_totals(t: Tables) -> DataFrame:
    return doubles(plan.last_day(documents(t), "author", "place"), "committed")


@query("daily_cumulative", f"""WITH {DOC_SQL}, days AS (SELECT d, sum(committed) AS c, sum(paid) AS p FROM doc GROUP BY d),
spine AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('year', min(d)) FROM days), (SELECT max(d)::TIMESTAMP FROM days), INTERVAL '1 day')) AS DATE) AS s)
SELECT CAST(s AS VARCHAR) AS day, year(s)::INTEGER AS year, coalesce(c, 0)::DOUBLE AS committed, coalesce(p, 0)::DOUBLE AS paid,
 sum(coalesce(c, 0)) OVER (PARTITION BY year(s) ORDER BY s)::DOUBLE AS committed_running, sum(coalesce(p, 0)) OVER (PARTITION BY year(s) ORDER BY s)::DOUBLE AS paid_running
FROM spine LEFT JOIN days ON s = d""")
def daily_cumulative(t: Tables) -> DataFrame:
    rows = day_text(plan.daily_series(documents(t)), "day")
    return doubles(rows, "committed", "paid", "committed_running", "paid_running")


CUT, BEFORE = "2001-06-30", "2001-03-31"
SNAP_SQL = f"""{DOC_SQL}, cur AS (SELECT author, place, sum(committed) AS v FROM doc WHERE d <= DATE '{CUT}' GROUP BY ALL),
prev AS (SELECT author, place, sum(committed) AS v FROM doc WHERE d <= DATE '{BEFORE}' AND author <> 'Supplier#000000003' GROUP BY ALL)"""


def _snapshots(t: Tables, *keys: str) -> tuple[DataFrame, DataFrame]:
    rows = documents(t)
    now = rows.filter(F.col("date") <= F.lit(CUT).cast("date"))
    old = rows.filter((F.col("date") <= F.lit(BEFORE).cast("date")) & (F.col("author") != "Supplier#000000003"))
    return tuple(x.groupBy(*keys).agg(F.sum("committed").alias("committed")) for x in (now, old))


@query("snapshot_growth", f"""WITH {SNAP_SQL}, c AS (SELECT author, sum(v) AS v FROM cur GROUP BY author), p AS (SELECT author, sum(v) AS v FROM prev GROUP BY author),
x AS (SELECT author, c.v AS committed, coalesce(p.v, 0) AS previous, c.v - coalesce(p.v, 0) AS delta FROM c LEFT JOIN p USING (author))
SELECT author, committed::DOUBLE AS committed, previous::DOUBLE AS previous, delta::DOUBLE AS delta,
 delta::DOUBLE / (SELECT sum(delta) FROM x WHERE delta > 0.005)::DOUBLE AS share FROM x WHERE delta > 0.005 ORDER BY x.delta DESC, author LIMIT 20""")
def snapshot_growth(t: Tables) -> DataFrame:
    """Authors that grew most between two cut-off dates."""
    now, old = _snapshots(t, "author")
    return doubles(ranking.top_n(plan.growth(now, old, ["author"]), "delta", "author", 20), "committed", "previous", "delta")


@query("growth_pairs", f"""WITH {SNAP_SQL} SELECT author, place, cur.v::DOUBLE AS committed, coalesce(prev.v, 0)::DOUBLE AS previous, (cur.v - coalesce(prev.v, 0))::DOUBLE AS delta
FROM cur LEFT JOIN prev USING (author, place) WHERE cur.v - coalesce(prev.v, 0) > 0.005 ORDER BY cur.v - coalesce(prev.v, 0) DESC, author, place LIMIT 50""")
def growth_pairs(t: Tables) -> DataFrame:
    now, old = _snapshots(t, "author", "place")
    rows = plan.growth(now, old, ["author", "place"]).drop("share")
    return doubles(ranking.top_n(rows, "delta", ["author", "place"], 50), "committed", "previous", "delta")


@query("growth_totals", f"""WITH {SNAP_SQL}, c AS (SELECT author, sum(v) AS v FROM cur GROUP BY author), p AS (SELECT author, sum(v) AS v FROM prev GROUP BY author),
x AS (SELECT coalesce(p.v, 0) - coalesce(c.v, 0) AS delta FROM p FULL JOIN c USING (author))
SELECT coalesce(sum(delta) FILTER (delta > 0.005), 0)::DOUBLE AS positive, coalesce(sum(delta) FILTER (delta < -0.005), 0)::DOUBLE AS negative, count(*) FILTER (delta > 0.005) AS keys_up FROM x""")
def growth_totals(t: Tables) -> DataFrame:
    """The same snapshots the other way round, so that keys vanish: full-outer form."""
    now, old = _snapshots(t, "author")
    return plan.growth_totals(lookups.snapshot_diff(old, now, ["author"], "committed", include_vanished=True))


SUP_SQL = """sup AS (SELECT p_brand AS supporter, s_name AS author, CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END AS committed,
 CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(20,2)) ELSE 0 END AS paid
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT supporter, author, sum(committed) FILTER (committed > 0) AS c, sum(paid) FILTER (paid > 0) AS p FROM sup GROUP BY ALL),
tot AS (SELECT supporter, sum(c) AS committed, sum(p) AS paid, count(*) AS authors_count FROM pairs GROUP BY supporter)"""


def _support(t: Tables) -> DataFrame:
    amount, zero = money("l_extendedprice"), F.lit(0).cast("decimal(20,2)")
    parts = t.part.select("p_partkey", F.col("p_brand").alias("supporter"))
    names = t.supplier.select("s_suppkey", F.col("s_name").alias("author"))
    return t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "supporter", "author", F.when(F.col("l_returnflag") == "N", zero).otherwise(amount).alias("committed"),
        F.when(F.col("l_returnflag") == "R", amount).otherwise(zero).alias("paid"))


@query("supporter_profile", f"""WITH {SUP_SQL}, best AS (SELECT *, committed::DOUBLE / (SELECT sum(committed) FROM tot)::DOUBLE AS share FROM tot WHERE committed IS NOT NULL ORDER BY tot.committed DESC, supporter LIMIT 20),
r AS (SELECT *, row_number() OVER (PARTITION BY supporter ORDER BY c DESC, author) AS rn FROM pairs WHERE c IS NOT NULL)
SELECT best.supporter, committed::DOUBLE AS committed, paid::DOUBLE AS paid, authors_count, share, author AS top_author, c::DOUBLE AS top_committed
FROM best JOIN r ON best.supporter = r.supporter WHERE rn <= 3""")
def supporter_profile(t: Tables) -> DataFrame:
    """Nested top authors, exploded for comparison."""
    rows = concentration.supporter_profile(_support(t), "supporter", "author", "committed", "paid")
    rows = rows.select("supporter", F.col("committed").cast("double").alias("committed"), F.col("paid").cast("double").alias("paid"), "authors_count", "share", F.explode("top_authors").alias("a"))
    return rows.select("supporter", "committed", "paid", "authors_count", "share", F.col("a.author").alias("top_author"), F.col("a.committed").alias("top_committed"))


@query("supporter_groups", f"""WITH {SUP_SQL} SELECT CASE WHEN contains(supporter, '#1') THEN 'Bancada' ELSE 'Parlamentar' END AS "group", sum(c)::DOUBLE AS committed FROM pairs GROUP BY ALL""")
def supporter_groups(t: Tables) -> DataFrame:
    """Role groups of supporters by name rules."""
    named = F.when(F.col("supporter").contains("#1"), F.concat(F.lit("Bancada "), F.col("supporter"))).otherwise(F.col("supporter"))
    rows = _support(t).withColumn("supporter", named).filter("committed > 0")
    out = rows.groupBy("supporter").agg(F.sum("committed").alias("committed")).groupBy(plan.supporter_group("supporter").alias("group")).agg(F.sum("committed").alias("committed"))
    return doubles(out, "committed")


@query("top_share", f"""WITH {SUP_SQL}, r AS (SELECT committed, row_number() OVER (ORDER BY committed DESC, supporter) AS rn FROM tot WHERE committed IS NOT NULL)
SELECT sum(committed)::DOUBLE AS total, (sum(committed) FILTER (rn <= 1))::DOUBLE / sum(committed)::DOUBLE AS top1_share, (sum(committed) FILTER (rn <= 5))::DOUBLE / sum(committed)::DOUBLE AS top5_share FROM r""")
def top_share(t: Tables) -> DataFrame:
    totals = _support(t).filter("committed > 0").groupBy("supporter").agg(F.sum("committed").alias("committed"))
    return concentration.top_share(totals, "supporter", "committed")


@query("author_party", """SELECT s_name AS author, CASE WHEN s_suppkey < 10 THEN 'Bancada' WHEN s_acctbal < 0 THEN 'Nao identificado' WHEN n_nationkey < 5 THEN n_name ELSE r_name END AS party
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def author_party(t: Tables) -> DataFrame:
    """Lookup with role rules first and two sources, of which the first that knows the author wins."""
    from civisight import rules

    base = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    first = base.filter("n_nationkey < 5 and s_acctbal >= 0").select(F.col("s_name").alias("name"), F.col("n_name").alias("party"))
    second = base.filter("s_acctbal >= 0").select(F.col("s_name").alias("name"), F.col("r_name").alias("party"))
    tests = [(F.col("s_suppkey") < 10, rules.ROLE_BENCH)]
    return lookups.lookup(base.select("s_suppkey", F.col("s_name").alias("author")), "author", [first, second], "name", "party", rules.UNKNOWN_PARTY, tests).select("author", "party")


@query("author_roles", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Bancada' WHEN '2-HIGH' THEN 'Comissao' WHEN '3-MEDIUM' THEN 'Relatoria' ELSE o_orderstatus END AS party FROM orders""")
def author_roles(t: Tables) -> DataFrame:
    """Name-based role rules in front of a member list."""
    author = F.when(F.col("o_orderpriority") == "1-URGENT", "Bancada do Norte").when(F.col("o_orderpriority") == "2-HIGH", "Com. de Saúde").when(
        F.col("o_orderpriority") == "3-MEDIUM", "Relator-Geral").otherwise(F.concat(F.lit("Member "), F.col("o_orderstatus")))
    rows = t.orders.select("o_orderkey", author.alias("author"))
    members = t.orders.select(F.concat(F.lit("member "), F.col("o_orderstatus")).alias("name"), F.col("o_orderstatus").alias("party")).distinct()
    return plan.with_party(rows, [members]).select("o_orderkey", "party")


DAYS_SQL = f"{DOC_SQL}, days AS (SELECT d, sum(committed) AS v FROM doc WHERE year(d) = 1998 GROUP BY d)"


def _days(t: Tables) -> DataFrame:
    return documents(t).filter("year = 1998").groupBy(F.col("date").alias("day")).agg(F.sum("committed").alias("v"))


@query("peak_day", f"""WITH {DAYS_SQL} SELECT CAST(d AS VARCHAR) AS peak_day, v::DOUBLE AS peak_value, v::DOUBLE / (SELECT sum(v) FROM days)::DOUBLE AS peak_share FROM days ORDER BY v DESC, d LIMIT 1""")
def peak_day(t: Tables) -> DataFrame:
    return day_text(periods.peak_day(_days(t), "day", "v"), "peak_day")


@query("peak_week", f"""WITH {DAYS_SQL}, w AS (SELECT strftime(d, '%G-W%V') AS week, sum(v) AS total FROM days GROUP BY ALL),
s AS (SELECT max(total) AS mx, sum(total) AS sm, count(*) AS n, first(week ORDER BY total DESC, week) AS week FROM w)
SELECT week, mx::DOUBLE AS week_total, (sm - mx)::DOUBLE / (n - 1) AS others_mean, mx::DOUBLE / ((sm - mx)::DOUBLE / (n - 1)) AS times_mean FROM s""")
def peak_week(t: Tables) -> DataFrame:
    return periods.peak_week(_days(t), "day", "v")


@query("top_days", f"""WITH {DAYS_SQL} SELECT CAST(d AS VARCHAR) AS day, v::DOUBLE AS v, v::DOUBLE / (SELECT sum(v) FROM days)::DOUBLE AS share FROM days ORDER BY days.v DESC, d LIMIT 12""")
def top_days(t: Tables) -> DataFrame:
    rows = ranking.top_n(windows.share_of_total(_days(t), "v"), "v", "day", 12)
    return doubles(day_text(rows, "day"), "v")


@query("reconcile_sources", """WITH a AS (SELECT year(l_shipdate)::INTEGER AS year, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS a FROM lineitem GROUP BY ALL),
b AS (SELECT year(o_orderdate)::INTEGER AS year, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS b FROM orders GROUP BY ALL),
x AS (SELECT year, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM a FULL JOIN b USING (year)), y AS (SELECT *, abs(a - b) / greatest(a, b) AS pct FROM x)
SELECT year, a - b AS diff, pct, CASE WHEN a = 0 OR b = 0 THEN 'unavailable' WHEN pct <= 0.02 THEN 'match' WHEN pct <= 0.05 THEN 'moderate' ELSE 'diverge' END AS verdict FROM y""")
def reconcile_sources(t: Tables) -> DataFrame:
    """Two sources of the same total, per year."""
    a = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.sum(money("l_extendedprice")).alias("a"))
    b = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.sum(money("o_totalprice")).alias("b"))
    both = a.join(b, "year", "full").fillna(0)
    return both.select("year", lookups.reconcile("a", "b").alias("r")).select("year", "r.*")


@query("trailing_zero_run", f"""WITH {DOC_SQL}, x AS (SELECT d, sum(CASE WHEN d > DATE '2001-10-20' THEN 0 ELSE committed END) AS v FROM doc GROUP BY d)
SELECT count(*) AS trailing_run FROM x WHERE d > (SELECT max(d) FROM x WHERE v <> 0)""")
def trailing_zero_run(t: Tables) -> DataFrame:
    """Days in a row up to the last on which a source gave only zeros."""
    value = F.when(F.col("date") > F.lit("2001-10-20").cast("date"), F.lit(0)).otherwise(F.col("committed"))
    history = documents(t).groupBy("date").agg(F.sum(value).alias("v"))
    return plan.broken_days(history, "date", ["v"])


@query("all_or_nothing_sum", f"""WITH {DOC_SQL}, f AS (SELECT author, sum(committed) AS committed, sum(paid) AS paid, sum(paid) > 0 AS ok FROM doc GROUP BY author)
SELECT bool_and(ok) AND sum(committed) > 0 AS accepted, CASE WHEN bool_and(ok) THEN sum(committed)::DOUBLE END AS committed, CASE WHEN bool_and(ok) THEN sum(paid)::DOUBLE END AS paid FROM f""")
def all_or_nothing_sum(t: Tables) -> DataFrame:
    """Totals over filters, accepted only when all of them worked."""
    per = documents(t).groupBy("author").agg(F.sum("committed").alias("committed"), F.sum("paid").alias("paid")).withColumn("ok", F.col("paid") > 0)
    return doubles(rollups.all_or_nothing_sum(per, "ok", ["committed", "paid"], "committed"), "committed", "paid")


@query("execution_and_staleness", """WITH x AS (SELECT o_orderkey AS key, sum(CAST(l_extendedprice AS DECIMAL(20,2)))::DOUBLE AS spent, max(o_totalprice) AS authorised, max(CAST(l_shipdate AS DATE)) AS updated
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT key, CASE WHEN authorised > 0 THEN spent / authorised ELSE 0 END AS execution_rate,
 CASE WHEN DATE '2001-11-05' - updated <= 2 THEN 'fresh' WHEN DATE '2001-11-05' - updated <= 5 THEN 'late' ELSE 'stale' END AS age FROM x""")
def execution_and_staleness(t: Tables) -> DataFrame:
    spent = t.lineitem.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("spent"), F.max(F.col("l_shipdate").cast("date")).alias("updated"))
    rows = spent.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("key"), periods.execution_rate("spent", "o_totalprice").alias("execution_rate"),
        periods.staleness("updated", dt.date(2001, 11, 5)).alias("age"))


@query("snapshot_fallback", """WITH cur AS (SELECT n_name AS source, sum(s_acctbal::DECIMAL(20,2))::DOUBLE AS v, count(*) >= 4 AS ok FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
prev AS (SELECT n_name AS source, sum(c_acctbal::DECIMAL(20,2))::DOUBLE AS v, count(*) >= 60 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT source, CASE WHEN NOT cur.ok AND coalesce(prev.ok, false) THEN prev.v ELSE cur.v END AS v, cur.ok OR coalesce(prev.ok, false) AS available,
 NOT cur.ok AND coalesce(prev.ok, false) AS fallback_from_previous FROM cur LEFT JOIN prev USING (source)""")
def snapshot_fallback(t: Tables) -> DataFrame:
    """A source without a usable payload keeps its previous one, flagged."""
    def payload(rows, nation, balance, floor):
        named = rows.join(t.nation, F.col(nation) == F.col("n_nationkey"))
        return named.groupBy(F.col("n_name").alias("source")).agg(F.sum(money(balance)).cast("double").alias("v"), (F.count("*") >= floor).alias("available"))
    return lookups.coalesce_snapshot(payload(t.supplier, "s_nationkey", "s_acctbal", 4), payload(t.customer, "c_nationkey", "c_acctbal", 60), "source")


@query("override_metric", """WITH d AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(20,2)))::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey AS key, coalesce(v, o_totalprice) AS spent, o_totalprice AS spent_declared FROM orders LEFT JOIN d ON k = o_orderkey""")
def override_metric(t: Tables) -> DataFrame:
    """Totals by document replace the declared ones where there are documents."""
    base = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("spent"))
    better = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(money("l_extendedprice")).cast("double").alias("spent"))
    return lookups.override_metric(base, better, "key", ["spent"])


@query("history_upsert", f"""WITH {DOC_SQL}, h AS (SELECT d, sum(committed) AS v FROM doc GROUP BY d), last AS (SELECT max(d) AS d FROM h),
n AS (SELECT CASE WHEN d = (SELECT d FROM last) THEN 0 ELSE v END AS v, d FROM h)
SELECT CAST(d AS VARCHAR) AS date, v::DOUBLE AS v FROM n""")
def history_upsert(t: Tables) -> DataFrame:
    """A new row replaces the one of the same date; all other dates stay."""
    history = documents(t).groupBy("date").agg(F.sum("committed").alias("v"))
    row = history.agg(F.max("date").alias("date")).withColumn("v", F.lit(0).cast("decimal(30,2)"))
    return doubles(day_text(state.history_upsert(history, row, "date"), "date"), "v")


@query("snapshot_gap", f"""WITH {DOC_SQL}, h AS (SELECT DISTINCT d FROM doc WHERE committed > 104000)
SELECT CAST(d AS VARCHAR) AS date, CAST(lag(d) OVER (ORDER BY d) AS VARCHAR) AS previous, coalesce(d - lag(d) OVER (ORDER BY d), 0)::INTEGER AS interval_days FROM h""")
def snapshot_gap(t: Tables) -> DataFrame:
    """Dates with a very large document, each with the one before."""
    dates = documents(t).filter("committed > 104000").select("date").distinct()
    return day_text(windows.with_gap(dates, "date"), "date", "previous")
