"""Card spending on line items: one line is a transaction of its ship month, open lines are
cash withdrawals, the unit is the supplier's nation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions.dates import month_key
from civisight.functions.money import money
from civisight.operators import lookups, periods, profiles, state, windows
from civisight.plans import cards as plan
from civisight.session import settle

TX_SQL = """tx AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_linestatus = 'O' AS is_cash, n_name AS unit, l_discount
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
months AS (SELECT m, sum(amount) AS total, coalesce(sum(amount) FILTER (is_cash), 0) AS cash, coalesce(sum(amount) FILTER (NOT is_cash), 0) AS purchase, count(*) AS n FROM tx GROUP BY m)"""
TERMS = [
    {"id": "a", "label": "First", "start": "1995-01-01", "end": "1996-12-31"},
    {"id": "b", "label": "Second", "start": "1997-01-01", "end": "1999-08-31"},
    {"id": "c", "label": "Third", "start": "1999-09-01", "end": None},
]
TERM_SQL = "CASE WHEN m <= DATE '1996-12-31' THEN 'First' WHEN m <= DATE '1999-08-31' THEN 'Second' ELSE 'Third' END"
# the running year of the data: January to October, and earlier years with all ten months
WIN_SQL = f"""{TX_SQL}, lst AS (SELECT max(m) AS lm FROM months), cur AS (SELECT m FROM months, lst WHERE year(m) = year(lm)),
w AS (SELECT count(*) AS k FROM cur), yrs AS (SELECT year(m) AS y FROM months, lst, w WHERE month(m) <= k AND year(m) < year(lm) GROUP BY year(m), k HAVING count(*) = k)"""


def transactions(t: Tables) -> DataFrame:
    units = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("unit"))
    return t.lineitem.join(units, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.to_date(F.trunc(F.col("l_shipdate").cast("date"), "month")).alias("month"), money("l_extendedprice").alias("amount"),
        (F.col("l_linestatus") == "O").alias("is_cash"), "unit", F.col("l_discount").alias("discount"))


def months(t: Tables) -> DataFrame:
    return plan.spend_by(transactions(t), "month")


def shown(df: DataFrame, *money_cols: str) -> DataFrame:
    out = df.withColumns({c: F.col(c).cast("double") for c in money_cols})
    return out.withColumn("month", month_key("month")) if "month" in out.columns else out


@query("spend_by_month", f"""WITH {TX_SQL} SELECT strftime(m, '%Y-%m') AS month, total::DOUBLE AS total, cash::DOUBLE AS cash, purchase::DOUBLE AS purchase, n FROM months""")
def spend_by_month(t: Tables) -> DataFrame:
    return shown(months(t), "total", "cash", "purchase")


@query("spend_by_unit", f"""WITH {TX_SQL} SELECT strftime(m, '%Y-%m') AS month, unit, sum(amount)::DOUBLE AS total, coalesce(sum(amount) FILTER (is_cash), 0)::DOUBLE AS cash,
 coalesce(sum(amount) FILTER (NOT is_cash), 0)::DOUBLE AS purchase, count(*) AS n FROM tx GROUP BY m, unit""")
def spend_by_unit(t: Tables) -> DataFrame:
    return shown(plan.spend_by(transactions(t), "month", "unit"), "total", "cash", "purchase")


RATE_SQL = f"""{TX_SQL}, rates AS (SELECT CASE WHEN month(m) = 5 THEN CAST(m + INTERVAL '1 month' AS DATE) ELSE m END AS m, round(sum(l_discount::DECIMAL(10,2))::DOUBLE / count(*) * 10, 4) AS rate FROM tx GROUP BY ALL),
spine AS (SELECT months.m, coalesce(rate, 0) AS rate FROM months LEFT JOIN rates USING (m)),
fac AS (SELECT m, round(coalesce(product(1 + rate / 100) OVER (ORDER BY m ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 6) AS factor FROM spine)"""


def _rates(t: Tables) -> DataFrame:
    mean = F.sum(F.col("discount").cast("decimal(10,2)")).cast("double") / F.count("*")
    month = F.when(F.month("month") == 5, F.add_months("month", 1)).otherwise(F.col("month"))
    return transactions(t).groupBy(month.alias("month")).agg(F.round(mean * 10, 4).alias("rate"))


@query("deflator", f"""WITH {RATE_SQL} SELECT strftime(m, '%Y-%m') AS month, factor FROM fac""")
def deflator(t: Tables) -> DataFrame:
    """Factors to the last month from monthly rates; May is counted into June, so it has none, i.e. zero."""
    return shown(plan.deflators(_rates(t), months(t)).select("month", "factor"))


@query("real_spend", f"""WITH {RATE_SQL} SELECT strftime(m, '%Y-%m') AS month, total::DOUBLE AS total, total::DOUBLE * factor AS total_real FROM months JOIN fac USING (m)""")
def real_spend(t: Tables) -> DataFrame:
    rows = months(t)
    return shown(periods.deflate(rows, plan.deflators(_rates(t), rows), "month", ["total"]), "total").select("month", "total", "total_real")


@query("series_share", f"""WITH {TX_SQL}, a AS (SELECT m, sum(amount) AS v FROM tx WHERE unit = 'NATION_3' GROUP BY m)
SELECT strftime(m, '%Y-%m') AS month, v::DOUBLE AS total, v::DOUBLE / total::DOUBLE AS share FROM a JOIN months USING (m)""")
def series_share(t: Tables) -> DataFrame:
    one = plan.spend_by(transactions(t).filter("unit = 'NATION_3'"), "month").select("month", "total")
    return shown(periods.series_share(one, months(t), "month", "total"), "total")


@query("ytd_window", f"""WITH {WIN_SQL}, past AS (SELECT year(m) AS y, sum(total) AS v FROM months, w WHERE month(m) <= k AND year(m) IN (FROM yrs) GROUP BY year(m)),
c AS (SELECT sum(total)::DOUBLE AS v FROM months WHERE m IN (FROM cur)), b AS (SELECT sum(v)::DOUBLE / count(*) AS mean, count(*) AS n FROM past)
SELECT (SELECT year(lm)::INTEGER FROM lst) AS year, c.v AS current_total, mean AS base_mean, n AS base_years, (c.v - mean) / mean * 100 AS diff_pct FROM c, b""")
def ytd_window(t: Tables) -> DataFrame:
    return periods.ytd_window(months(t), "month", "total")


@query("same_months_years", f"""WITH {WIN_SQL} SELECT year(m)::INTEGER AS year, year(m) = (SELECT year(lm) FROM lst) AS is_current, sum(total)::DOUBLE AS total FROM months, w
WHERE month(m) <= k AND (year(m) IN (FROM yrs) OR m IN (FROM cur)) GROUP BY year(m)""")
def same_months_years(t: Tables) -> DataFrame:
    per = periods.same_months(months(t), "month").groupBy("year", "is_current").agg(F.sum("total").alias("total"))
    return shown(per, "total")


@query("unit_vs_history", f"""WITH {WIN_SQL}, c AS (SELECT unit, sum(amount) AS v FROM tx WHERE m IN (FROM cur) GROUP BY unit ORDER BY v DESC, unit LIMIT 10),
h AS (SELECT unit, sum(amount) AS v FROM tx, w WHERE month(m) <= k AND year(m) IN (FROM yrs) GROUP BY unit)
SELECT unit, c.v::DOUBLE AS current_total, coalesce(h.v, 0)::DOUBLE / greatest((SELECT count(*) FROM yrs), 1) AS history_mean FROM c LEFT JOIN h USING (unit)""")
def unit_vs_history(t: Tables) -> DataFrame:
    return periods.unit_vs_history(plan.spend_by(transactions(t), "month", "unit"), "month", "unit", "total")


@query("split_share", f"""WITH {WIN_SQL} SELECT sum(cash)::DOUBLE AS cash, sum(purchase)::DOUBLE AS purchase, sum(cash)::DOUBLE / sum(cash + purchase)::DOUBLE AS cash_share,
 sum(purchase)::DOUBLE / sum(cash + purchase)::DOUBLE AS purchase_share FROM months WHERE m IN (FROM cur)""")
def split_share(t: Tables) -> DataFrame:
    return periods.split_share(months(t), "month", ["cash", "purchase"])


@query("period_mean", f"""WITH {TX_SQL} SELECT {TERM_SQL} AS period, count(*) AS months, sum(total)::DOUBLE / count(*) AS mean FROM months GROUP BY ALL""")
def period_mean(t: Tables) -> DataFrame:
    rows = plan.by_period(months(t).withColumn("total", F.col("total").cast("decimal(24,2)")), "total", TERMS)
    return rows.select("period", "months", F.round(F.col("mean").cast("double"), 6).alias("mean"))


@query("first_n_cumulative", f"""WITH {TX_SQL}, x AS (SELECT {TERM_SQL} AS period, m, total, row_number() OVER (PARTITION BY {TERM_SQL} ORDER BY m) AS step, sum(total) OVER (PARTITION BY {TERM_SQL} ORDER BY m) AS running FROM months),
k AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM x GROUP BY period))
SELECT period, step::INTEGER AS step, running::DOUBLE AS running FROM x, k WHERE step <= k""")
def first_n_cumulative(t: Tables) -> DataFrame:
    return plan.first_months(months(t), "total", TERMS).select("period", "step", F.col("running").cast("double").alias("running"))


@query("flagged_mean_diff", f"""WITH {TX_SQL}, x AS (SELECT year(m) IN (1996, 2000) AND month(m) BETWEEN 7 AND 10 AS f, total::DOUBLE AS v FROM months),
s AS (SELECT (SELECT sum(total) FROM months WHERE year(m) IN (1996, 2000) AND month(m) BETWEEN 7 AND 10)::DOUBLE / count(*) FILTER (f) AS a,
 (SELECT sum(total) FROM months WHERE NOT (year(m) IN (1996, 2000) AND month(m) BETWEEN 7 AND 10))::DOUBLE / count(*) FILTER (NOT f) AS b FROM x)
SELECT round(a, 4) AS flagged_mean, round(b, 4) AS other_mean, round((a - b) / b * 100, 4) AS diff_pct FROM s""")
def flagged_mean_diff(t: Tables) -> DataFrame:
    """Campaign months against the rest."""
    flag = periods.campaign_month("month", [1996, 2000])
    rows = periods.flagged_mean_diff(months(t), flag, "total")
    return rows.select(*[F.round(c, 4).alias(c) for c in rows.columns])


@query("incremental_months", f"""WITH {TX_SQL}, loads AS (SELECT m, CASE unit WHEN 'NATION_1' THEN 'a1' WHEN 'NATION_2' THEN 'a2' ELSE 'a0' END AS archive, sum(amount) AS v FROM tx
  WHERE m >= DATE '2001-01-01' AND (unit <> 'NATION_2' OR month(m) <= 4) GROUP BY ALL),
win AS (SELECT m, max(archive) AS archive FROM loads GROUP BY m), fresh AS (SELECT m, v FROM loads JOIN win USING (m, archive)),
st AS (SELECT m, sum(amount) AS v FROM tx WHERE m <= DATE '2001-02-01' GROUP BY m)
SELECT strftime(m, '%Y-%m') AS month, v::DOUBLE AS v FROM (SELECT * FROM st WHERE m NOT IN (SELECT m FROM win) UNION ALL FROM fresh) WHERE m BETWEEN DATE '1996-01-01' AND DATE '2001-10-01'""")
def incremental_months(t: Tables) -> DataFrame:
    """New months replace stored ones; of several archives with a month the last is taken whole."""
    tx = transactions(t)
    day = lambda x: F.lit(x).cast("date")
    stored = tx.filter(F.col("month") <= day("2001-02-01")).groupBy("month").agg(F.sum("amount").alias("v"))
    archive = F.when(F.col("unit") == "NATION_1", "a1").when(F.col("unit") == "NATION_2", "a2").otherwise("a0")
    loads = tx.filter((F.col("month") >= day("2001-01-01")) & ((F.col("unit") != "NATION_2") | (F.month("month") <= 4)))
    loads = loads.groupBy("month", archive.alias("archive")).agg(F.sum("amount").alias("v"))
    return shown(state.incremental_by_period(stored, loads, "month", "archive", day("1996-01-01"), day("2001-10-01")), "v")


@query("missing_periods", """WITH spine AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
SELECT month FROM spine WHERE month NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders)""")
def missing_periods(t: Tables) -> DataFrame:
    """Months of the lines that no order month covers."""
    spine = t.lineitem.select(month_key("l_shipdate").alias("month")).distinct()
    return state.missing_periods(spine, t.orders.select(month_key("o_orderdate").alias("month")), "month")


@query("clean_state", """WITH x AS (SELECT coalesce(nullif(trim(CASE WHEN l_returnflag = 'N' THEN '  ' ELSE l_returnflag END), ''), 'unknown') AS name, l_quantity::INTEGER AS month, CAST(l_extendedprice AS DECIMAL(20,2)) AS v FROM lineitem)
SELECT name, month, sum(v)::DOUBLE AS v FROM x WHERE month BETWEEN 1 AND 12 GROUP BY ALL""")
def clean_state(t: Tables) -> DataFrame:
    """Repair of a stored state: months 1-12 only, blank names, amounts re-summed."""
    rows = t.lineitem.select(
        F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("name"), F.col("l_quantity").cast("int").alias("month"), money("l_extendedprice").alias("v"))
    out = profiles.clean_state(rows, "name", "month", ["v"], "unknown")
    return out.withColumn("v", F.col("v").cast("double"))


@query("spend_periods", f"""WITH {TX_SQL} SELECT {TERM_SQL} AS period, sum(total)::DOUBLE AS total FROM months GROUP BY ALL""")
def spend_periods(t: Tables) -> DataFrame:
    """Totals per term through a table of intervals instead of a rule list."""
    spark = t.spark
    table = spark.createDataFrame([(i, p["label"], p["start"], p["end"]) for i, p in enumerate(TERMS)], "ordinal int, period string, s string, e string")
    table = table.select("ordinal", "period", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    rows = months(t)
    horizon = rows.agg(F.max("month")).scalar()
    joined = lookups.interval_join(rows, "month", table, "s", "e", "ordinal", "period", "other", horizon)
    return shown(joined.groupBy("period").agg(F.sum("total").alias("total")), "total")


ROLE_SQL = """own AS (SELECT o_custkey AS k, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) END AS e, o_orderpriority AS role FROM orders),
fact AS (SELECT o_custkey AS k, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query("keyed_periods", f"""WITH {ROLE_SQL}, hit AS (SELECT a.k, d, arg_min(role, ord) AS role FROM (SELECT DISTINCT k, d FROM fact) a JOIN own ON own.k = a.k AND d BETWEEN s AND coalesce(e, DATE '9999-01-01') GROUP BY ALL)
SELECT l_orderkey, l_linenumber, coalesce(role, 'none') AS role FROM fact LEFT JOIN hit USING (k, d)""")
def keyed_periods(t: Tables) -> DataFrame:
    """Each line by the first of its customer's own, overlapping and partly open, intervals that holds its day."""
    start = F.col("o_orderdate").cast("date")
    own = t.orders.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), start.alias("s"),
        F.when(F.col("o_orderkey") % 3 > 0, F.date_add(start, (F.col("o_orderkey") % 900).cast("int"))).alias("e"), F.col("o_orderpriority").alias("role"))
    facts = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")), "l_orderkey")
    facts = settle(facts.select("l_orderkey", "l_linenumber", "l_shipdate", "k"))  # days are looked up and given back
    horizon = t.lineitem.agg(F.max(F.col("l_shipdate").cast("date"))).scalar()
    return lookups.interval_join(facts, "l_shipdate", own, "s", "e", "ord", "role", "none", horizon, keys=["k"]).select("l_orderkey", "l_linenumber", "role")


@query("running_total_months", f"""WITH {TX_SQL} SELECT strftime(m, '%Y-%m') AS month, sum(total) OVER (ORDER BY m)::DOUBLE AS running FROM months""")
def running_total_months(t: Tables) -> DataFrame:
    rows = windows.running_sum(months(t).select("month", "total"), "month", {"total": "running"})
    return shown(rows, "running").select("month", "running")
