"""Requests on orders: the body is the customer's nation, the requester the customer, the
decision the order status, the reason the priority."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight import rules
from civisight.catalog.base import Tables, query
from civisight.operators import classify, concentration, lookups, periods, profiles, ranking, rollups
from civisight.operators.search import facet_filter
from civisight.plans import requests as plan
from civisight.session import settle

REQ_SQL = """req AS (SELECT o_orderkey AS id, o_custkey AS requester, n_name AS body, r_name AS theme, year(o_orderdate)::INTEGER AS year,
  month(o_orderdate)::INTEGER AS month, o_orderstatus AS decision, o_orderpriority AS reason,
  o_orderstatus = 'F' AS is_denied, o_orderstatus IN ('F','P') AS is_restricted, o_orderstatus IN ('F','P') AND o_orderpriority = '1-URGENT' AS is_personal
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CNT = """count(*) AS total, count(*) FILTER (is_denied) AS denied, count(*) FILTER (is_restricted) AS restricted, count(*) FILTER (is_personal) AS personal"""


def requests(t: Tables) -> DataFrame:
    bodies = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("body"), F.col("r_name").alias("theme"))
    rows = t.orders.join(bodies, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("requester"), "body", "theme", F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"), F.col("o_orderstatus").alias("decision"), F.col("o_orderpriority").alias("reason"))
    return plan.with_masks(rows, F.col("decision") == "F", F.col("decision").isin("F", "P"), F.col("reason") == "1-URGENT")


def by(t: Tables, *keys: str) -> DataFrame:
    """Counters per key, aggregated straight from the facts."""
    return requests(t).groupBy(*keys).agg(*[c.alias(n) for n, c in plan.mask_counts().items()])


@query("request_counts", f"""WITH {REQ_SQL}
SELECT CASE WHEN grouping(decision)=0 THEN 'body_theme_decision' WHEN grouping(body)=0 AND grouping(month)=0 THEN 'body_month'
  WHEN grouping(theme)=0 AND grouping(month)=0 THEN 'theme_month' WHEN grouping(body)=0 AND grouping(theme)=0 THEN 'body_theme'
  WHEN grouping(body)=0 THEN 'body' WHEN grouping(theme)=0 THEN 'theme' WHEN grouping(month)=0 THEN 'month' ELSE 'year' END AS grain,
 year, month, body, theme, decision, {CNT}
FROM req GROUP BY GROUPING SETS ((year), (year, month), (year, body), (year, theme), (year, body, month), (year, theme, month), (year, body, theme), (year, body, theme, decision))""")
def request_counts(t: Tables) -> DataFrame:
    return plan.request_counts(requests(t))


@query("request_year_rates", f"""WITH {REQ_SQL}, c AS (SELECT year, {CNT} FROM req GROUP BY year)
SELECT *, denied / total::DOUBLE AS denied_rate, restricted / total::DOUBLE AS restricted_rate, personal / total::DOUBLE AS personal_rate,
 CASE WHEN restricted > 0 THEN personal / restricted::DOUBLE ELSE 0 END AS personal_in_restricted FROM c""")
def request_year_rates(t: Tables) -> DataFrame:
    return plan.with_rates(by(t, "year"))


@query("merge_partials", f"""WITH {REQ_SQL} SELECT body, {CNT} FROM req GROUP BY body""")
def merge_partials(t: Tables) -> DataFrame:
    """Whole-series body counters, put together from yearly partials."""
    return plan.over_years(by(t, "year", "body"), "body")


@query("request_monthly_grid", f"""WITH {REQ_SQL}, c AS (SELECT year, month, {CNT} FROM (SELECT * REPLACE (CASE WHEN month = 2 THEN 1 ELSE month END AS month) FROM req) GROUP BY ALL),
grid AS (SELECT DISTINCT year, unnest(range(1, 13))::INTEGER AS month FROM c)
SELECT year, month, coalesce(total, 0)::BIGINT AS total, coalesce(denied, 0)::BIGINT AS denied, coalesce(restricted, 0)::BIGINT AS restricted,
 coalesce(personal, 0)::BIGINT AS personal, coalesce(denied / total::DOUBLE, 0) AS denied_rate, coalesce(restricted / total::DOUBLE, 0) AS restricted_rate,
 coalesce(personal / total::DOUBLE, 0) AS personal_rate, coalesce(CASE WHEN restricted > 0 THEN personal / restricted::DOUBLE END, 0) AS personal_in_restricted
FROM grid LEFT JOIN c USING (year, month)""")
def request_monthly_grid(t: Tables) -> DataFrame:
    """Twelve months per year; the input dates February to January, so that it has to be filled."""
    rows = requests(t).withColumn("month", F.when(F.col("month") == 2, 1).otherwise(F.col("month")))
    return plan.monthly_grid(plan.request_counts(rows, {"month": ["year", "month"]}))


@query("restricted_reason_counts", f"""WITH {REQ_SQL} SELECT year, reason, count(*) AS n FROM req WHERE is_restricted GROUP BY ALL""")
def restricted_reason_counts(t: Tables) -> DataFrame:
    return rollups.value_counts(requests(t), ["year", "reason"], F.col("is_restricted"))


@query("topk_reasons_with_other", f"""WITH {REQ_SQL}, r AS (SELECT year, reason, count(*) AS n FROM req WHERE is_restricted GROUP BY ALL),
top AS (SELECT reason FROM r GROUP BY reason ORDER BY sum(n) DESC, reason LIMIT 3),
tot AS (SELECT year, count(*) AS restricted FROM req WHERE is_restricted GROUP BY year),
f AS (SELECT year, CASE WHEN reason IN (SELECT reason FROM top) THEN reason ELSE 'other' END AS reason, sum(n) AS n FROM r GROUP BY ALL),
grid AS (SELECT year, l.reason FROM tot CROSS JOIN (SELECT reason FROM top UNION SELECT 'other') l)
SELECT year, reason, coalesce(n, 0)::BIGINT AS count, coalesce(n, 0) / restricted::DOUBLE AS share FROM grid JOIN tot USING (year) LEFT JOIN f USING (year, reason)""")
def topk_reasons_with_other(t: Tables) -> DataFrame:
    base = requests(t)
    totals = base.filter("is_restricted").groupBy("year").agg(F.count("*").alias("restricted"))
    counts = rollups.value_counts(base, ["year", "reason"], F.col("is_restricted"))
    return ranking.topk_with_other(counts, "year", "reason", "n", 3, "other", totals, "restricted")


@query("topk_themes_with_other", f"""WITH {REQ_SQL}, r AS (SELECT year, body AS theme, {CNT} FROM req GROUP BY ALL),
top AS (SELECT theme FROM r GROUP BY theme ORDER BY sum(total) DESC, theme LIMIT 7),
tot AS (SELECT year, count(*) AS all_rows FROM req GROUP BY year),
f AS (SELECT year, CASE WHEN theme IN (SELECT theme FROM top) THEN theme ELSE 'NATION_3' END AS label, sum(total) AS n,
  sum(restricted) FILTER (theme IN (SELECT theme FROM top) OR theme = 'NATION_3') AS r FROM r GROUP BY ALL),
grid AS (SELECT year, l.theme FROM tot CROSS JOIN (SELECT theme FROM top UNION SELECT 'NATION_3') l)
SELECT year, grid.theme, coalesce(n, 0)::BIGINT AS count, coalesce(r, 0)::BIGINT AS restricted_count, CASE WHEN n > 0 THEN coalesce(r, 0) / n::DOUBLE ELSE 0 END AS restricted_rate,
 coalesce(n, 0) / all_rows::DOUBLE AS share FROM grid JOIN tot USING (year) LEFT JOIN f ON f.year = grid.year AND f.label = grid.theme""")
def topk_themes_with_other(t: Tables) -> DataFrame:
    """The rest is a label of the data itself and keeps its own restricted count."""
    counts = by(t, "year", "body").withColumnRenamed("body", "theme")
    totals = by(t, "year").select("year", F.col("total").alias("all_rows"))
    return ranking.topk_with_other(counts, "year", "theme", "total", 7, "NATION_3", totals, "all_rows", restricted="restricted")


@query("body_profile_nested", f"""WITH {REQ_SQL}, i AS (SELECT body, reason, count(*) AS item_total, count(*) FILTER (is_restricted) AS item_restricted,
  row_number() OVER (PARTITION BY body ORDER BY count(*) DESC, reason) AS item_rank FROM req GROUP BY body, reason),
d AS (SELECT body, reason, decision, count(*) AS detail_total, row_number() OVER (PARTITION BY body, reason ORDER BY count(*) DESC, decision) AS detail_rank
  FROM req GROUP BY body, reason, decision)
SELECT body, reason, item_total, item_restricted, item_rank::INTEGER AS item_rank, decision, detail_total, detail_rank::INTEGER AS detail_rank,
 item_restricted / item_total::DOUBLE AS item_restricted_rate, detail_total / item_total::DOUBLE AS share_in_item
FROM i JOIN d USING (body, reason) WHERE item_rank <= 4 AND detail_rank <= 2""")
def body_profile_nested(t: Tables) -> DataFrame:
    """Largest reasons per body and the largest decisions in each, exploded."""
    counts = by(t, "body", "reason", "decision")
    return ranking.nested_profile(counts, "body", "reason", "decision", "total", "restricted", items=4, details=2)


@query("samples_per_group", f"""WITH {REQ_SQL}, x AS (SELECT body, reason, decision AS text_excerpt, id, row_number() OVER (PARTITION BY body, reason, decision ORDER BY id) AS a FROM req WHERE is_restricted),
y AS (SELECT *, row_number() OVER (PARTITION BY body, reason ORDER BY id) AS b FROM x WHERE a = 1)
SELECT body, reason, text_excerpt, id, b::INTEGER AS sample_no FROM y WHERE b <= 2""")
def samples_per_group(t: Tables) -> DataFrame:
    """Up to two examples per (body, reason) with different text."""
    rows = requests(t).filter("is_restricted").select("body", "reason", F.col("decision").alias("text_excerpt"), "id")
    return ranking.sample_per_group(rows, ["body", "reason"], "text_excerpt", "id", 2)


@query("body_ranking", f"""WITH {REQ_SQL} SELECT body, {CNT} FROM req GROUP BY body ORDER BY denied DESC, restricted DESC, total DESC, body LIMIT 10""")
def body_ranking(t: Tables) -> DataFrame:
    order = [F.col("denied").desc(), F.col("restricted").desc(), F.col("total").desc(), F.col("body")]
    return ranking.rank_rows(by(t, "body"), order, 10)


@query("low_rate_ranking", f"""WITH {REQ_SQL} SELECT body, {CNT}, count(*) FILTER (is_denied) / count(*)::DOUBLE AS denied_rate FROM req GROUP BY body HAVING count(*) >= 500
ORDER BY denied_rate, total DESC, body LIMIT 15""")
def low_rate_ranking(t: Tables) -> DataFrame:
    rows = rollups.rates(by(t, "body"), {"denied_rate": ("denied", "total")})
    return ranking.rank_rows(rows, [F.col("denied_rate"), F.col("total").desc(), F.col("body")], 15, F.col("total") >= 500)


@query("personal_rank_per_year", f"""WITH {REQ_SQL}, c AS (SELECT year, body, {CNT} FROM req GROUP BY ALL),
r AS (SELECT *, personal / total::DOUBLE AS personal_rate, row_number() OVER (PARTITION BY year ORDER BY personal / total::DOUBLE DESC, personal DESC, denied DESC, total DESC, body) AS position
 FROM c WHERE total >= 20 AND personal > 0)
SELECT * REPLACE (position::INTEGER AS position) FROM r WHERE position <= 10""")
def personal_rank_per_year(t: Tables) -> DataFrame:
    from civisight.operators.windows import top_per_group

    rows = rollups.rates(by(t, "year", "body").filter("total >= 20 and personal > 0"), {"personal_rate": ("personal", "total")})
    order = [F.col(c).desc() for c in ("personal_rate", "personal", "denied", "total")] + [F.col("body")]
    return top_per_group(rows, ["year"], order, 10, rank="position")


_CHOICE_ORDER = "personal / total::DOUBLE DESC, personal DESC, denied DESC, total DESC, body"


@query("ranking_choice", f"""WITH {REQ_SQL}, c AS (SELECT year, body, {CNT} FROM req GROUP BY ALL), o AS (SELECT body, {CNT} FROM req GROUP BY body),
y AS (SELECT year, body, row_number() OVER (PARTITION BY year ORDER BY {_CHOICE_ORDER}) AS position FROM c WHERE total >= 20),
w AS (SELECT body, row_number() OVER (ORDER BY {_CHOICE_ORDER}) AS position FROM o)
SELECT 'year' AS choice, year, body, position::INTEGER AS position FROM y WHERE year = 1996 AND position <= 25
UNION ALL SELECT 'unknown', year, body, position::INTEGER FROM y WHERE year = (SELECT max(year) FROM y) AND position <= 25
UNION ALL SELECT 'series', NULL, body, position::INTEGER FROM w WHERE position <= 25
UNION ALL SELECT 'none', NULL, body, position::INTEGER FROM w WHERE position <= 25""")
def ranking_choice(t: Tables) -> DataFrame:
    """The ranking of one year, of a year that has none, of the whole series, and where no year has one."""
    from civisight.operators.sets import union_tagged
    from civisight.operators.windows import top_per_group

    rated = lambda rows: rollups.rates(rows, {"personal_rate": ("personal", "total")})
    order = [F.col(c).desc() for c in ("personal_rate", "personal", "denied", "total")] + [F.col("body")]
    years = top_per_group(rated(by(t, "year", "body").filter("total >= 20")), ["year"], order, 25, rank="position").select("year", "body", "position")
    series = top_per_group(rated(by(t, "body")).withColumn("_all", F.lit(1)), ["_all"], order, 25, rank="position").select("body", "position")
    choices = {"year": (years, 1996), "unknown": (years, 1900), "series": (years, None), "none": (years.filter("year < 0"), 1994)}
    return union_tagged({k: ranking.chosen_ranking(rows, series, year) for k, (rows, year) in choices.items()}, "choice").select("choice", "year", "body", "position")


@query("personal_rank_overall", f"""WITH {REQ_SQL} SELECT body, {CNT}, count(*) FILTER (is_personal) / count(*) FILTER (is_restricted)::DOUBLE AS share_in_restricted
FROM req GROUP BY body HAVING count(*) FILTER (is_personal) > 0 ORDER BY personal DESC, restricted DESC, body LIMIT 20""")
def personal_rank_overall(t: Tables) -> DataFrame:
    rows = rollups.rates(by(t, "body"), {"share_in_restricted": ("personal", "restricted")})
    return ranking.rank_rows(rows, [F.col("personal").desc(), F.col("restricted").desc(), F.col("body")], 20, F.col("personal") > 0)


@query("top_plus_pinned", f"""WITH {REQ_SQL}, c AS (SELECT body, {CNT} FROM req GROUP BY body),
top AS (SELECT * FROM c ORDER BY denied DESC, restricted DESC, total DESC, body LIMIT 3),
pin AS (SELECT * FROM c WHERE lower(body) LIKE '%nation_1%' ORDER BY total DESC, body LIMIT 1)
SELECT *, false AS is_pinned FROM top UNION ALL SELECT *, true FROM pin WHERE body NOT IN (SELECT body FROM top)""")
def top_plus_pinned(t: Tables) -> DataFrame:
    order = [F.col("denied").desc(), F.col("restricted").desc(), F.col("total").desc(), F.col("body")]
    return ranking.top_n_plus_pinned(by(t, "body"), order, 3, plan.pinned_body(["nation_1"]), "total", "body")


DOM_SQL = """per AS (SELECT body, year, requester, count(*) AS n, count(*) FILTER (is_denied) AS d FROM req GROUP BY ALL),
dom AS (SELECT body, year, count(*) AS distinct_contributors, sum(n)::BIGINT AS total_attributed,
  first(requester ORDER BY n DESC, d DESC, requester) AS top_id, first(n ORDER BY n DESC, d DESC, requester) AS top_total,
  first(d ORDER BY n DESC, d DESC, requester) AS top_denied FROM per GROUP BY body, year)"""


@query("dominant_contributor", f"""WITH {REQ_SQL}, {DOM_SQL} SELECT * FROM dom""")
def dominant_contributor(t: Tables) -> DataFrame:
    return concentration.dominant_contributor(requests(t), ["body", "year"], "requester", F.col("is_denied"))


ADJ_SQL = f"""{DOM_SQL}, tot AS (SELECT body, year, count(*) AS total, count(*) FILTER (is_denied) AS denied FROM req GROUP BY ALL),
adj AS (SELECT tot.*, distinct_contributors, total_attributed, top_id, top_total, top_denied, top_total / total::DOUBLE AS top_share, top_denied / top_total::DOUBLE AS top_denied_rate,
  total >= 20 AND top_total / total::DOUBLE >= 0.03 AND top_denied / top_total::DOUBLE >= 0.5 AS concentrated FROM tot JOIN dom USING (body, year)),
adj2 AS (SELECT *, CASE WHEN concentrated THEN CASE WHEN total > top_total THEN (denied - top_denied) / (total - top_total)::DOUBLE ELSE 0 END ELSE denied / total::DOUBLE END AS denied_rate_adjusted,
  CASE WHEN concentrated THEN top_id END AS flagged_id FROM adj)"""


def _adjusted(t: Tables) -> DataFrame:
    base = requests(t)
    per = base.groupBy("body", "year").agg(F.count("*").alias("total"), F.count_if("is_denied").alias("denied"))
    top = concentration.dominant_contributor(base, ["body", "year"], "requester", F.col("is_denied"))
    return concentration.adjusted_rate(per.join(top, ["body", "year"], "left"), min_total=20, min_share=0.03, min_rate=0.5)


@query("adjusted_rate", f"""WITH {REQ_SQL}, {ADJ_SQL} SELECT * FROM adj2""")
def adjusted_rate(t: Tables) -> DataFrame:
    return _adjusted(t)


@query("concentration_latest_year", f"""WITH {REQ_SQL}, {ADJ_SQL}
SELECT body, year, concentrated, denied_rate_adjusted, flagged_id FROM adj2 QUALIFY row_number() OVER (PARTITION BY body ORDER BY year DESC) = 1""")
def concentration_latest_year(t: Tables) -> DataFrame:
    return concentration.latest_by_year(_adjusted(t), "body", "year").select("body", "year", "concentrated", "denied_rate_adjusted", "flagged_id")


@query("alerts_with_concentration", f"""WITH {REQ_SQL}, {ADJ_SQL}, l AS (SELECT * FROM adj2 QUALIFY row_number() OVER (PARTITION BY body ORDER BY year DESC) = 1),
c AS (SELECT body, {CNT} FROM req GROUP BY body ORDER BY denied DESC, restricted DESC, total DESC, body LIMIT 10)
SELECT c.*, concentrated, denied_rate_adjusted FROM c JOIN l USING (body)""")
def alerts_with_concentration(t: Tables) -> DataFrame:
    latest = concentration.latest_by_year(_adjusted(t), "body", "year")
    return concentration.with_concentration(body_ranking(t), latest, "body")


# comparisons: the last year of the data ends in the summer, like a running year
MON_SQL = f"""mon AS (SELECT year, month, {CNT} FROM req GROUP BY year, month), ly AS (SELECT max(year) AS y FROM mon),
lm AS (SELECT max(month) AS m FROM mon, ly WHERE year = y), base AS (SELECT DISTINCT year FROM mon, ly WHERE year < y ORDER BY year DESC LIMIT 3)"""


@query("ytd_vs_baseline", f"""WITH {REQ_SQL}, {MON_SQL}, per AS (SELECT year, year = y AS is_now, sum(total) AS total, sum(denied) AS denied, sum(restricted) AS restricted, sum(personal) AS personal
 FROM mon, ly, lm WHERE month <= m AND (year = y OR year IN (FROM base)) GROUP BY year, y),
r AS (SELECT *, denied / total::DOUBLE AS dr, restricted / total::DOUBLE AS rr FROM per),
s AS (SELECT (SELECT y FROM ly) AS year, (SELECT m FROM lm) AS month, count(*) FILTER (NOT is_now) AS base_years,
 max(total) FILTER (is_now)::BIGINT AS total, max(denied) FILTER (is_now)::BIGINT AS denied, max(restricted) FILTER (is_now)::BIGINT AS restricted, max(personal) FILTER (is_now)::BIGINT AS personal,
 max(dr) FILTER (is_now) AS denied_rate, max(rr) FILTER (is_now) AS restricted_rate,
 avg(total) FILTER (NOT is_now) AS total_base, avg(denied) FILTER (NOT is_now) AS denied_base, avg(restricted) FILTER (NOT is_now) AS restricted_base,
 avg(personal) FILTER (NOT is_now) AS personal_base, avg(dr) FILTER (NOT is_now) AS denied_rate_base, avg(rr) FILTER (NOT is_now) AS restricted_rate_base FROM r)
SELECT *, (denied_rate - denied_rate_base) * 100 AS denied_delta_pp, (restricted_rate - restricted_rate_base) * 100 AS restricted_delta_pp,
 CASE WHEN (denied_rate - denied_rate_base) * 100 >= 0.8 THEN 'worse' WHEN (denied_rate - denied_rate_base) * 100 <= -0.8 THEN 'better' ELSE 'stable' END AS denied_status,
 CASE WHEN (restricted_rate - restricted_rate_base) * 100 >= 0.8 THEN 'worse' WHEN (restricted_rate - restricted_rate_base) * 100 <= -0.8 THEN 'better' ELSE 'stable' END AS restricted_status FROM s""")
def ytd_vs_baseline(t: Tables) -> DataFrame:
    return periods.ytd_vs_baseline(by(t, "year", "month"), plan.MASKS, {"denied": "total", "restricted": "total"})


@query("ytd_top_rate", f"""WITH {REQ_SQL}, {MON_SQL}
SELECT body, count(*) AS total, count(*) FILTER (is_denied) AS denied, count(*) FILTER (is_denied) / count(*)::DOUBLE AS denied_rate
FROM req, ly, lm WHERE year = y AND month <= m GROUP BY body HAVING count(*) >= 30 ORDER BY denied_rate DESC, denied DESC, total DESC, body LIMIT 5""")
def ytd_top_rate(t: Tables) -> DataFrame:
    return periods.ytd_top_rate(by(t, "year", "month", "body"), by(t, "year", "month"), "body", min_total=30)


@query("spikes", f"""WITH {REQ_SQL}, {MON_SQL}, nb AS (SELECT count(*) AS k FROM base),
p AS (SELECT body, count(*) FILTER (year = y AND is_denied) AS current_denied, count(*) FILTER (year = y) AS ct,
  count(*) FILTER (year <> y AND is_denied) AS bd, count(*) FILTER (year <> y) AS bt
  FROM req, ly, lm WHERE month = m AND (year = y OR year IN (FROM base)) GROUP BY body)
SELECT body, current_denied, bd / k::DOUBLE AS base_denied, current_denied - bd / k::DOUBLE AS delta,
 CASE WHEN bd > 0 THEN current_denied / (bd / k::DOUBLE) - 1 ELSE 0 END AS lift, CASE WHEN ct > 0 THEN current_denied / ct::DOUBLE ELSE 0 END AS current_rate,
 CASE WHEN bt > 0 THEN bd / bt::DOUBLE ELSE 0 END AS base_rate
FROM p, nb WHERE current_denied >= 0 AND bd / k::DOUBLE >= 1 AND current_denied >= bd / k::DOUBLE * 0 AND current_denied - bd / k::DOUBLE >= -100
ORDER BY lift DESC, delta DESC, body LIMIT 8""")
def spikes(t: Tables) -> DataFrame:
    """The last month of the tables has a single day, so the thresholds are low here."""
    return periods.spikes(by(t, "year", "month", "body"), by(t, "year", "month"), "body", min_now=0, min_base=1, times=0, plus=-100)


@query("worsening", f"""WITH {REQ_SQL}, {MON_SQL}, nb AS (SELECT count(*) AS k FROM base),
p AS (SELECT body AS theme, count(*) FILTER (year = y) AS current_total, count(*) FILTER (year = y AND is_restricted) AS current_restricted,
  count(*) FILTER (year <> y) AS bt, count(*) FILTER (year <> y AND is_restricted) AS br
  FROM req, ly, lm WHERE month <= m AND (year = y OR year IN (FROM base)) GROUP BY body)
SELECT theme, current_restricted / current_total::DOUBLE AS current_rate, br / bt::DOUBLE AS base_rate,
 (current_restricted / current_total::DOUBLE - br / bt::DOUBLE) * 100 AS delta_pp, current_total, current_restricted
FROM p, nb WHERE current_total >= 20 AND bt / k::DOUBLE >= 20 AND (current_restricted / current_total::DOUBLE - br / bt::DOUBLE) * 100 >= 1.0
ORDER BY delta_pp DESC, current_restricted DESC, theme LIMIT 8""")
def worsening(t: Tables) -> DataFrame:
    rows = by(t, "year", "month", "body").withColumnRenamed("body", "theme")
    return periods.worsening(rows, by(t, "year", "month"), "theme", min_total=20)


@query("peak_year", f"""WITH {REQ_SQL}, c AS (SELECT year, {CNT} FROM req GROUP BY year), x AS (SELECT *, denied / total::DOUBLE AS rate FROM c WHERE year <> 2001)
SELECT first(year ORDER BY denied DESC, year) AS peak_count_year, max(denied) AS peak_count, first(year ORDER BY rate DESC, year) AS peak_rate_year, max(rate) AS peak_rate FROM x""")
def peak_year(t: Tables) -> DataFrame:
    """Peaks over complete years; the running last year does not count."""
    rows = rollups.rates(by(t, "year"), {"denied_rate": ("denied", "total")})
    return periods.peak_year(rows, "year", "denied", "denied_rate", 2001)


@query("reason_table", f"""WITH {REQ_SQL}, tot AS (SELECT count(*) AS t, count(*) FILTER (is_restricted) AS r FROM req WHERE year = 2000)
SELECT reason, count(*) AS n, count(*) / any_value(r)::DOUBLE AS share_in_restricted, count(*) / any_value(t)::DOUBLE AS share_in_total
FROM req, tot WHERE year = 2000 AND is_restricted GROUP BY reason""")
def reason_table(t: Tables) -> DataFrame:
    return periods.reason_table(restricted_reason_counts(t), by(t, "year"), 2000)


@query("coverage_counts", f"""WITH {REQ_SQL}, top AS (SELECT body FROM req GROUP BY body ORDER BY count(*) FILTER (is_denied) DESC, count(*) FILTER (is_restricted) DESC, count(*) DESC, body LIMIT 10)
SELECT reason, count(*) AS n, count(*) FILTER (body IN (FROM top)) AS n_in_top FROM req WHERE is_denied GROUP BY reason ORDER BY n DESC, reason LIMIT 20""")
def coverage_counts(t: Tables) -> DataFrame:
    return profiles.coverage_counts(requests(t).filter("is_denied"), body_ranking(t), "body", "reason")


@query("facet_filter", f"""WITH {REQ_SQL} SELECT id, body, reason FROM req WHERE reason = '1-URGENT' AND decision = 'F' AND year = 1999""")
def facets(t: Tables) -> DataFrame:
    """Preset search: empty facets match everything."""
    return facet_filter(requests(t), {"reason": "1-URGENT", "decision": "F", "year": 1999, "body": ""}).select("id", "body", "reason")


THEMES = [("Household", ["ring", "bolt"]), ("Tools", ["nut", "bolt", "gear"]), ("Widgets", ["widget"])]


@query("first_match_theme", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') THEN 'Household'
 WHEN contains(lower(p_name), 'nut') OR contains(lower(p_name), 'gear') THEN 'Tools' WHEN contains(lower(p_name), 'widget') THEN 'Widgets' ELSE 'Other' END AS theme FROM part""")
def first_match_theme(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", classify.first_match("p_name", THEMES, "Other").alias("theme"))


@query("document_themes", """SELECT doc_id, CASE WHEN contains(lower(text), 'hand') THEN 'A' WHEN contains(lower(text), 'thou') OR contains(lower(text), 'élle') THEN 'B' ELSE 'Other' END AS theme FROM documents""")
def document_themes(t: Tables) -> DataFrame:
    """Substring themes over whole texts, accents kept."""
    return t.documents.select("doc_id", classify.first_match("text", [("A", ["hand"]), ("B", ["thou", "élle"])], "Other").alias("theme"))


@query("keyword_flag", """SELECT doc_id, regexp_matches(lower(strip_accents(text)), 'elle|nicht|para') AS flagged FROM documents""")
def keyword_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", classify.keyword_flag("text", ["élle", "NICHT", "pára"]).alias("flagged"))


@query("canonical_label", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-Urgent' WHEN o_orderpriority LIKE '4-NOT %' THEN '4-not' WHEN length(o_orderpriority) > 6 THEN 'free text' ELSE o_orderpriority END AS label FROM orders""")
def canonical_label(t: Tables) -> DataFrame:
    """Known label, also as a prefix; long unknown text to one bucket."""
    return t.orders.select("o_orderkey", classify.canonical_label("o_orderpriority", ["1-Urgent", "4-not"], "missing", "free text", 6).alias("label"))


@query("canonical_reason", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' WHEN '4-NOT SPECIFIED' THEN 'free text' ELSE o_orderpriority END AS reason FROM orders""")
def canonical_reason(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", classify.canonical_by_map("o_orderpriority", {"1-urgent": "Urgent", "5-lów": "Low"}, "missing", "free text", 10).alias("reason"))


@query("normalize_value", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS value FROM lineitem""")
def normalize_value(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", classify.normalize_value("l_returnflag", {"a": "Accepted", "R": "Returned"}).alias("value"))


@query("best_attachment", """SELECT l_orderkey AS id, l_partkey AS attachment, l_returnflag AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def best_attachment(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("attachment"), F.col("l_returnflag").alias("kind"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("priority"),
        F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice").alias("row_no"))
    return lookups.best_by_priority(rows, "id", "priority", "row_no").select("id", "attachment", "kind")


@query("denied_samples", f"""WITH {REQ_SQL}, att AS (SELECT l_orderkey AS id, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
SELECT req.id, year, body, reason, theme, CASE WHEN length(reason) > 9 THEN rtrim(substr(reason, 1, 6)) || '...' ELSE reason END AS text_excerpt,
 'https://public.example/' || req.id AS public_link, 'https://files.example/' || p AS attachment FROM req LEFT JOIN att USING (id) WHERE is_denied""")
def denied_samples(t: Tables) -> DataFrame:
    base = requests(t).withColumns({"subject": F.col("reason"), "request_text": F.col("reason"), "response_text": F.col("decision")})
    files = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("https://files.example/"), F.min("l_partkey").cast("string")).alias("attachment"))
    rows = plan.denied_samples(base, files, "https://public.example/", "https://search.example/", excerpt=9)
    return rows.select("id", "year", "body", "reason", "theme", "text_excerpt", "public_link", "attachment")


# ------------------------------------------------------- landed, by default rules

_WORDS = [w for _, words in rules.THEMES for w in words]


def _told(words) -> str:
    return " OR ".join(f"contains(coalesce(w, '') || ' ' || p, '{x.lower()}')" for x in words)


_THEME_CASE = " ".join(["CASE", *[f"WHEN {_told(words)} THEN '{label}'" for label, words in rules.THEMES], f"ELSE '{rules.OTHER_THEMES}' END"])
LANDED_SQL = f"""k AS (SELECT [{', '.join(f"'{w}'" for w in _WORDS)}] AS words),
raw AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, o_orderstatus AS st, lower(words[(o_orderkey % (len(words) + 9) + 1)::INTEGER]) AS w, lower(o_orderpriority) AS p FROM orders, k),
lnd AS (SELECT o_orderkey::VARCHAR AS id, year, month, CASE st WHEN 'F' THEN '{rules.DENIED}' WHEN 'O' THEN 'Acesso Concedido' ELSE '{rules.NO_DECISION}' END AS decision, {_THEME_CASE} AS theme FROM raw)"""


def _landed(t: Tables) -> DataFrame:
    """Landed requests out of orders: every theme word in turn, some rows without one, decisions by status."""
    null = F.lit(None).cast("string")
    word = F.get(F.array(*[F.lit(w.upper()) for w in _WORDS]), (F.col("o_orderkey") % (len(_WORDS) + 9)).cast("int"))
    decision = F.when(F.col("o_orderstatus") == "F", " acesso negado ").when(F.col("o_orderstatus") == "O", "Acesso  Concedido")
    given = {"IdPedido": F.col("o_orderkey").cast("string"), "IdSolicitante": F.col("o_custkey").cast("string"), "DataRegistro": F.date_format("o_orderdate", "dd/MM/yyyy"),
             "ResumoSolicitacao": word, "DetalhamentoSolicitacao": F.col("o_orderpriority"), "Decisao": decision}
    return t.orders.select(*[given.get(c, null).alias(c) for c in plan.LANDED])


@query("landed_themes", f"""WITH {LANDED_SQL} SELECT id, year, month, decision, theme, decision = '{rules.DENIED}' AS is_denied FROM lnd""")
def landed_themes(t: Tables) -> DataFrame:
    """Landed requests with the default themes and decisions."""
    return plan.landed_requests(_landed(t)).select("id", "year", "month", "decision", "theme", "is_denied")


_PRESETS = ", ".join(f"('{p['id']}', '{p['filters']['theme']}')" for p in rules.SEARCH_PRESETS)


@query("preset_counts", f"""WITH {LANDED_SQL} SELECT preset, count(*) AS n FROM lnd JOIN (VALUES {_PRESETS}) v(preset, wanted) ON theme = wanted AND decision = '{rules.DENIED}' GROUP BY preset""")
def preset_counts(t: Tables) -> DataFrame:
    """Requests behind each ready-made filter."""
    from civisight.operators.sets import union_tagged

    rows = settle(plan.landed_requests(_landed(t)).select("theme", "year", F.col("body").alias("org"), F.when(F.col("is_denied"), "negado").otherwise("outro").alias("decision_group")))
    found = {p["id"]: facet_filter(rows, p["filters"]) for p in rules.SEARCH_PRESETS}
    return union_tagged(found, "preset").groupBy("preset").agg(F.count("*").alias("n"))
