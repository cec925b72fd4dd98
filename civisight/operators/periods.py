"""Comparisons of periods. Inputs are monthly or daily totals, i.e. small tables."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions.dates import iso_week
from civisight.functions.money import pct_diff, ratio
from civisight.functions.text import ColumnOrName, as_col
from civisight.session import settle


def peak_day(days: DataFrame, day: str, value: str) -> DataFrame:
    """Day with the largest value (the earliest one on a tie) and its share."""
    total = days.agg(F.sum(value)).scalar()
    head = days.orderBy(F.col(value).desc(), F.col(day)).limit(1)
    return head.select(F.col(day).alias("peak_day"), F.col(value).cast("double").alias("peak_value"), ratio(value, total).alias("peak_share"))


def peak_week(days: DataFrame, day: str, value: str) -> DataFrame:
    """ISO week with the largest total (the earliest on a tie) against the mean of the other
    weeks with movement."""
    weeks = days.filter(F.col(value) != 0).groupBy(iso_week(day).alias("week")).agg(F.sum(value).alias("total"))
    stats = weeks.agg(
        F.min(F.struct((-F.col("total")).alias("minus"), "week")).alias("_top"), F.sum("total").alias("_sum"), F.count("*").alias("_n"))
    top = -F.col("_top.minus")
    others = ratio(F.col("_sum") - top, F.col("_n") - 1)
    return stats.select(
        F.col("_top.week").alias("week"), top.cast("double").alias("week_total"), others.alias("others_mean"), ratio(top, others).alias("times_mean"))


def period_mean(months: DataFrame, period: str, value: str) -> DataFrame:
    """Mean of the months with data."""
    return months.groupBy(period).agg(F.count("*").alias("months"), F.avg(value).alias("mean"))


def flagged_mean_diff(months: DataFrame, flag: Column, value: str) -> DataFrame:
    """Mean over flagged months against the rest, and the difference in percent."""
    means = months.agg(
        F.coalesce(F.avg(F.when(flag, F.col(value))), F.lit(0.0)).cast("double").alias("flagged_mean"),
        F.coalesce(F.avg(F.when(~flag, F.col(value))), F.lit(0.0)).cast("double").alias("other_mean"))
    return means.withColumn("diff_pct", pct_diff("flagged_mean", "other_mean"))


def campaign_month(month: ColumnOrName, years: Sequence[int] = (2014, 2018, 2022, 2026), first: int = 7, last: int = 10) -> Column:
    return F.year(as_col(month)).isin(list(years)) & F.month(as_col(month)).between(first, last)


def same_months(months: DataFrame, month: str) -> DataFrame:
    """Rows of the current year and, of every earlier year that has all of them, of the months
    January..k, k being the number of months the current year has; adds ``year`` and
    ``is_current``.

    The calendar of the data (a few hundred months) is one array in one scalar subquery, so
    the rows themselves are scanned once more and not joined to themselves.
    """
    calendar = months.agg(F.sort_array(F.collect_set(month)).alias("c")).select("c", F.year(F.array_max("c")).alias("now"))
    calendar = calendar.withColumn("k", F.size(F.filter("c", lambda d: F.year(d) == F.col("now"))))
    early = F.filter("c", lambda d: (F.year(d) < F.col("now")) & (F.month(d) <= F.col("k")))
    calendar = calendar.withColumn("e", F.transform(early, lambda d: F.year(d)))
    complete = F.filter(F.array_distinct("e"), lambda y: F.size(F.filter("e", lambda z: z == y)) == F.col("k"))
    ctx = calendar.select(F.struct("now", "k", complete.alias("years"))).scalar()
    work = months.withColumn("year", F.year(month)).withColumn("_ctx", ctx)
    current = F.col("year") == F.col("_ctx.now")
    inside = current | ((F.month(month) <= F.col("_ctx.k")) & F.array_contains(F.col("_ctx.years"), F.col("year")))
    return work.filter(inside).withColumn("is_current", current).drop("_ctx")


def ytd_window(months: DataFrame, month: str, value: str) -> DataFrame:
    """Current year so far against the mean of earlier complete years over the same months."""
    per = same_months(months, month).groupBy("year", "is_current").agg(F.sum(value).alias("_v"))
    out = per.agg(
        F.max(F.when(F.col("is_current"), F.col("year"))).alias("year"),
        F.sum(F.when(F.col("is_current"), F.col("_v"))).cast("double").alias("current_total"),
        F.coalesce(F.avg(F.when(~F.col("is_current"), F.col("_v"))), F.lit(0)).cast("double").alias("base_mean"),
        F.count_if(~F.col("is_current")).alias("base_years"))
    return out.withColumn("diff_pct", pct_diff("current_total", "base_mean"))


def unit_vs_history(units: DataFrame, month: str, unit: str, value: str, top: int = 10) -> DataFrame:
    """Largest units of the current window against their mean over earlier complete years;
    a year without the unit still counts in the divisor."""
    units = settle(units.groupBy(month, unit).agg(F.sum(value).alias(value)))
    window = same_months(units, month)
    per = window.groupBy(unit).agg(
        F.sum(F.when(F.col("is_current"), F.col(value))).alias("current_total"),
        F.sum(F.when(~F.col("is_current"), F.col(value))).alias("_past"))
    years = window.filter(~F.col("is_current")).agg(F.count_distinct("year")).scalar()
    out = per.filter(F.col("current_total").isNotNull()).orderBy(F.col("current_total").desc(), F.col(unit)).limit(top)
    return out.select(
        unit, F.col("current_total").cast("double").alias("current_total"),
        (F.coalesce(F.col("_past"), F.lit(0)).cast("double") / F.greatest(years, F.lit(1))).alias("history_mean"))


def split_share(months: DataFrame, month: str, parts: Sequence[str]) -> DataFrame:
    """Shares of the parts within the current window."""
    window = same_months(months, month).filter("is_current")
    sums = window.agg(*[F.sum(p).alias(p) for p in parts])
    whole = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return sums.select(*[F.col(p).cast("double").alias(p) for p in parts], *[ratio(p, whole).alias(f"{p}_share") for p in parts])


def deflate(rows: DataFrame, factors: DataFrame, month: str, values: Sequence[str], real: bool = True) -> DataFrame:
    """Multiply by the month's factor (1 when unknown)."""
    if not real:
        return rows.withColumns({f"{v}_real": F.col(v).cast("double") for v in values})
    f = F.coalesce("factor", F.lit(1.0))
    return rows.join(factors.select(month, "factor"), month, "left").withColumns(
        {f"{v}_real": F.col(v).cast("double") * f for v in values}).drop("factor")


def series_share(a: DataFrame, b: DataFrame, month: str, value: str) -> DataFrame:
    """Share of one monthly series in another."""
    whole = b.select(month, F.col(value).alias("_whole"))
    return a.join(whole, month, "left").withColumn("share", ratio(value, "_whole")).drop("_whole")


# ------------------------------------------------ year to date with baselines

def ytd_context(months: DataFrame, year: str = "year", month: str = "month", total: str = "total") -> Column:
    """struct(last_year, last_month with volume, before: up to three earlier years), as one
    scalar over the monthly totals (a few hundred cells)."""
    cells = months.filter(F.col(year).isNotNull()).agg(F.collect_list(F.struct(F.col(year).alias("y"), F.col(month).alias("m"), F.col(total).alias("t"))).alias("c"))
    cells = cells.withColumn("now", F.array_max(F.transform("c", lambda x: x["y"])))
    last = F.array_max(F.transform(F.filter("c", lambda x: (x["y"] == F.col("now")) & (x["t"] > 0)), lambda x: x["m"]))
    earlier = F.array_distinct(F.transform(F.filter("c", lambda x: x["y"] < F.col("now")), lambda x: x["y"]))
    return cells.select(F.struct(
        F.col("now").alias("last_year"), last.alias("last_month"), F.slice(F.sort_array(earlier, asc=False), 1, 3).alias("before"))).scalar()


def _in_context(rows: DataFrame, months: DataFrame, total: str = "total") -> tuple[DataFrame, Column]:
    """Rows of the current and the comparison years with ``_ctx``, and the test for current."""
    work = rows.withColumn("_ctx", ytd_context(months, total=total))
    now = F.col("year") == F.col("_ctx.last_year")
    return work.filter(now | F.array_contains(F.col("_ctx.before"), F.col("year"))), now


def ytd_vs_baseline(months: DataFrame, counts: Sequence[str], rate_of: dict[str, str], total: str = "total", step: float = 0.8) -> DataFrame:
    """Current year to date against the mean of up to three previous years: means of yearly
    counts, means of yearly rates, change in points and a status."""
    window, now = _in_context(months, months, total)
    # a comparison year without any row up to the month still counts, as zeros
    upto = lambda c: F.sum(F.when(F.col("month") <= F.col("_ctx.last_month"), F.col(c)).otherwise(0))
    per_year = window.groupBy("year", now.alias("_now"), F.col("_ctx.last_month").alias("month")).agg(*[upto(c).alias(c) for c in counts])
    per_year = per_year.withColumns({f"{r}_rate": ratio(r, d) for r, d in rate_of.items()})
    fields = [*counts, *[f"{r}_rate" for r in rate_of]]
    out = per_year.agg(
        F.max("year").alias("year"), F.max("month").alias("month"), F.count_if(~F.col("_now")).alias("base_years"),
        *[F.max(F.when(F.col("_now"), F.col(f))).alias(f) for f in fields],
        *[F.coalesce(F.avg(F.when(~F.col("_now"), F.col(f))), F.lit(0.0)).alias(f"{f}_base") for f in fields])
    deltas = {f"{r}_delta_pp": (F.col(f"{r}_rate") - F.col(f"{r}_rate_base")) * 100 for r in rate_of}
    out = out.withColumns(deltas)
    return out.withColumns({
        f"{r}_status": F.when(F.col(f"{r}_delta_pp") >= step, "worse").when(F.col(f"{r}_delta_pp") <= -step, "better").otherwise("stable")
        for r in rate_of})


def ytd_top_rate(bodies: DataFrame, months: DataFrame, body: str, min_total: int = 200, n: int = 5) -> DataFrame:
    """Bodies with the highest denial rate of the current year to date."""
    window, now = _in_context(bodies, months)
    per = window.filter(now & (F.col("month") <= F.col("_ctx.last_month"))).groupBy(body).agg(
        F.sum("total").alias("total"), F.sum("denied").alias("denied"))
    return per.filter(F.col("total") >= min_total).withColumn("denied_rate", ratio("denied", "total")).orderBy(
        F.col("denied_rate").desc(), F.col("denied").desc(), F.col("total").desc(), F.col(body)).limit(n)


def _now_and_before(rows: DataFrame, key: str, now: Column, measures: Sequence[str]) -> DataFrame:
    """Sums of the current and of the comparison years per key, and the number of the latter."""
    part = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0))
    return rows.groupBy(key, F.size("_ctx.before").alias("_years")).agg(
        *[part(m, now).alias(f"now_{m}") for m in measures], *[part(m, ~now).alias(f"base_{m}") for m in measures]).filter("_years > 0")


def spikes(bodies: DataFrame, months: DataFrame, body: str, min_now: int = 12, min_base: float = 6, times: float = 1.35, plus: float = 8, n: int = 8) -> DataFrame:
    """Bodies whose denials in the latest month jump above the same month of earlier years
    (a year without the body counts as zero)."""
    window, now = _in_context(bodies, months)
    per = _now_and_before(window.filter(F.col("month") == F.col("_ctx.last_month")), body, now, ["denied", "total"])
    base = F.col("base_denied") / F.col("_years")
    out = per.select(
        body, F.col("now_denied").alias("current_denied"), base.alias("base_denied"), (F.col("now_denied") - base).alias("delta"),
        F.when(base > 0, F.col("now_denied") / base - 1).otherwise(F.lit(0.0)).alias("lift"),
        ratio("now_denied", "now_total").alias("current_rate"), ratio("base_denied", "base_total").alias("base_rate"))
    return out.filter(
        (F.col("current_denied") >= min_now) & (F.col("base_denied") >= min_base)
        & (F.col("current_denied") >= F.col("base_denied") * times) & (F.col("delta") >= plus)
    ).orderBy(F.col("lift").desc(), F.col("delta").desc(), F.col(body)).limit(n)


def worsening(themes: DataFrame, months: DataFrame, theme: str, min_total: float = 120, step: float = 1.0, n: int = 8) -> DataFrame:
    """Themes whose restricted rate to date rises above the pooled rate of earlier years."""
    window, now = _in_context(themes, months)
    per = _now_and_before(window.filter(F.col("month") <= F.col("_ctx.last_month")), theme, now, ["total", "restricted"])
    rate, base = ratio("now_restricted", "now_total"), ratio("base_restricted", "base_total")
    out = per.filter((F.col("now_total") >= min_total) & (F.col("base_total") / F.col("_years") >= min_total)).select(
        theme, rate.alias("current_rate"), base.alias("base_rate"), ((rate - base) * 100).alias("delta_pp"),
        F.col("now_total").alias("current_total"), F.col("now_restricted").alias("current_restricted"))
    return out.filter(F.col("delta_pp") >= step).orderBy(
        F.col("delta_pp").desc(), F.col("current_restricted").desc(), F.col(theme)).limit(n)


# --------------------------------------------------------------------- years

def complete_years(years: DataFrame, year: str, build_year: int) -> DataFrame:
    """All years but a last one that is still running."""
    return years.filter(F.col(year) != build_year)


def peak_year(years: DataFrame, year: str, count: str, rate: str, build_year: int) -> DataFrame:
    """Year with most cases and year with the highest rate, earliest on a tie."""
    done = complete_years(years, year, build_year)
    return done.agg(
        F.max_by(year, F.struct(F.col(count), -F.col(year))).alias("peak_count_year"), F.max(count).alias("peak_count"),
        F.max_by(year, F.struct(F.col(rate), -F.col(year))).alias("peak_rate_year"), F.max(rate).alias("peak_rate"))


def reason_table(reasons: DataFrame, totals: DataFrame, year: int, label: str = "reason", n: str = "n") -> DataFrame:
    """Reasons of one year with their share of the restricted and of all requests."""
    rows = reasons.filter(F.col("year") == year).join(totals.select("year", "restricted", "total"), "year")
    return rows.select(label, n, ratio(n, "restricted").alias("share_in_restricted"), ratio(n, "total").alias("share_in_total")).orderBy(
        F.col(n).desc(), F.col(label))


def execution_rate(spent: ColumnOrName, authorised: ColumnOrName) -> Column:
    return ratio(spent, authorised)


def staleness(updated: ColumnOrName, asof: dt.date, fresh: int = 2, late: int = 5) -> Column:
    age = F.date_diff(F.lit(asof), as_col(updated))
    return F.when(age.isNull(), "unknown").when(age <= fresh, "fresh").when(age <= late, "late").otherwise("stale")
