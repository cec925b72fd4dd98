"""Calendars: every month or day between two ends, with zeros where nothing happened."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar(first: Column, last: Column, step: str, source: DataFrame, name: str) -> DataFrame:
    ends = source.agg(first.alias("_a"), last.alias("_b")).filter(F.col("_a").isNotNull())
    return ends.select(F.explode(F.sequence("_a", "_b", F.expr(f"interval 1 {step}"))).alias(name))


def fill_months(df: DataFrame, month: str, zeros: Sequence[str]) -> DataFrame:
    """Every month between the first and the last; absent counts are zero, other columns null."""
    spine = calendar(F.min(month), F.max(month), "month", df, month)
    joined = spine.join(df.withColumn("has_rows", F.lit(True)), month, "left")
    return joined.withColumns({z: F.coalesce(F.col(z), F.lit(0)) for z in zeros} | {"has_rows": F.coalesce("has_rows", F.lit(False))})


def fill_days(df: DataFrame, day: str, zeros: Sequence[str]) -> DataFrame:
    """Every day from 1 January of the first year to the last day."""
    spine = calendar(F.to_date(F.trunc(F.min(day), "year")), F.max(day), "day", df, day)
    return spine.join(df, day, "left").withColumns({z: F.coalesce(F.col(z), F.lit(0)) for z in zeros})


def fill_year_months(df: DataFrame, year: str, month: str, zeros: Sequence[str]) -> DataFrame:
    """Twelve months for every year that occurs."""
    grid = df.select(year).distinct().select(year, F.explode(F.sequence(F.lit(1), F.lit(12))).alias(month))
    return grid.join(df, [year, month], "left").withColumns({z: F.coalesce(F.col(z), F.lit(0)) for z in zeros})
