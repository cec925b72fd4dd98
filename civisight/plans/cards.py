"""Card spending by month, body and unit, with and without inflation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight import rules
from civisight.functions.dates import month_from_parts, parse_date
from civisight.functions.money import parse_money, total
from civisight.functions.text import first_present, title_case, upper_key
from civisight.operators import lookups, periods, spines, windows

LANDED = (
    "ANO EXTRATO", "MÊS EXTRATO", "VALOR TRANSAÇÃO", "TRANSAÇÃO", "NOME ÓRGÃO SUPERIOR", "NOME UNIDADE GESTORA",
)
NO_BODY, NO_UNIT = "Sem órgão informado", "Sem unidade informada"


def landed_cards(raw: DataFrame) -> DataFrame:
    """Typed projection of an archive (``archive`` names it ``yyyymm...``, the month's fallback)."""
    name = F.regexp_extract("archive", r"(\d{4})(\d{2})_[^/]*$", 1)
    fallback = F.concat(name, F.lit("-"), F.regexp_extract("archive", r"(\d{4})(\d{2})_[^/]*$", 2))
    month = month_from_parts("ANO EXTRATO", "MÊS EXTRATO", fallback)
    return raw.select(
        "archive", F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd").alias("month"), parse_money("VALOR TRANSAÇÃO").alias("amount"),
        upper_key("TRANSAÇÃO").contains("SAQUE").alias("is_cash"), first_present("NOME ÓRGÃO SUPERIOR", default=NO_BODY).alias("body"),
        unit_label(first_present("NOME UNIDADE GESTORA", default=NO_UNIT)).alias("unit"))


def unit_label(c: Column, labels: dict[str, str] = rules.UNIT_LABELS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, upper_key(c)), title_case(c))


def is_presidency(body: str = "body") -> Column:
    return upper_key(body).contains("PRESID")


def spend_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Total, cash withdrawals, purchases and transactions per key."""
    return rows.groupBy(*keys).agg(
        total("amount").alias("total"), total(F.when(F.col("is_cash"), F.col("amount"))).alias("cash"),
        total(F.when(~F.col("is_cash"), F.col("amount"))).alias("purchase"), F.count("*").alias("n"))


def price_rates(raw: DataFrame) -> DataFrame:
    """Monthly rates of the price index."""
    rate = F.replace(F.col("valor"), F.lit(","), F.lit(".")).try_cast("double")
    return raw.select(F.to_date(F.trunc(parse_date("data", ["dd/MM/yyyy"]), "month")).alias("month"), rate.alias("rate")).filter("month is not null and rate is not null")


def deflators(rates: DataFrame, months: DataFrame) -> DataFrame:
    """Factor of every month of the series to its last month; a month without a rate has 0."""
    spine = spines.calendar(F.min("month"), F.max("month"), "month", months, "month")
    return windows.deflator(spine.join(rates, "month", "left"), "month", "rate")


def by_period(months: DataFrame, value: str, terms: Sequence[dict] = rules.SPENDING_PERIODS) -> DataFrame:
    """Mean of the months with data per term."""
    tagged = months.withColumn("period", lookups.period_of("month", terms, ("", ""))["label"]).filter("period <> ''")
    return periods.period_mean(tagged, "period", value)


def first_months(months: DataFrame, value: str, terms: Sequence[dict] = rules.SPENDING_PERIODS) -> DataFrame:
    """Running totals over the first N months of every term, N from the shortest."""
    tagged = months.withColumn("period", lookups.period_of("month", terms, ("", ""))["label"]).filter("period <> ''")
    return windows.cumulative_first_n(tagged, "period", "month", value)
