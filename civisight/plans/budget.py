"""Spending amendments: totals, growth between snapshots, daily series, supporters, checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight import rules
from civisight.functions.dates import parse_date
from civisight.functions.money import MONEY, parse_money, ratio, safe_int, total
from civisight.functions.text import case_when, clean_text, first_present, join_nonempty, upper_key
from civisight.operators import lookups, rollups, spines, windows

NO_AUTHOR, NO_PLACE = "Autor não informado", "Destino não informado"


def landed_documents(raw: DataFrame) -> DataFrame:
    """Commitments and payments by document date (columns by folded header)."""
    city = F.when(
        clean_text("municipio_de_aplicacao_do_recurso").isNotNull() | clean_text("uf_de_aplicacao_do_recurso").isNotNull(),
        F.concat(F.coalesce(clean_text("municipio_de_aplicacao_do_recurso"), F.lit("")), F.lit(" - "), F.coalesce(clean_text("uf_de_aplicacao_do_recurso"), F.lit(""))))
    return raw.select(
        parse_date("data_documento", ["dd/MM/yyyy"]).alias("date"), first_present("nome_do_autor_da_emenda", default=NO_AUTHOR).alias("author"),
        F.coalesce(clean_text("localidade_de_aplicacao_do_recurso"), city, F.lit(NO_PLACE)).alias("place"),
        parse_money("valor_empenhado").alias("committed"), parse_money("valor_pago").alias("paid"))


def landed_totals(raw: DataFrame) -> DataFrame:
    """Amendment totals by year of the amendment."""
    city = F.when(
        clean_text("municipio").isNotNull() | clean_text("uf").isNotNull(),
        F.concat(F.coalesce(clean_text("municipio"), F.lit("")), F.lit(" - "), F.coalesce(clean_text("uf"), F.lit(""))))
    return raw.select(
        safe_int("ano_da_emenda").alias("year"), first_present("nome_do_autor_da_emenda", default=NO_AUTHOR).alias("author"),
        F.coalesce(clean_text("localidade_de_aplicacao_do_recurso"), city, F.lit(NO_PLACE)).alias("place"),
        parse_money("valor_empenhado").alias("committed"), parse_money("valor_liquidado").alias("settled"), parse_money("valor_pago").alias("paid"))


def landed_grid(raw: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Rows of the budget grid: eight-digit amendment numbers only, last row per filter and number."""
    typed = raw.filter(F.trim("number").rlike(r"^\d{8}$")).filter(F.col("filter").isin(list(filters)))
    return windows.dedupe_last(typed, ["filter", "number"], "row_no")


def role_rules(column: str) -> list[tuple[Column, str]]:
    """Role labels that come before any lookup."""
    key = upper_key(column)
    return [
        (key == "", rules.UNKNOWN_PARTY), (key.contains("BANCADA"), rules.ROLE_BENCH),
        (key.startswith("COM ") | key.startswith("COM.") | key.contains("COMISSAO"), rules.ROLE_COMMITTEE),
        (key.contains("RELATOR"), rules.ROLE_RAPPORTEUR),
    ]


def with_party(df: DataFrame, members: Sequence[DataFrame]) -> DataFrame:
    """Party of the author: role rules, then the first member list that knows the name."""
    keyed = df.withColumn("_name", upper_key("author"))
    dims = [m.select(upper_key("name").alias("_n"), clean_text("party").alias("party")).filter("_n <> ''") for m in members]
    return lookups.lookup(keyed, "_name", dims, "_n", "party", rules.UNKNOWN_PARTY, role_rules("author")).drop("_name")


def supporter_group(column: str) -> Column:
    return case_when([(test, F.lit(label)) for test, label in role_rules(column)], F.lit(rules.ROLE_MEMBER))


BUDGET_SETS = {"all": [], "author": ["author"], "place": ["place"], "author_place": ["author", "place"]}


def budget_totals(rows: DataFrame, year: int | None = None, measures: Sequence[str] = ("committed", "paid")) -> DataFrame:
    """Sums by author, by place, by both and overall; current-year variants on request. Rows
    without an amount do not make a key."""
    cols = {m: F.sum(m) for m in measures}
    if year is not None:
        cols |= {f"{m}_year": F.sum(F.when(F.col("year") == year, F.col(m)).otherwise(F.lit(0).cast(MONEY))) for m in measures}
    return rollups.roll_up(rows.filter(F.col(measures[0]) != 0), BUDGET_SETS, cols)


def last_day(documents: DataFrame, *keys: str) -> DataFrame:
    return rollups.last_period_totals(documents, "date", list(keys), {"committed": F.sum("committed")}, F.col("committed") > 0)


def daily_series(documents: DataFrame) -> DataFrame:
    """Every day from 1 January with sums and running sums (restarting each year)."""
    pos = lambda c: total(F.when(F.col(c) > 0, F.col(c)))
    days = documents.filter("date is not null").groupBy(F.col("date").alias("day")).agg(pos("committed").alias("committed"), pos("paid").alias("paid"))
    spine = spines.fill_days(days, "day", ["committed", "paid"]).withColumn("year", F.year("day"))
    return windows.running_sum(spine, "day", {"committed": "committed_running", "paid": "paid_running"}, ["year"])


def growth(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str = "committed", include_vanished: bool = False) -> DataFrame:
    """Keys that grew since the last snapshot, with their share of all positive growth."""
    diff = lookups.snapshot_diff(current, previous, keys, value, include_vanished=include_vanished)
    return windows.share_of_total(diff.filter("delta > 0"), "delta")


def growth_totals(diff: DataFrame) -> DataFrame:
    return diff.agg(
        total(F.when(F.col("delta") > 0, F.col("delta"))).cast("double").alias("positive"),
        total(F.when(F.col("delta") < 0, F.col("delta"))).cast("double").alias("negative"),
        F.count_if(F.col("delta") > 0).alias("keys_up"))


def broken_days(history: DataFrame, date: str, measures: Sequence[str]) -> DataFrame:
    """How many days in a row, up to the last, a source delivered only zeros."""
    zero = F.lit(True)
    for m in measures:
        zero = zero & (F.coalesce(F.col(m), F.lit(0)) == 0)
    return windows.trailing_run(history, date, zero)


def should_skip(stored: dict, offered: dict, force: bool = False) -> bool:
    """Unchanged source version (driver-side, two short dicts)."""
    if force or not stored:
        return False
    return any(offered.get(k) and offered[k] == stored.get(k) for k in ("last_modified", "etag"))


def kpi(spent: Column, authorised: Column) -> Column:
    return ratio(spent, authorised)


def place_or_city(place: str, city: str, state: str) -> Column:
    return F.coalesce(clean_text(place), F.nullif(join_nonempty(city, state, sep=" - "), F.lit("")), F.lit(NO_PLACE))
