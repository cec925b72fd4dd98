"""Date expressions: dirty formats, dates and places in prose, month and week keys."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civisight.functions.text import ColumnOrName, as_col, case_when, clean_text, fold

# Portuguese month names, accent-free.
MONTH_NAMES = (
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)
# Label spellings on output.
MONTH_LABELS = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)
WEEKDAY_LABELS = (
    "segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo",
)


def parse_date(c: ColumnOrName, formats: Sequence[str] = ("dd/MM/yyyy", "yyyy-MM-dd", "dd/MM/yy")) -> Column:
    """First format that fits, else null. Two-digit years follow the 1969-2068 rule."""
    text = clean_text(c)
    tries = []
    for fmt in formats:
        parsed = F.try_to_date(text, fmt)
        if "yy" in fmt and "yyyy" not in fmt:
            parsed = F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
        tries.append(parsed)
    return F.coalesce(*tries)


def parse_timestamp(c: ColumnOrName, formats: Sequence[str] = (
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy",
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
    "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z",
)) -> Column:
    """Local, ISO and RFC-822 spellings, in that order."""
    text = clean_text(c)
    tries = []
    for fmt in formats:
        if fmt.startswith("EEE, "):
            # the week day is redundant and Spark's parser does not take it
            bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
            tries.append(F.try_to_timestamp(bare, F.lit(fmt.removeprefix("EEE, "))))
        else:
            tries.append(F.try_to_timestamp(text, F.lit(fmt)))
    return F.coalesce(*tries)


def _month_number(name: Column) -> Column:
    flat = fold(name)
    return case_when([(flat == label, F.lit(f"{number:02d}")) for number, label in enumerate(MONTH_NAMES, 1)], F.lit(None).cast("string"))


# Patterns of dates in prose.
_LETTERS = r"[a-zA-ZçÇãÃáÁàÀâÂéÉêÊíÍóÓôÔõÕúÚ]+"
_PROSE = rf"(?i)(?<![\w])(\d{{1,2}}|1º)\s+de\s+({_LETTERS})\s+de\s+(\d{{4}})\b"
_NUMERIC = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"


def date_in_text(c: ColumnOrName) -> Column:
    """First possible date in a text: spelled-out dates win over numeric ones."""
    text = F.coalesce(clean_text(c), F.lit(""))

    def spelled(hit: Column) -> Column:
        day = F.lpad(F.regexp_replace(F.regexp_extract(hit, _PROSE, 1), "º", ""), 2, "0")
        return F.try_to_date(
            F.concat_ws("-", F.regexp_extract(hit, _PROSE, 3), _month_number(F.regexp_extract(hit, _PROSE, 2)), day), "yyyy-MM-dd"
        )

    def numeric(hit: Column) -> Column:
        year = F.regexp_extract(hit, _NUMERIC, 3).try_cast("int")
        year = F.when(year < 100, year + 2000).otherwise(year)
        return F.try_to_date(
            F.concat_ws(
                "-", F.lpad(year.cast("string"), 4, "0"),
                F.lpad(F.regexp_extract(hit, _NUMERIC, 2), 2, "0"), F.lpad(F.regexp_extract(hit, _NUMERIC, 1), 2, "0"),
            ), "yyyy-MM-dd",
        )

    def first(pattern: str, build) -> Column:
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)
        return F.try_element_at(F.filter(hits, lambda d: d.isNotNull()), F.lit(1))

    return F.coalesce(first(_PROSE, spelled), first(_NUMERIC, numeric))


def prose_date(candidates: Sequence[ColumnOrName], url: ColumnOrName, last_year: int, first_year: int = 1880) -> Column:
    """struct(date, source): first dated candidate, else 1 January of a year in the URL."""
    # one lambda for all candidates keeps the generated code small
    dates = F.transform(F.array(*[as_col(c) for c in candidates]), lambda c: date_in_text(c))
    found = F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
    years = F.filter(
        F.transform(F.regexp_extract_all(F.coalesce(as_col(url), F.lit("")), F.lit(r"\b((?:18|19|20)\d{2})\b"), F.lit(1)),
                    lambda y: y.try_cast("int")),
        lambda y: y.between(first_year, last_year),
    )
    year = F.try_element_at(years, F.lit(1))
    from_url = F.try_to_date(F.concat(year.cast("string"), F.lit("-01-01")), "yyyy-MM-dd")
    return F.struct(
        F.coalesce(found, from_url).alias("date"),
        F.when(found.isNotNull(), "text").when(from_url.isNotNull(), "url-year").alias("source"),
    )


# Patterns of a place before a date.
_DAY = rf"(?:\d{{1,2}}|1º)\s+de\s+{_LETTERS}\s+de\s+\d{{4}}"
_PLACE_PATTERNS = (
    rf"(?i)^(.{{2,130}}?),\s*{_DAY}",
    r"(?i)^(.{2,130}?),\s*\d{1,2}[/-]\d{1,2}[/-]\d{4}",
    rf"(?i)\bem\s+([^,.;]{{2,120}}?)(?:,\s*(?:no dia\s*)?{_DAY}|$)",
)


def clean_place(c: ColumnOrName) -> Column:
    text = F.regexp_replace(F.coalesce(clean_text(c), F.lit("")), r"(?i)^(em|na|no|nas|nos)\s+", "")
    return F.regexp_replace(F.regexp_replace(text, r"^[ ,.;:\-]+", ""), r"[ ,.;:\-]+$", "")


def prose_place(candidates: Sequence[ColumnOrName]) -> Column:
    """First place named before a date, over candidates then patterns."""
    def place(c: Column) -> Column:
        text = F.coalesce(clean_text(c), F.lit(""))
        tries = F.array(*[F.regexp_extract(text, pattern, 1) for pattern in _PLACE_PATTERNS])
        return F.get(F.filter(F.transform(tries, lambda t: clean_place(t)), lambda p: F.length(p) >= 2), F.lit(0))

    places = F.transform(F.array(*[as_col(c) for c in candidates]), place)
    return F.get(F.filter(places, lambda p: p.isNotNull()), F.lit(0))


# -------------------------------------------------------------------- keys

def month_key(d: ColumnOrName) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")


def month_start(d: ColumnOrName) -> Column:
    return F.to_date(F.trunc(as_col(d).cast("date"), "month"))


def iso_week(d: ColumnOrName) -> Column:
    day = as_col(d)
    return F.concat(
        F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"), F.lit("-W"),
        F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"),
    )


def week_range(d: ColumnOrName) -> Column:
    """struct(start, end): Monday to Sunday of the week of a day."""
    monday = F.to_date(F.date_trunc("week", as_col(d)))
    return F.struct(monday.alias("start"), F.date_add(monday, 6).alias("end"))


def month_from_parts(year: ColumnOrName, month: ColumnOrName, fallback: ColumnOrName) -> Column:
    """``yyyy-MM`` from two text columns when both are valid, else the fallback."""
    y, m = clean_text(as_col(year).cast("string")), clean_text(as_col(month).cast("string"))
    number = m.try_cast("int")
    valid = y.rlike(r"^\d{4}$") & m.rlike(r"^\d{1,2}$") & number.between(1, 12)
    return F.when(valid, F.concat(y, F.lit("-"), F.lpad(number.cast("string"), 2, "0"))).otherwise(as_col(fallback))


def month_label(m: ColumnOrName) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), as_col(m).cast("int"))


def weekday_label(d: ColumnOrName) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), F.weekday(as_col(d)) + 1)


def years_ago(d: ColumnOrName, n: int) -> Column:
    return F.add_months(as_col(d), -12 * n)


def prev_closed_month(day: dt.date) -> dt.date:
    """First day of the month before ``day`` (driver-side parameter)."""
    first = day.replace(day=1)
    return (first - dt.timedelta(days=1)).replace(day=1)
