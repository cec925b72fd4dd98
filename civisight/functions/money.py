"""Money and number expressions. Sums run on decimals, so they do not depend on row order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civisight.functions.text import ColumnOrName, as_col, clean_text

MONEY = "decimal(20,2)"


def parse_money(c: ColumnOrName) -> Column:
    """``R$ 1.234,56`` to a decimal; anything unreadable is zero."""
    text = F.coalesce(clean_text(c), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"R\$|[ .]", ""), ",", ".")
    text = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.coalesce(text.try_cast(MONEY), F.lit(0).cast(MONEY))


def money(c: ColumnOrName) -> Column:
    return as_col(c).cast(MONEY)


def safe_int(c: ColumnOrName) -> Column:
    """Whole number, or zero when the text is not one."""
    text = clean_text(as_col(c).cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def optional_int(c: ColumnOrName) -> Column:
    text = clean_text(as_col(c).cast("string"))
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num/den as a double; zero when the denominator is not positive."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def pct(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """Percentage, unrounded; zero when the whole is not positive."""
    return ratio(part, whole) * 100


def pct_diff(value: ColumnOrName, base: ColumnOrName) -> Column:
    """Change against a base in percent; zero when there is no base."""
    v, b = as_col(value).cast("double"), F.coalesce(as_col(base).cast("double"), F.lit(0.0))
    return F.when(b != 0, (v - b) / b * 100).otherwise(F.lit(0.0))


def total(c: ColumnOrName) -> Column:
    """Sum of money, zero over no rows."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0).cast(MONEY))
