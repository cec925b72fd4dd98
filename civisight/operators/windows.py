"""Row-order operators: dedupe, carry-forward, running totals, deflator, runs, shares."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civisight.functions.money import ratio
from civisight.functions.text import ColumnOrName, as_col
from civisight.session import settle


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group. Spark keeps at most k rows per group and task before
    the shuffle, so a hot group does not travel whole."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return top_per_group(df, keys, [F.col(order).asc()], 1)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return top_per_group(df, keys, [F.col(order).desc()], 1)


def carry_forward(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str, chunk: ColumnOrName,
    defaults: dict[str, str] | None = None,
) -> DataFrame:
    """Fill nulls with the last earlier non-null value of the same key.

    ``chunk`` cuts a key's rows into consecutive pieces (it must not decrease along
    ``order``), so no task holds a whole key: each piece is filled on its own, and a small
    table of one row per (key, piece) carries values over the cuts.
    """
    work = df.withColumn("_chunk", as_col(chunk))
    piece = [*keys, "_chunk"]
    tails = work.groupBy(*piece).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_tail_{c}") for c in columns
    ])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(*piece, *[F.last(f"_tail_{c}", ignorenulls=True).over(earlier).alias(f"_head_{c}") for c in columns])
    within = Window.partitionBy(*piece).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = work.join(heads, piece, "left")
    defaults = defaults or {}
    values = {}
    for c in columns:
        parts = [F.last(c, ignorenulls=True).over(within), F.col(f"_head_{c}")]
        if c in defaults:
            parts.append(F.lit(defaults[c]))
        values[c] = F.coalesce(*parts)
    return filled.withColumns(values).select(*df.columns)


def latest_known(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str, defaults: dict[str, str] | None = None, first: bool = False) -> DataFrame:
    """Latest (or first) value per key that is neither null nor the default."""
    defaults = defaults or {}
    pick = F.min_by if first else F.max_by
    aggs = []
    for c in columns:
        known = F.col(c).isNotNull() & (F.col(c) != F.lit(defaults[c])) if c in defaults else F.col(c).isNotNull()
        best = pick(F.col(c), F.when(known, F.col(order)))
        aggs.append((F.coalesce(best, F.lit(defaults[c])) if c in defaults else best).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def running_sum(spine: DataFrame, order: str, sums: dict[str, str], partition: Sequence[str] = ()) -> DataFrame:
    """Running totals over a filled calendar: a spine has one row per day, never fact rows."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    return spine.withColumns({out: F.sum(src).over(w) for src, out in sums.items()})


def deflator(rates: DataFrame, month: str = "month", rate: str = "rate") -> DataFrame:
    """Factor to the last month: product of (1 + rate/100) of all later months, last month 1."""
    later = Window.partitionBy().orderBy(month).rowsBetween(1, Window.unboundedFollowing)
    step = 1 + F.coalesce(F.col(rate).cast("double"), F.lit(0.0)) / 100
    return rates.withColumn("factor", F.round(F.coalesce(F.product(step).over(later), F.lit(1.0)), 6))


def cumulative_first_n(series: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Running total of the first N periods of every group, N being the shortest group."""
    n = series.groupBy(group).count().agg(F.min("count"))
    w = Window.partitionBy(group).orderBy(order)
    return (
        series.withColumn("step", F.row_number().over(w))
        .withColumn("running", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("step") <= n.scalar())
    )


def trailing_run(df: DataFrame, order: str, holds: Column) -> DataFrame:
    """Length of the last unbroken run of rows that satisfy a predicate (one row)."""
    last_broken = df.filter(~holds).agg(F.max(order))
    return (
        df.withColumn("_last", last_broken.scalar())
        .agg(F.count_if(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).alias("trailing_run"))
    )


def with_gap(spine: DataFrame, order: str) -> DataFrame:
    """Date of the previous snapshot and days since (a history of at most some hundred rows)."""
    prev = F.lag(order).over(Window.partitionBy().orderBy(order))
    return spine.withColumn("previous", prev).withColumn("interval_days", F.coalesce(F.date_diff(F.col(order), F.col("previous")), F.lit(0)))


def missing_months(spine: DataFrame, month: str) -> DataFrame:
    """Months skipped between consecutive rows of a monthly series."""
    prev = F.lag(month).over(Window.partitionBy().orderBy(month))
    gap = F.months_between(F.col(month), prev).cast("bigint") - 1
    return spine.withColumn("missing_before", F.coalesce(gap, F.lit(0)))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in an order over the whole table; the order must tell all rows apart.

    Rows are dealt out by range and sorted within partitions; a partition's rows begin where those of the partitions
    before it end, a running sum over one count per partition. No task sees more than its own range.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(sorted_)  # so that counts and rows are of the same ranges
    part, row = F.call_function("shiftrightunsigned", F.col("_at"), F.lit(33)), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.withColumns({"_part": part, "_row": row}).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_row") + 1).drop("_at", "_part", "_row", "_start")


def rank_page(df: DataFrame, order: Sequence[Column], page: int | Column, size: int) -> DataFrame:
    """Rows of one result page with their position; every page costs the same."""
    number = F.lit(page) if isinstance(page, int) else page
    ranked = numbered(df, order)
    return ranked.filter((F.col("position") > (number - 1) * size) & (F.col("position") <= number * size))


def last_page(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """The page that holds the last rows."""
    return rank_page(df, order, F.ceil(df.agg(F.count("*")).scalar() / size), size)


def share_of_total(df: DataFrame, value: str, out: str = "share", by: Sequence[str] = ()) -> DataFrame:
    """Value over the total of its group, or over the grand total (a scalar, not a window)."""
    if by:
        totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
        return df.join(totals, list(by)).withColumn(out, ratio(value, "_total")).drop("_total")
    return df.withColumn("_total", df.agg(F.sum(value)).scalar()).withColumn(out, ratio(value, "_total")).drop("_total")
