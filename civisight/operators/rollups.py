"""Counts, sums and rates over one or many key sets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions.money import ratio
from civisight.functions.text import ColumnOrName, as_col, case_when
from civisight.operators.windows import numbered


def roll_up(df: DataFrame, sets: dict[str, Sequence[str]], measures: dict[str, Column]) -> DataFrame:
    """The same additive measures over many key sets, in one scan.

    Facts are first aggregated to the finest key, so the row multiplication of GROUPING
    SETS meets a small table. ``grain`` names the key set; columns outside it are null.
    """
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    finest = df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    grain_of = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): n for n, s in sets.items()}
    grain = case_when([(F.grouping_id() == gid, F.lit(name)) for gid, name in grain_of.items()], F.lit(None).cast("string"))
    return finest.groupingSets([[F.col(k) for k in s] for s in sets.values()], *[F.col(k) for k in keys]).agg(
        grain.alias("grain"), *[F.sum(n).alias(n) for n in measures])


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: dict[str, str]) -> DataFrame:
    """One count column per listed value."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(name) for v, name in values.items()])


def value_counts(df: DataFrame, columns: Sequence[str], mask: Column | None = None, name: str = "n") -> DataFrame:
    chosen = df if mask is None else df.filter(mask)
    return chosen.groupBy(*columns).agg(F.count("*").alias(name))


def merge_partials(partials: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Stored yearly partials to one table."""
    return partials.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def dense_numbers(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """(key, number): the distinct keys numbered without gaps, as bitmaps need them to be small."""
    return numbered(df.select(key).filter(F.col(key).isNotNull()).distinct(), [F.col(key)], name)


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Partial of an exact distinct count that can be stored and merged: (keys, bucket, bits), a bit per number."""
    return df.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def merge_bitmaps(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored partials, of several periods say, to partials per key."""
    return partials.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_counts(partials: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact number of distinct numbers per key; a number in several partials counts once."""
    return merge_bitmaps(partials, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def roll_up_distinct(df: DataFrame, sets: dict[str, Sequence[str]], number: str, name: str) -> DataFrame:
    """Exact distinct counts over many key sets: facts become bits within tasks, so one shuffle moves bitmaps."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    work = df.select(*keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"))
    grain_of = {sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in s): n for n, s in sets.items()}
    grain = case_when([(F.grouping_id() == gid, F.lit(label)) for gid, label in grain_of.items()], F.lit(None).cast("string"))
    bits = work.groupingSets([[F.col(k) for k in (*s, "bucket")] for s in sets.values()], *[F.col(k) for k in (*keys, "bucket")]).agg(
        grain.alias("grain"), F.bitmap_construct_agg("_bit").alias("bits"))
    return bits.groupBy("grain", *keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def rates(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Safe ratios: output name to (numerator, denominator)."""
    return df.withColumns({n: ratio(a, b) for n, (a, b) in pairs.items()})


def last_period_totals(df: DataFrame, date: str, keys: Sequence[str], measures: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Totals of the most recent day in the data."""
    latest = df.agg(F.max(date)).scalar()
    day = df.filter(F.col(date) == latest)
    return (day if where is None else day.filter(where)).groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def all_or_nothing_sum(df: DataFrame, ok: str, measures: Sequence[str], required: str) -> DataFrame:
    """Totals over filters, only when every filter worked and the required one is above zero."""
    summed = df.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("_ok"), *[F.sum(m).alias(m) for m in measures])
    good = F.col("_ok") & F.coalesce(F.col(required) > 0, F.lit(False))
    return summed.select(good.alias("accepted"), *[F.when(good, F.col(m)).alias(m) for m in measures])


def count_flags(df: DataFrame, flags: dict[str, ColumnOrName]) -> DataFrame:
    """Diagnostics: rows per flag, in one aggregation."""
    return df.agg(*[F.count_if(as_col(c)).alias(n) for n, c in flags.items()])
