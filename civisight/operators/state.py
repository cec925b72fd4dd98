"""State tables between runs: every function takes the previous state and returns the next.

``now``, ``first_run`` and source versions are parameters, so a run can be repeated.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.operators.sets import unchanged
from civisight.operators.windows import dedupe_last


def history_upsert(history: DataFrame, row: DataFrame, date: str, since: dt.date | None = None) -> DataFrame:
    """The new row replaces one of the same date; nothing else goes, unless a first date to keep is given."""
    kept = history.join(row.select(date), date, "left_anti").unionByName(row, allowMissingColumns=True)
    return kept if since is None else kept.filter(F.col(date) >= F.lit(since))


def history_row(diff: DataFrame, totals: Column, date: dt.date, source_changed: bool, kinds: Sequence[str], positive_from: str) -> DataFrame:
    """Today's history row out of per-dimension deltas (``dimension``, ``delta``); zero deltas
    when the source did not change."""
    on = F.lit(source_changed)
    up = F.col("delta") > 0
    mine = F.col("dimension") == positive_from
    return diff.agg(
        F.lit(date).alias("date"),
        F.when(on, F.coalesce(F.sum(F.when(mine & up, F.col("delta"))), F.lit(0))).otherwise(0).cast("double").alias("delta_positive"),
        F.when(on, F.coalesce(F.sum(F.when(mine, F.col("delta"))), F.lit(0))).otherwise(0).cast("double").alias("delta_net"),
        totals.cast("double").alias("total"),
        *[F.when(on, F.count_if((F.col("dimension") == k) & up)).otherwise(0).alias(f"{k}_up") for k in kinds],
        on.alias("source_changed"),
    )


def touch_seen(state: DataFrame, observed: DataFrame, key: str, now: Column) -> DataFrame:
    """Keep first-seen, refresh last-seen of observed keys, keep the rest as it is."""
    obs = observed.select(key).distinct().withColumn("_obs", F.lit(True))
    return state.select(key, "first_seen", "last_seen").join(obs, key, "full").select(
        key, F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("_obs"), now).otherwise(F.col("last_seen")).alias("last_seen"))


def must_refetch(fetch_ok: Column, title_weak: Column, force: Column) -> Column:
    """Refetch rule: never fetched well, weak title, or a forced page family."""
    return ~F.coalesce(fetch_ok, F.lit(False)) | F.coalesce(title_weak, F.lit(True)) | F.coalesce(force, F.lit(False))


TERMINAL = ("ok", "image_only", "not_supplied")


def next_targets(wanted: DataFrame, state: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    """Keys to process: no state yet, or failed when a retry is asked for."""
    stop = [*TERMINAL] + ([] if retry_errors else ["error"])
    return wanted.join(state.filter(F.col("status").isin(stop)).select(key), key, "left_anti")


def observed_status(outcome: Column, text: Column, min_chars: int = 200) -> Column:
    """ok / image_only / not_supplied / error of one attempt."""
    return (
        F.when((outcome == "ok") & (F.length(F.trim(F.coalesce(text, F.lit("")))) < min_chars), "image_only")
        .when(outcome == "ok", "ok").when(outcome == "not_supplied", "not_supplied").otherwise("error"))


def advance_status(state: DataFrame, observed: DataFrame, key: str, order: str, retry_errors: bool = False) -> DataFrame:
    """Next state: an observation counts only for keys that were due; the last one wins."""
    due = next_targets(observed, state, key, retry_errors)
    latest = dedupe_last(due, [key], order)
    kept = state.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*state.columns), allowMissingColumns=True)


def count_failures(state: DataFrame, observed: DataFrame, key: str, ok: str, limit: int | None = None) -> DataFrame:
    """One more failure per failed key, zero after a success; ``blocked`` at the limit.
    ``observed`` has one row per key."""
    obs = observed.select(key, F.col(ok).alias("_ok"))
    before = F.coalesce("failures", F.lit(0))
    after = F.when(F.col("_ok").isNull(), before).when(F.col("_ok"), F.lit(0)).otherwise(before + 1)
    out = state.select(key, "failures").join(obs, key, "full").select(key, after.cast("bigint").alias("failures"))
    return out.withColumn("blocked", F.col("failures") >= limit) if limit else out


def change_stamp(previous: DataFrame, current: DataFrame, stamp: Column, now: Column) -> DataFrame:
    """One row: the old timestamp when nothing changed, else now. Data sets are compared by fingerprint."""
    return unchanged(current, previous).select(F.when(F.col("same"), stamp).otherwise(now).alias("changed_at"), (~F.col("same")).alias("changed"))


def incremental_by_period(state: DataFrame, loads: DataFrame, period: str, archive: str, first: str, last: str) -> DataFrame:
    """Stored periods plus new ones. A period found in several archives is taken whole from
    the last of them; a reloaded period replaces the stored one; out-of-range ones go."""
    winner = loads.groupBy(period).agg(F.max(archive).alias(archive))
    fresh = loads.join(winner, [period, archive], "left_semi")
    kept = state.join(winner.select(period), period, "left_anti")
    return kept.unionByName(fresh.select(*state.columns), allowMissingColumns=True).filter(F.col(period).between(first, last))


def missing_periods(spine: DataFrame, state: DataFrame, period: str) -> DataFrame:
    return spine.join(state.select(period).distinct(), period, "left_anti")
