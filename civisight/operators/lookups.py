"""Joins and lookups.

Dimensions are joined without broadcast hints: Spark broadcasts a side it has measured
below its threshold and otherwise shuffles, where AQE splits a hot key of the fact side.
Period rules are a short driver-side list, so they become a CASE expression, not a join.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civisight.functions.money import ratio
from civisight.functions.text import ColumnOrName, as_col, case_when
from civisight.operators.windows import top_per_group


def semi_join(facts: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return facts.join(keys.select(*on), list(on), "left_semi")


def last_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last non-empty value per key."""
    return df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key).agg(F.max_by(value, order).alias(value))


def join_orientation(votes: DataFrame, events: DataFrame, advice: DataFrame, event: str = "event_id", advice_value: str = "advice", order: str = "row_no") -> DataFrame:
    """Votes of events that exist and carry advice; the last non-empty advice counts."""
    guided = events.join(last_value(advice, event, advice_value, order), event)
    return votes.join(guided, event)


def lookup(df: DataFrame, key: str, dims: Sequence[DataFrame], dim_key: str, value: str, default: str, rules: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Label by role rules first, then by the first dimension that knows the key, else default."""
    tagged = [d.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v"), F.lit(i).alias("_p")) for i, d in enumerate(dims)]
    pool = tagged[0]
    for t in tagged[1:]:
        pool = pool.unionByName(t)
    best = pool.filter(F.col("_v").isNotNull()).groupBy("_k").agg(F.min_by("_v", "_p").alias("_v"))
    chosen = case_when([(test, F.lit(label)) for test, label in rules], F.coalesce(F.col("_v"), F.lit(default)))
    return df.join(best, F.col(key) == F.col("_k"), "left").withColumn(value, chosen).drop("_k", "_v")


def period_of(date: ColumnOrName, periods: Sequence[dict], default: tuple[str, str] = ("other", "Other")) -> Column:
    """struct(id, label) of the first period that holds the day; ends inclusive, last one open."""
    def named(id_: str, label: str) -> Column:
        return F.struct(F.lit(id_).alias("id"), F.lit(label).alias("label"))

    return case_when([(_inside(date, p), named(p["id"], p["label"])) for p in periods], named(*default))


def _inside(date: ColumnOrName, period: dict) -> Column:
    day = as_col(date)
    after = day >= F.lit(period["start"]).cast("date")
    return after & (day <= F.lit(period["end"]).cast("date")) if period.get("end") else after


_ZERO, _LEVELS = 1 << 22, 24  # day numbers are counted from 11,000 years before 1970, so that they are positive


def _day_number(day: Column) -> Column:
    return F.unix_date(day) + F.lit(_ZERO)


def _block(level: int, block: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), block.alias("block"))


def _shifted(number: Column, level: int) -> Column:
    return F.call_function("shiftright", number, F.lit(level))


def dyadic_ranges(start: Column, end: Column) -> Column:
    """The days from start to end as aligned ranges of 1, 2, 4, ... days: array of (level, block).

    At each level at most one range is taken from either end, so n days make at most 2 log2 n ranges. No ranges
    for an empty interval.
    """
    low, high = _day_number(start), _day_number(end) + 1
    out = []
    for level in range(_LEVELS):
        up, down = _shifted(low + F.lit((1 << level) - 1), level), _shifted(high, level)
        out += [F.when((up < down) & (up % 2 == 1), _block(level, up)), F.when((up < down) & (down % 2 == 1), _block(level, down - 1))]
    return F.array_compact(F.array(*out))


def dyadic_prefixes(day: Column, longest: Column) -> Column:
    """The aligned ranges, of at most ``longest`` days, that hold a day: array of (level, block)."""
    number = _day_number(day)
    return F.array_compact(F.array(*[F.when(longest >= (1 << level), _block(level, _shifted(number, level))) for level in range(_LEVELS)]))


def interval_join(df: DataFrame, date: str, intervals: DataFrame, start: str, end: str, ordinal: str, label: str, default: str, horizon: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Point-in-interval join, per key: the first interval (by ``ordinal``) that holds the day, else the default.

    Intervals become O(log n) aligned ranges and days the ranges that hold them, and the ranges of a day and of an interval
    that are equal meet, so the work does not depend on the length of the intervals. Only the distinct (keys, day) of the rows are
    looked up. Days and intervals are dealt out by key first and taken apart there, so ranges are not shuffled.
    Spark takes what was found for as small as its sources and would broadcast it, so the last join asks for a shuffle.
    """
    last = F.least(F.coalesce(F.col(end), horizon), horizon)
    known = lambda rows, *more: rows.filter(" and ".join(f"`{c}` is not null" for c in (*keys, *more)))
    spans = known(intervals.select(*keys, F.struct(F.col(ordinal).alias("o"), F.col(label).alias("l")).alias("_own"), F.col(start).alias("_s"), last.alias("_e")), "_s", "_e")
    spans = spans.filter("_own.o is not null")
    longest = spans.agg(F.max(F.date_diff("_e", "_s") + 1)).scalar()
    work = df.withColumn("_day", F.col(date).cast("date"))
    asked = known(work.select(*keys, "_day"), "_day").distinct()
    both = asked.unionByName(spans, allowMissingColumns=True)
    if keys:  # by the shuffle's width: ranges are many more than the rows that Spark would merge parts by
        both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    ranges = F.when(F.col("_day").isNull(), dyadic_ranges(F.col("_s"), F.col("_e"))).otherwise(dyadic_prefixes(F.col("_day"), longest))
    met = both.select(*keys, "_day", "_own", F.explode(ranges).alias("_r"))
    first = F.min("_own").over(Window.partitionBy(*keys, "_r.level", "_r.block"))  # days have no interval of their own
    hit = met.withColumn("_first", first).filter("_day is not null and _first is not null")
    found = hit.groupBy(*keys, "_day").agg(F.min("_first").alias("_first")).select(*keys, "_day", F.col("_first.l").alias(label))
    return work.join(found.hint("merge"), [*keys, "_day"], "left").withColumn(label, F.coalesce(label, F.lit(default))).drop("_day")


def term_label(df: DataFrame, slug: str, name: str, date: str, url: str, terms: Sequence[dict], url_labels: Sequence[dict] = (), forced: Sequence[dict] = (), undated: dict[str, str] | None = None) -> DataFrame:
    """Term of office: forced by source, by URL segment, by date, by sole term, by year."""
    who, link, day = F.col(slug), F.lower(F.coalesce(F.col(url), F.lit(""))), F.col(date)
    rules = [((F.col("source") == f["source"]) & (who == f["slug"]), F.lit(f["label"])) for f in forced]
    rules += [((who == u["slug"]) & link.contains(u["segment"]), F.lit(u["label"])) for u in url_labels]
    rules += [((who == t["slug"]) & _inside(date, t), F.lit(t["label"])) for t in terms]
    by_slug: dict[str, list[str]] = {}
    for t in terms:
        by_slug.setdefault(t["slug"], []).append(t["label"])
    sole = {s: labels[0] for s, labels in by_slug.items() if len(labels) == 1} | (undated or {})
    rules += [((who == s) & day.isNull(), F.lit(label)) for s, label in sole.items()]
    rules.append((day.isNotNull(), F.concat(F.col(name), F.lit(" ("), F.year(day).cast("string"), F.lit(")"))))
    out = case_when(rules, F.concat(F.col(name), F.lit(" (term unknown)")))
    return df.withColumn("term", out)


def best_by_priority(df: DataFrame, key: str, priority: ColumnOrName, order: str) -> DataFrame:
    """One row per key: highest priority, first in order."""
    return top_per_group(df, [key], [as_col(priority).desc(), F.col(order).asc()], 1)


def snapshot_diff(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str, eps: float = 0.005, include_vanished: bool = False) -> DataFrame:
    """Change per key beyond ``eps``. Keys that vanished count only on request."""
    before = previous.select(*keys, F.col(value).alias("_before"))
    joined = current.select(*keys, value).join(before, list(keys), "full" if include_vanished else "left")
    now, old = F.coalesce(F.col(value), F.lit(0)), F.coalesce(F.col("_before"), F.lit(0))
    return joined.select(*keys, now.alias(value), old.alias("previous"), (now - old).alias("delta")).filter(F.abs("delta") > F.lit(eps))


def new_keys(current: DataFrame, seen: DataFrame, keys: Sequence[str], first_run: bool = False) -> DataFrame:
    """Rows whose key was not seen; nothing on the first run, which only seeds the state."""
    fresh = current.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return fresh.filter(F.lit(False)) if first_run else fresh


def changed_rows(local: DataFrame, remote: DataFrame, key: str, version: str) -> DataFrame:
    """Rows that are absent from, or differ in version to, the remote side."""
    there = remote.select(F.col(key), F.col(version).alias("_v"), F.lit(True).alias("_there"))
    return (
        local.join(there, key, "left").filter(F.col("_there").isNull() | ~F.col(version).eqNullSafe(F.col("_v")))
        .select(*local.columns)
    )


def pending(df: DataFrame, cache: DataFrame, key: str, required: Sequence[str], status: str = "status", failed: Sequence[str] = ("error",), done: Sequence[str] = ()) -> DataFrame:
    """Rows to (re)do: not cached, failed, or cached without the required fields."""
    have = cache.select(F.col(key), F.struct(status, *required).alias("_c"))
    missing = F.lit(False)
    for f in required:
        missing = missing | F.col("_c")[f].isNull()
    state = F.col("_c")[status]
    redo = F.col("_c").isNull() | F.coalesce(state.isin(list(failed)), F.lit(False)) | missing
    if done:
        redo = redo & ~F.coalesce(state.isin(list(done)), F.lit(False))
    return (
        df.join(have, key, "left").filter(redo)
        .withColumn("reason", F.when(F.col("_c").isNull(), "absent").when(state.isin(list(failed)), "failed").otherwise("incomplete"))
        .drop("_c")
    )


def coalesce_snapshot(current: DataFrame, previous: DataFrame, key: str, available: str = "available") -> DataFrame:
    """Keep the previous payload of a source whose current one failed, and flag it."""
    fields = [c for c in current.columns if c not in (key, available)]
    old = previous.select(F.col(key), F.col(available).alias("_pa"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    use_old = ~F.coalesce(F.col(available), F.lit(False)) & F.coalesce(F.col("_pa"), F.lit(False))
    return current.join(old, key, "left").select(
        key, *[F.when(use_old, F.col(f"_p_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        (F.coalesce(F.col(available), F.lit(False)) | use_old).alias(available), use_old.alias("fallback_from_previous"),
    )


def override_metric(base: DataFrame, better: DataFrame, key: str, metrics: Sequence[str], old_suffix: str = "_declared") -> DataFrame:
    """Better source wins where present; the old value stays under another name."""
    new = better.select(F.col(key), *[F.col(m).alias(f"_b_{m}") for m in metrics])
    out = base.join(new, key, "left")
    return out.withColumns({f"{m}{old_suffix}": F.col(m) for m in metrics}).withColumns(
        {m: F.coalesce(F.col(f"_b_{m}"), F.col(m)) for m in metrics}).drop(*[f"_b_{m}" for m in metrics])


def merge_candidates(rows: DataFrame, key: str, order: str, first_fields: Sequence[str], title: str | None = None, description: str | None = None, lists: Sequence[str] = (), min_description: int = 40) -> DataFrame:
    """One record per key: first non-empty wins, a weak title or short description gives
    way to a later one, label lists are united in order of first appearance."""
    from civisight.operators.clean import is_placeholder

    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    aggs = [F.min_by(F.col(f), F.when(filled(f), F.col(order))).alias(f) for f in first_fields]
    if title:
        aggs.append(F.coalesce(
            F.min_by(F.col(title), F.when(~is_placeholder(title), F.col(order))),
            F.max_by(F.col(title), F.when(filled(title), F.col(order)))).alias(title))
    if description:
        aggs.append(F.coalesce(
            F.min_by(F.col(description), F.when(F.length(description) >= min_description, F.col(order))),
            F.max_by(F.col(description), F.when(filled(description), F.col(order)))).alias(description))
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), *aggs)
    for f in lists:
        # distinct labels first, so that a hot key collects its labels and not its rows
        labels = rows.filter(filled(f)).groupBy(key, f).agg(F.min(order).alias("_o"))
        united = labels.groupBy(key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col(f).alias("_v")))), lambda s: s["_v"]).alias(f"{f}s"))
        out = out.join(united, key, "left").withColumn(f"{f}s", F.coalesce(f"{f}s", F.array().cast("array<string>")))
    return out


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page url, resolved link, text), one row per page and link, first text kept."""
    from civisight.functions.html import links, without_code
    from civisight.functions.urls import absolute_url

    rows = pages.select(F.col(url).alias("page_url"), F.posexplode(links(without_code(html))).alias("pos", "link"))
    rows = rows.select("page_url", "pos", absolute_url("page_url", "link.href").alias("href"), F.col("link.text").alias("text"))
    return rows.groupBy("page_url", "href").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))


def reconcile(a: ColumnOrName, b: ColumnOrName, good: float = 0.02, fair: float = 0.05) -> Column:
    """struct(diff, pct, verdict) of two totals of the same thing."""
    x, y = as_col(a).cast("double"), as_col(b).cast("double")
    gap = ratio(F.abs(x - y), F.greatest(x, y))
    verdict = (
        F.when((x == 0) | (y == 0), "unavailable").when(gap <= good, "match").when(gap <= fair, "moderate").otherwise("diverge")
    )
    return F.struct((x - y).alias("diff"), gap.alias("pct"), verdict.alias("verdict"))


def annotate_present(result: DataFrame, notes: DataFrame, key: str, note: str) -> DataFrame:
    """Notes for keys that occur in a result."""
    return result.select(key).distinct().join(notes.select(key, note), key)


# ------------------------------------------------------------ filters before a shuffle

def key_bits(keys: DataFrame, column: str, words: int = 1 << 14) -> Column:
    """A bit table of the hashes of keys(column) as one scalar: 64 * ``words`` bits, however many keys there are.

    ``may_hold`` tests a value against it where the value is read, so that rows without a partner are gone before
    a join shuffles them; a row that passes by chance is left to the join.
    """
    place = F.pmod(F.xxhash64(column), F.lit(64 * words))
    bits = keys.select(place.alias("_p")).groupBy(F.expr("_p div 64").alias("_i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_b"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("_i"), F.lit(0).cast("long").alias("_b"))
    table = bits.unionByName(every).groupBy("_i").agg(F.bit_or("_b").alias("_b"))
    return table.agg(F.array_sort(F.collect_list(F.struct("_i", "_b")))["_b"].alias("_t")).scalar()


def may_hold(bits: Column, value: ColumnOrName, words: int = 1 << 14) -> Column:
    """Whether a value may be among the keys of ``key_bits`` (of the same number of words)."""
    place = F.pmod(F.xxhash64(value), F.lit(64 * words))
    word = F.get(bits, (place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
