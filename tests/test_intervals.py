"""Keyed intervals as dyadic ranges."""
import datetime as dt
import random

from pyspark.sql import functions as F

from civisight.operators import lookups

DAY = dt.date(1960, 1, 1)


def test_few_ranges_for_long_intervals(spark):
    rows = [(i, DAY + dt.timedelta(a), DAY + dt.timedelta(b)) for i, (a, b) in enumerate([(0, 10949), (1, 10950), (7, 7), (5, 4), (-400000, 900000), (4095, 8192)])]
    df = spark.createDataFrame(rows, "i int, s date, e date").select("i", "s", "e", lookups.dyadic_ranges(F.col("s"), F.col("e")).alias("r"))
    for r in df.collect():
        days = sorted(d for x in r.r for d in range(x.block << x.level, (x.block + 1) << x.level)) if r.i != 4 else None
        first = (r.s - dt.date(1970, 1, 1)).days + lookups._ZERO
        length = (r.e - r.s).days + 1
        if days is not None:
            assert days == list(range(first, first + length))  # each day once
        if r.i < 2:
            assert len(r.r) < 30  # thirty years of days
        if r.i == 3:
            assert r.r == []


def test_first_of_overlapping_intervals(spark):
    rng = random.Random(5)
    day = lambda: DAY + dt.timedelta(rng.randrange(9000))
    spans = []
    for i in range(400):
        s = day()
        spans.append((rng.choice([1, 2, 3, None]), i, s, None if i % 11 == 0 else s + dt.timedelta(rng.randrange(-5, 3000)), f"l{i}"))
    facts = [(n, rng.choice([1, 2, 3, 4, None]), None if n % 50 == 0 else day()) for n in range(1500)]
    facts += facts[:20]
    got = lookups.interval_join(
        spark.createDataFrame(facts, "n int, k int, d date"), "d", spark.createDataFrame(spans, "k int, o int, s date, e date, role string"),
        "s", "e", "o", "role", "none", F.lit(DAY + dt.timedelta(8000)), ["k"])

    def first(k, d):
        last = DAY + dt.timedelta(8000)
        fits = [(o, role) for key, o, s, e, role in spans if k is not None and key == k and d and s <= d <= min(e or last, last)]
        return min(fits)[1] if fits else "none"

    assert sorted((r.n, r.role) for r in got.collect()) == sorted((n, first(k, d)) for n, k, d in facts)


def test_exploded_ranges_are_not_broadcast(spark):
    facts = spark.range(50).selectExpr("id % 5 as k", "date_add(date'1990-01-01', cast(id as int)) as d")
    spans = spark.range(20).selectExpr("id % 5 as k", "id as o", "date'1989-01-01' as s", "cast(null as date) as e", "'r' as role")
    got = lookups.interval_join(facts, "d", spans, "s", "e", "o", "role", "none", F.lit(DAY), ["k"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in line and "strategy=merge" in line for line in plan.splitlines())


def test_ranges_are_not_shuffled(spark):
    """Days and intervals are dealt out by key before they are taken apart: no exchange reads exploded rows."""
    facts = spark.range(50).selectExpr("id % 5 as k", "date_add(date'1990-01-01', cast(id as int)) as d")
    spans = spark.range(20).selectExpr("id % 5 as k", "id as o", "date'1989-01-01' as s", "cast(null as date) as e", "'r' as role")
    got = lookups.interval_join(facts, "d", spans, "s", "e", "o", "role", "none", F.lit(dt.date(1990, 1, 20)), ["k"])
    executed = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    (at,) = [i for i, line in enumerate(executed) if "Generate explode" in line]
    above = [line for i, line in enumerate(executed[:at]) if depth(line) < min(depth(x) for x in executed[i + 1:at + 1])]
    assert sum("Exchange" in line for line in above) <= 1  # that of what was found, by key and day
    assert sorted(r.role for r in got.collect()) == ["none"] * 30 + ["r"] * 20
