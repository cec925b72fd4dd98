"""Monitors over several micro-batches, and over a batch that runs twice."""
import json

from pyspark.sql import functions as F

from civisight.streaming import monitors


def _land(folder, batches, schema, spark):
    """One file per batch, read one file at a time in the order of their names."""
    import os
    import time

    folder.mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"{i}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_new_key_alert(spark, tmp_path):
    batches = [[{"k": "a"}, {"k": "b"}], [{"k": "b"}, {"k": "c"}], [{"k": "a"}, {"k": "c"}]]
    stream = _land(tmp_path / "in", batches, "k string", spark)
    out = monitors.new_key_alert(stream, ["k"], str(tmp_path / "job"))
    rows = spark.read.parquet(f"{out}/*")
    # silent first run; c is new; a went away and came back
    assert {(r.batch_id, r.k) for r in rows.collect()} == {(1, "c"), (2, "a")}


def test_new_key_alert_increments(spark, tmp_path):
    batches = [[{"k": "a"}], [{"k": "b"}], [{"k": "a"}, {"k": "c"}]]
    stream = _land(tmp_path / "in", batches, "k string", spark)
    seed = spark.createDataFrame([("z",)], "k string")
    out = monitors.new_key_alert(stream, ["k"], str(tmp_path / "job"), seed, snapshot=False)
    assert {(r.batch_id, r.k) for r in spark.read.parquet(f"{out}/*").collect()} == {(0, "a"), (1, "b"), (2, "c")}


def test_state_slots_repeat(spark, tmp_path):
    slots = monitors.StateSlots(str(tmp_path))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert slots.read(spark, 0) is None
    slots.write(rows(1), 0)
    slots.write(slots.read(spark, 1).union(rows(2)), 1)
    slots.write(slots.read(spark, 1).union(rows(2)), 1)     # the batch runs again
    assert sorted(r.k for r in slots.read(spark, 2).collect()) == [1, 2]


def test_snapshot_delta(spark, tmp_path):
    batches = [
        [{"k": "a", "v": 10.0, "etag": "1"}, {"k": "b", "v": 5.0, "etag": "1"}],
        [{"k": "a", "v": 99.0, "etag": "1"}],                                        # same version: ignored
        [{"k": "a", "v": 12.0, "etag": "2"}, {"k": "c", "v": 1.0, "etag": "2"}],
    ]
    stream = _land(tmp_path / "in", batches, "k string, v double, etag string", spark)
    totals = lambda df: df.groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,2)")).alias("v"))
    out = monitors.snapshot_delta(stream, totals, ["k"], "v", str(tmp_path / "job"), version=lambda df: df.select("etag").distinct())
    rows = spark.read.parquet(f"{out}/*")
    assert {(r.batch_id, r.k, float(r.delta)) for r in rows.collect()} == {(2, "a", 2.0), (2, "c", 1.0)}
    history = spark.read.parquet(str(tmp_path / "job" / "history" / "*"))
    assert sorted((r.batch_id, r.delta_positive, r.source_changed) for r in history.collect()) == [(0, 0.0, True), (1, 0.0, False), (2, 3.0, True)]


def test_posts(spark, tmp_path):
    folder = tmp_path / "posts"
    folder.mkdir()
    posts = [("at://1", "Linha um\nresto"), ("at://2", "  ")]
    (folder / "p.json").write_text("".join(json.dumps({"post": {"uri": u, "cid": "c", "record": {"text": t, "createdAt": "2024-01-31T10:00:00Z"}}}) + "\n" for u, t in posts))
    stream = monitors.posts_to_records(monitors.read_posts(spark, str(folder)), "feed", "post", "sem título", "bsky_")
    monitors.run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={n}")), str(tmp_path / "cp"))
    row = spark.read.parquet(str(tmp_path / "out" / "*")).first()
    assert (row.title, row.word_count, str(row.date), row.id[:5], len(row.id)) == ("Linha um", 3, "2024-01-31", "bsky_", 23)


def test_append_first_seen_has_watermark(spark, tmp_path):
    stream = _land(tmp_path / "in", [[{"k": "a", "ts": "2024-01-01T00:00:00Z"}, {"k": "a", "ts": "2024-01-01T00:01:00Z"}]], "k string, ts timestamp", spark)
    first = monitors.append_first_seen(stream, ["k"], "ts", "1 day")
    monitors.run_available(first, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={n}")), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out" / "*")).count() == 1


def test_upsert_stream_resumes_and_keeps_order(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "job")
    schema = "k int, o int, v string"
    land = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    state = lambda folder: {(r.k, r.v) for r in spark.read.parquet(folder).collect()}
    land("1", [(1, 1, "old")])
    monitors.upsert_stream(stream(), ["k"], "o", path)
    land("2", [(1, 2, "new"), (2, 1, "b")])
    first = monitors.upsert_stream(stream(), ["k"], "o", path)
    assert state(first) == {(1, "new"), (2, "b")}
    assert state(monitors.upsert_stream(stream(), ["k"], "o", path)) == {(1, "new"), (2, "b")}  # nothing new
    land("3", [(1, 1, "stale"), (3, 1, "c")])
    assert state(monitors.upsert_stream(stream(), ["k"], "o", path)) == {(1, "new"), (2, "b"), (3, "c")}


def test_upsert_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k int, o int, v string").parquet(str(tmp_path / "in"))
    out = monitors.upsert_stream(stream, ["k"], "o", str(tmp_path / "job"))
    assert spark.read.parquet(out).select("k", "o", "v").collect() == []
    seed = spark.createDataFrame([(1, 1, "a")], "k int, o int, v string")
    out = monitors.upsert_stream(stream, ["k"], "o", str(tmp_path / "seeded"), seed)
    assert [(r.k, r.v) for r in spark.read.parquet(out).collect()] == [(1, "a")]


def test_new_key_increments_keep_spark_state(spark, tmp_path):
    """A later run of the stream reports only keys that no earlier run has met; the state is Spark's."""
    src, path = tmp_path / "in", str(tmp_path / "job")
    land = lambda name, keys: spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.parquet(str(src / name))
    stream = lambda: spark.readStream.schema("k string").parquet(str(src / "*"))
    land("1", "ab")
    monitors.new_key_alert(stream(), ["k"], path, snapshot=False)
    land("2", "bcc")
    out = monitors.new_key_alert(stream(), ["k"], path, snapshot=False)
    assert [(r.batch_id, r.k) for r in spark.read.parquet(f"{out}/*").collect()] == [(1, "c")]
    assert (tmp_path / "job" / "checkpoint" / "state").is_dir() and not (tmp_path / "job" / "state").exists()
