"""Archives and preamble files by the data source, many headers by one job."""
import zipfile

from pyspark.sql import functions as F

from civisight.sources import landed, readers


def test_preamble_oddities(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date: 2024-05-06\nX;Y\nX;Y\n"one\ntwo";"a;b"\nDate: 2024-05-06\n\nlast;1\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Date: 07/06/2024\n")  # one line
    (tmp_path / "c.csv").write_text("﻿no date\nY;Z\n5;6\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("")
    got = {(r.file[-5:], r.row_no, r.X, r.Y, r.source_date) for r in landed.read_preamble(spark, str(tmp_path), ["X", "y"]).withColumnRenamed("y", "Y").collect()}
    assert got == {("a.csv", 0, "X", "Y", "2024-05-06"), ("a.csv", 1, "one\ntwo", "a;b", "2024-05-06"), ("a.csv", 2, "Date: 2024-05-06", None, "2024-05-06"),
                   ("a.csv", 4, "last", "1", "2024-05-06"), ("c.csv", 0, None, "5", None)}
    inferred = readers.read_with_preamble(spark, str(tmp_path / "*.csv"))
    assert set(inferred.columns) == {"X", "Y", "Z", "row_no", "source_date"} and inferred.count() == 5


def test_every_member_is_a_partition(spark, tmp_path):
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            for m in range(4):
                z.writestr(f"Data_{m}.csv", f"Órgão;n\nSaúde {a};{m}\n".encode("latin-1" if m % 2 else "utf-8"))
            z.writestr("notes.txt", "x")
    df = landed.read_archives(spark, str(tmp_path), ["orgao", "n", "absent"], every_member=True)
    assert df.rdd.getNumPartitions() == 12
    assert {(r.orgao, r.n, r.absent) for r in df.collect()} == {(f"Saúde {a}", str(m), None) for a in range(3) for m in range(4)}
    one = landed.read_archives(spark, str(tmp_path / "*.zip"), ["n"], contains=["data"], excludes=["_0", "_1"])
    assert {r.n for r in one.collect()} == {"2"}


def test_round_trip_with_quotes(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("string").alias("k"), F.expr("concat('a;b \"q\"\\n', id, ' é')").alias("v")).repartition(3)
    landed.write_archives(rows, str(tmp_path / "z"))
    landed.write_preamble(rows, str(tmp_path / "p"), "Updated 2020-01-02")
    want = {(r.k, r.v) for r in rows.collect()}
    assert {(r.k, r.v) for r in landed.read_archives(spark, str(tmp_path / "z"), ["k", "v"]).collect()} == want
    back = landed.read_preamble(spark, str(tmp_path / "p"), ["v", "k"]).collect()
    assert {(r.k, r.v) for r in back} == want and {r.source_date for r in back} == {"2020-01-02"}
    assert not list((tmp_path / "z").glob("_*"))


def test_two_thousand_files_by_one_job(spark, tmp_path):
    heads = ["a;b", "b;a", "c;b;a"]
    for i in range(2000):
        names = heads[i % 3].split(";")
        (tmp_path / f"f{i:04d}.csv").write_text(heads[i % 3] + "\n" + ";".join(f"{n}{i}" for n in names) + "\n")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    df = readers.read_delimited(spark, str(tmp_path / "*.csv"))
    jobs = len(sc.statusTracker().getJobIdsForGroup("headers"))
    sc.setJobGroup("none", "none")
    assert jobs <= 1 + 2 + len(heads)  # the first lines; the rest are listings of many paths, one per scan
    rows = df.agg(F.count("*"), F.count_if(F.expr("a = concat('a', substr(b, 2))")), F.count("c")).first()
    assert tuple(rows) == (2000, 2000, 666)


def test_archives_grow_in_number_not_in_size(spark):
    import __spark_entry__

    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert __spark_entry__.queries()["document_archives"](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
