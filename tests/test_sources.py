"""Landed files in the encodings and shapes they come in."""
import datetime as dt
import gzip
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from civisight.operators import search
from civisight.sources import readers, sinks


def test_delimited_with_bom_and_year(spark, tmp_path):
    for year in (2019, 2020):
        (tmp_path / f"votes-{year}.csv").write_text("﻿id;name\n" + "".join(f"{i};n{i}\n" for i in range(3)), encoding="utf-8")
    df = readers.read_delimited(spark, str(tmp_path / "votes-*.csv"), year_pattern=r"votes-(\d{4})")
    assert df.columns == ["id", "name", "row_no", "year"]
    rows = df.orderBy("row_no").select("year", "id").collect()
    assert [(r.year, r.id) for r in rows] == [(y, str(i)) for y in (2019, 2020) for i in range(3)]


def test_utf16_with_bad_line(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Id;Texto\n1;"a\nb"\n2;x;extra\n3;ç\n', encoding="utf-16")
    df = readers.read_delimited(spark, str(tmp_path / "r.csv"), encoding="UTF-16", multiline=True, drop_malformed=True)
    assert {(r.Id, r.Texto) for r in df.collect()} == {("1", "a\nb"), ("3", "ç")}


def test_preamble(spark, tmp_path):
    (tmp_path / "reg.csv").write_text("﻿Atualizado em: 2024-05-06\nMARCA;UF;NOME\nPTABC;SP;Ana\nPTXYZ;RJ;\n", encoding="utf-8")
    df = readers.read_with_preamble(spark, str(tmp_path / "reg.csv"))
    assert [(r.MARCA, r.UF, r.source_date) for r in df.orderBy("row_no").collect()] == [
        ("PTABC", "SP", dt.date(2024, 5, 6)), ("PTXYZ", "RJ", dt.date(2024, 5, 6))]


def test_zip_member(spark, tmp_path):
    for name, encoding in (("a", "latin-1"), ("b", "utf-8-sig")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("leia.txt", "x")
            z.writestr("Dados.CSV", "Órgão;Valor (R$);Resto\nSaúde;1,5;z\nJustiça;2;z;too many\nFim;3\n".encode(encoding))
    df = readers.read_zip_member(spark, str(tmp_path / "*.zip"), ["ORGAO", "valor r", "absent"], skip_malformed=True)
    rows = sorted((r.archive[-5:], r.row_no, r.ORGAO, r["valor r"], r.absent) for r in df.collect())
    assert rows == [(a, n, o, v, None) for a in ("a.zip", "b.zip") for n, o, v in ((0, "Saúde", "1,5"), (2, "Fim", "3"))]
    assert readers.pick_member(["x.csv", "Emendas_Convenios.csv", "Emendas.csv"], ["emendas"], ["convenios"]) == "Emendas.csv"
    assert readers.pick_member(["a.txt"]) is None


def test_jsonl_state_corpus(spark, tmp_path):
    with gzip.open(tmp_path / "r.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"id": "1", "n": 2}\n{broken\n{"id": "2"}\n')
    df = readers.read_jsonl(spark, str(tmp_path / "r.jsonl.gz"), "id string, n int")
    assert {(r.id, r.n) for r in df.collect()} == {("1", 2), ("2", None)}
    empty = readers.read_state(spark, str(tmp_path / "none"), "id string")
    assert empty.columns == ["id"] and empty.count() == 0
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "BR-1.txt").write_text("a\nb")
    row = readers.read_text_corpus(spark, str(folder)).first()
    assert (row.file_name, row.doc_key, row.text) == ("BR-1.txt", "BR-1", "a\nb")


def test_text_corpus_by_folder_of_task(spark, tmp_path):
    texts = {i: f"a{i}\r\n\n b " + "x" * i for i in range(60)}
    sinks.write_text_corpus(spark.createDataFrame(list(texts.items()), "k int, t string"), str(tmp_path / "c"), "t", "k")
    folders = [f for f in (tmp_path / "c").iterdir() if f.is_dir()]
    assert 1 < len(folders) <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # not a folder per text
    assert sum(len(list(f.glob("*.txt"))) for f in folders) == len(texts)  # but a file
    assert sorted(r.text for r in readers.read_text_corpus(spark, str(tmp_path / "c")).collect()) == sorted(t + "\n" for t in texts.values())


def test_text_corpus_many_files_in_a_task(spark, tmp_path):
    """Tasks take as many files as fill them; bytes, nulls and what is at the path already are treated as by Spark."""
    path = str(tmp_path / "c")
    rows = [(i, None if i == 7 else "" if i == 8 else f"é{i}\r\n") for i in range(300)]
    sinks.write_text_corpus(spark.createDataFrame(rows, "k int, t string"), path, "t", "k")
    got = readers.read_text_corpus(spark, path)
    assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.text for r in got.collect()) == sorted((t or "") + "\n" for _, t in rows)
    plain = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name").collect()
    assert sorted((r.value, r.file_name) for r in plain) == sorted((r.text, r.file_name) for r in got.collect())
    assert {r.doc_key + ".txt" for r in got.collect()} == {r.file_name for r in got.collect()}
    with pytest.raises(AnalysisException):
        sinks.write_text_corpus(spark.createDataFrame(rows, "k int, t string"), path, "t", "k")
    packed = tmp_path / "packed"
    packed.mkdir()
    with gzip.open(packed / "a.txt.gz", "wt", encoding="utf-8") as f:
        f.write("zipped")
    (packed / "_hidden.txt").write_text("no")
    assert [(r.doc_key, r.text) for r in readers.read_text_corpus(spark, str(packed)).collect()] == [("a.txt", "zipped")]
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "b.txt").write_bytes(b"\xff\xfea")
    assert [bytes(r.b) for r in readers.read_text_corpus(spark, str(odd)).selectExpr("cast(text as binary) as b").collect()] == [b"\xff\xfea"]


def test_feeds(spark):
    docs = spark.createDataFrame([('{"dados": [{"nome": "Ana", "partido": "X"}, {"nome": "Bia"}]}',)], "doc string")
    flat = readers.flatten_json(docs, "doc", "dados array<struct<nome:string,partido:string>>", "dados")
    assert [(r.nome, r.partido) for r in flat.collect()] == [("Ana", "X"), ("Bia", None)]
    xml = spark.createDataFrame([("<L><P><N>Ana</N></P><P><N>Bia</N></P></L>",)], "doc string")
    rows = readers.flatten_xml(xml, "doc", "P array<struct<N:string>>", "P", "L")
    assert [r.N for r in rows.collect()] == ["Ana", "Bia"]


def test_resolve_columns(spark):
    headers = ["DATA INICIO SANCAO EXTRA", "Data Início Sanção", "ÓRGÃO SANCIONADOR", "NOME DO ÓRGÃO SANCIONADOR"]
    spec = {"start": {"contains": [["DATA", "INICIO"]]}, "exact": {"exact": ["DATA INICIO SANCAO EXTRA"]}, "body": {"contains": [["ORGAO", "SANCIONADOR"]]}, "none": {"contains": [["XYZ"]]}}
    assert readers.resolve_columns(headers, spec) == {
        "start": "Data Início Sanção", "exact": "DATA INICIO SANCAO EXTRA", "body": "ÓRGÃO SANCIONADOR", "none": None}
    df = spark.createDataFrame([(" a ", "b", "c", "d")], headers)
    assert tuple(readers.select_resolved(df, spec).first()) == ("b", "a", "c", None)
    assert readers.select_available(df, ["orgao sancionador", "nada"]).first() == ("c", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "", ["x"]), ("2", "b", []), ("", "", [])], "id string, v string, a array<string>")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.gz") for x in gzip.open(p, "rt")]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": "1", "a": ["x"]}, {"id": "2", "v": "b"}]
    sinks.write_table_csv(df, str(tmp_path / "c"), ["v", "id"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert '"v";"id"' in text and '"b";"2"' in text
    sinks.write_report({"t": df}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "t")).count() == 3


def test_partition_refresh(spark, tmp_path):
    path = str(tmp_path / "years")
    sinks.write_partitions(spark.createDataFrame([(2019, 1), (2020, 2)], "year int, n int"), path, ["year"])
    sinks.write_partitions(spark.createDataFrame([(2020, 5), (2020, 6)], "year int, n int"), path, ["year"])
    assert {(r.year, r.n) for r in spark.read.parquet(path).collect()} == {(2019, 1), (2020, 5), (2020, 6)}
    assert sinks.refresh_partitions([2018, 2019, 2020, 2021], {2018: 3, 2019: 2, 2020: 3, 2021: 3}, 3, 2021) == [2019, 2021]
    assert sinks.refresh_partitions([2018], {2018: 3}, 3, 2021, force=True) == [2018]


def test_upsert_and_index(spark, tmp_path):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert {(r.k, r.v) for r in sinks.upsert(target, updates, ["k"], "o").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    docs = spark.createDataFrame([(1, "Ação ação fim"), (2, "fim")], "d int, t string")
    search.write_index(search.build_index(docs, "d", ["t"]), "d", str(tmp_path / "ix"), buckets=4)
    stored = spark.read.parquet(str(tmp_path / "ix"))
    assert {(r.d, r.tf) for r in search.search_index(stored, "d", ["fim", "Acao"]).collect()} == {(1, 3)}
    assert stored.filter(F.col("token") == "fim").count() == 2


def test_headers_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    (tmp_path / "b.csv").write_text("b;a\n8;9\n")
    (tmp_path / "c.csv").write_text("a;c\n5;6\n")
    df = readers.read_delimited(spark, str(tmp_path / "*.csv"))
    assert {(r.a, r.b, r.c) for r in df.collect()} == {("1", "2", None), ("9", "8", None), ("5", None, "6")}


def test_preamble_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date: 2024-05-06\nX;Y\nDate;2\n")
    (tmp_path / "b.csv").write_text("Date: 07/06/2024\nY;X\n4;3\n")
    df = readers.read_with_preamble(spark, str(tmp_path / "*.csv"))
    assert {(r.X, r.Y, r.source_date) for r in df.collect()} == {("Date", "2", dt.date(2024, 5, 6)), ("3", "4", dt.date(2024, 6, 7))}


def test_zip_odd_members(spark, tmp_path):
    assert readers.pick_member(["z_data.csv", "a_data.csv"], ["data"]) == "a_data.csv"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d.csv", ("Nome;NOME;x\n" + "a;b;" + "l" * 200_000 + "\n").encode("utf-16"))
    row = readers.read_zip_member(spark, str(tmp_path / "a.zip"), ["nome", "x"], skip_malformed=True).collect()
    assert [(r.nome, len(r.x)) for r in row] == [("a", 200_000)]


def test_heavy_partition_is_split(spark, tmp_path):
    """90 % of rows in one partition value and on one token: no writer takes most of them."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("part"), F.sha1(F.col("id").cast("string")).alias("v")).repartition(8)
        sinks.write_partitions(rows, str(tmp_path / "p"), ["part"])
        files = spark.read.parquet(str(tmp_path / "p")).filter("part = 99").groupBy(F.col("_metadata.file_path")).count().collect()
        assert len(files) > 4 and max(r["count"] for r in files) < 90_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bucketed_upsert_rewrites_touched_buckets(spark, tmp_path):
    """A hundred updates to a million rows rewrite a hundred buckets at most."""
    path = str(tmp_path / "t")
    rows = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("o"), F.lit("old").alias("v"))
    sinks.upsert_buckets(rows, path, ["k"], "o", buckets=512)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    updates = spark.range(100).select((F.col("id") * 9973).alias("k"), F.lit(1).cast("long").alias("o"), F.lit("new").alias("v"))
    again = updates.unionByName(updates.withColumns({"o": F.lit(0).cast("long"), "v": F.lit("stale")}))
    n = sinks.upsert_buckets(again, path, ["k"], "o", buckets=512)
    after = files()
    same = {p.parent.name for p in before if after.get(p) == before[p]}
    assert 80 <= n <= 100 and len(same) == 512 - n
    stored = sinks.read_buckets(spark, path, rows.schema)
    assert tuple(stored.agg(F.count("*"), F.count_distinct("k"), F.count_if("v" == F.lit("x")), F.count_if(F.col("v") == "new")).first()) == (1_000_000, 1_000_000, 0, 100)
    assert sinks.upsert_buckets(updates.limit(0), path, ["k"], "o") == 0
    older = updates.withColumns({"o": F.lit(-1).cast("long"), "v": F.lit("late")})
    sinks.upsert_buckets(older, path, ["k"], "o", buckets=512, newest=True)
    assert sinks.read_buckets(spark, path, rows.schema).filter("v = 'late'").isEmpty()


def test_numbers_of_a_whole_table(spark):
    from civisight.operators.windows import numbered, rank_page

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = numbered(rows, [F.col("g").desc(), F.col("k")]).orderBy("position").collect()
    assert [(r.g, r.k) for r in got] == sorted([(r.g, r.k) for r in rows.collect()], key=lambda r: (-r[0], r[1]))
    assert [r.position for r in got] == list(range(1, 5001))
    assert {r.k for r in rank_page(rows, [F.col("k")], 250, 20).collect()} == set(range(4980, 5000))
    assert numbered(rows.limit(0), [F.col("k")]).collect() == []
