"""Registry and sanction searches: candidates by n-grams against a plain search over all pairs."""
import random
import re

from pyspark.sql import functions as F

from civisight.functions.text import fold_text
from civisight.operators import search


def _people(n):
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouãé") for _ in range(rng.randint(2, 4)))
    return [(i, f"{part()} {part()} {part()}", f"{rng.randrange(10**11):011d}", rng.random() < .5) for i in range(n)]


def test_a_thousand_queries_score_only_their_hits(spark):
    people = _people(3000)
    rng = random.Random(1)
    queries = [rng.choice([name, name.split(" ")[1] + " " + name.split(" ")[2], doc, doc[2:9], "zz" + doc[:4]]) for _, name, doc, _ in people[:1000]]
    queries = list(dict.fromkeys(queries))
    rows = spark.createDataFrame(people, "key int, name string, doc string, act boolean")
    got = {(r.query, r.key) for r in search.search_sanctions(rows, queries, "name", "doc", "act", ["name"], "key", limit=4000).collect()}
    want = set()
    for q in queries:
        digits, norm = re.sub(r"\D", "", q), fold_text(q)
        want |= {(q, k) for k, name, doc, _ in people if len(digits) >= 5 and digits in doc or len(norm) >= 3 and norm in fold_text(name)}
    assert got == want and len(want) >= 600

    keyed = rows.withColumns({"_text": search.fold("name"), "_digits": F.col("doc")})
    asked = search._queries(spark, queries, {"d": lambda r: [r["digits"]] if len(r["digits"]) >= 5 else None, "t": lambda r: [r["norm"]]})
    pairs = search.candidates(keyed, [("d", F.col("_digits"), [3]), ("t", F.col("_text"), [3])], asked).count()
    assert pairs <= 20 * len(want) < len(queries) * len(people) / 100  # the rarest of a thousand trigrams of digits still has some others


def test_short_and_odd_queries(spark):
    rows = spark.createDataFrame([("PT-AB", "Óleo & Cia", "123", None, None), ("PR-XYZ", "B #9", "77", "a|5|50", "x"), ("", None, None, None, None)],
                                 "prefix string, operator string, document string, owners string, cancel_date string")
    rows = rows.withColumns({"model": F.lit("m-1"), "manufacturer": F.lit(None).cast("string"), "icao_type": F.lit("Q")})
    found = search.search_registry(rows, ["a", "pt", "#", "óleo cia", "PR-XYZ b", "", "nothing here", "b #9", "q"], 10)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], set()).add(r["prefix"])
    assert got == {"a": {"PT-AB", "PR-XYZ"}, "pt": {"PT-AB"}, "#": {"PR-XYZ"}, "óleo cia": {"PT-AB"}, "PR-XYZ b": {"PR-XYZ"},
                   "b #9": {"PR-XYZ"}, "q": {"PT-AB", "PR-XYZ", ""}}


def test_records_of_one_scan_task_are_spread(spark, tmp_path):
    spark.createDataFrame(_people(50), "key int, name string, doc string, act boolean").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    found = search.search_sanctions(rows, ["an", "ana"], "name", "doc", "act", ["name"], "key")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
