"""Operators 6 and 9, and the pipeline."""
from civisight.llm.decontamination import decontaminate, template_matches
from civisight.llm.licenses import license_matches

ITEM = "A train leaves Paris at 9 and travels 120 km before Anna counts the remaining luggage of all passengers."


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, item_id string")


def test_templates(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "Short question here?"), (3, None), (4, ""), (1, ITEM)], "item_id long, text string")
    changed = ITEM.replace("Paris", "Rome").replace("9", "7").replace("120", "85").replace("Anna", "Carla")
    mixed = "The 9 and the 9: a train leaves Paris at 9 and travels 9 km before Anna counts the remaining luggage of all passengers."
    rows = [(1, f"Before it. {ITEM} After it."), (2, f"Noise.\n{changed}"), (3, "Nothing of the kind."), (4, None), (5, ""), (6, ITEM.lower()),
            (7, " ".join(ITEM.split()[:7])), (8, mixed), (9, "short question here"), (10, "word " * 5000 + ITEM)]
    got = {(r.doc_id, r.item_id): r.changed for r in template_matches(_docs(spark, rows), items).collect()}
    assert got[1, 1] is False and got[2, 1] is True and got[10, 1] is False and got[9, 2] is False
    assert (7, 1) not in got and (3, 1) not in got
    assert (8, 1) not in got  # one value for two different slots
    kept = {r.doc_id for r in decontaminate(_docs(spark, rows), items).collect()}
    assert {3, 4, 5, 7} <= kept and not {1, 2, 10} & kept
    none = items.filter("false")
    assert template_matches(_docs(spark, rows), none).collect() == []
    assert template_matches(_docs(spark, []), items).collect() == []


def test_types_are_the_items(spark):
    """Verbatim copies count in any case and after any token; a name is typed by its place in the item."""
    short, twice = "What is the capital of Peru today?", "Yesterday our old neighbour Anna bought pears. Anna gave her little sister most of them."
    items = spark.createDataFrame([(1, ITEM), (2, short), (3, twice)], "item_id long, text string")
    rows = [(1, ITEM.lower()), (2, ITEM.upper()), (3, f"Question {short}"), (4, twice.replace("Anna", "Carla")), (5, twice.replace("Anna", "carla")),
            (6, ITEM.replace("120", "many")), (7, ITEM.lower().replace("before", "after").replace("train", "bus"))]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.changed) for r in template_matches(_docs(spark, rows), items).collect()}
    assert got == {(1, 1): (12, False), (2, 1): (12, False), (3, 2): (1, False), (4, 3): (8, True), (5, 3): (8, True)}


def test_licenses(spark):
    rows = [(1, "Text. All rights reserved. More."), (2, "# Licensed under the Apache License, Version 2.0 (the \"License\");\nNothing"),
            (3, "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License. "
                "You may obtain a copy of the License at:"),
            (4, None), (5, ""), (6, "RELEASED UNDER THE MIT LICENSE!\nReleased under the MIT License."), (7, "all rights reserved by nobody")]
    got = {(r.doc_id, r.license_id): (r.n_matches, r.first_sentence) for r in license_matches(_docs(spark, rows)).collect()}
    assert got == {(1, "All-rights-reserved"): (1, 1), (3, "Apache-2.0-header"): (1, 0), (6, "MIT"): (2, 0)}


def test_pipeline(spark):
    import corpus_pipeline
    from civisight.llm.quality import quality_scores

    import brute

    folder = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality_scores(documents, labels).filter("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in documents.collect() if r.doc_id in good}
    last = {}
    for i, t in sorted(rows.items()):
        last[brute.ascii_lower(t)] = i
    rows = {i: rows[i] for i in last.values()}
    rows = {i: t for i, t in rows.items() if brute.components(list(rows.items()))[i][1] == i}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i for i, t in rows.items() if not any(" ".join(x) in " ".join(t.lower().split()) for x in items)}
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == clean
