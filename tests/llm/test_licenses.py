"""Licence scans of odd input."""
from civisight.llm.licenses import license_matches


def test_padded_long_and_repeated(spark):
    rows = [(1, "*" * 1400 + "\nAll rights reserved.\n"), (2, "/" * 5000 + " All rights reserved " + "-" * 5000), (3, "word " * 60_000 + ".\nReleased under the MIT License."),
            (4, "All rights reserved."), (4, "All rights reserved."), (None, "All rights reserved."), (5, "x"), (6, "\n\n"), (7, None)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, sentence string, number int")
    got = {(r.doc_id, r.license_id): r.n_matches for r in license_matches(docs).collect()}
    assert got == {(1, "All-rights-reserved"): 1, (2, "All-rights-reserved"): 1, (3, "MIT"): 1, (4, "All-rights-reserved"): 2, (None, "All-rights-reserved"): 1}


def test_no_rows(spark, nothing):
    assert license_matches(nothing).collect() == []
