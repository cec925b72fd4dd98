import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from civisight.llm.hard_negatives import LEAF, _tiles, best, hard_negatives, strassen


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (3, 70, 130), (65, 64, 257), (40, 33, 41), (5, 0, 4)):
        a, b = rng.integers(-2**40, 2**40, (m, k)), rng.integers(-2**17, 2**17, (k, n))
        assert (strassen(a, b, leaf=4) == a @ b).all()


def test_best_breaks_ties_by_id():
    scores = np.array([[5, 5, 5, 1], [0, 2, 0, 2]])
    row, column = best(scores, scores > 0, np.array([9, 3, 4, 1]), 2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 3), (1, 1)]


def brute(rows, every):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * c) for c in v]
        seen[i, label] = min(seen.get((i, label), x), x)
    found = []
    for (a, la), x in seen.items():
        if a % every:
            continue
        score = {k: sum(p * q for p, q in zip(x, y)) for k, y in seen.items()}
        order = sorted(score, key=lambda k: (-score[k], k[0]))
        for p in [k for k in order if k[1] == la and k[0] != a][:5]:
            near = [k for k in order if k[1] != la and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:5]
            found += [(a, p[0], r + 1, k[0], score[p], score[k]) for r, k in enumerate(near)]
    return found


def test_against_plain_version(spark):
    rng = random.Random(2)
    rows = [(None, [1.0], 1), (7, None, 1), (14, [1.0, None], 1), (21, [float("nan")], 1), (28, [float("inf")], 2), (35, [1.0], None), (42, [], 3)]
    for i in range(1, 900):
        label = 0 if i % 3 else rng.randrange(5)  # one label holds most rows
        rows.append((i * 5, [float(np.float32(rng.gauss(0, 1) + (d == label))) for d in range(9 if i % 50 else 6)], label))
    rows += [(5000 + i, [2.0] * 9, i % 2) for i in range(40)]  # ties
    rows += rows[-60:]  # repeated rows
    docs = spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, tile string, anchor int")
    got = [tuple(r) for r in hard_negatives(docs, anchor=F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(brute(rows, 20)) and len(got) > 200


def test_no_anchors_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []


def test_tiles_of_anchors_are_large_enough_for_the_recursion():
    rows = [(label, i, i % 10 == 0, [i, label]) for label in (1, 2) for i in range(2000)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("label", "id", "anchor", "vector"), r)) for r in rows])
    tiles = [t for b in _tiles(iter([batch])) for t in b.to_pylist()]
    anchors = [t for t in tiles if t["anchor"]]
    assert [len(t["ids"]) // 8 for t in anchors] == [200, 200] and LEAF < 200
    assert sum(len(t["ids"]) // 8 for t in tiles if not t["anchor"]) == 4000 and len({t["tile"] for t in tiles}) == len(tiles)
