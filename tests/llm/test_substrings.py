"""Substring dedup with repeated ids, null ids and a passage in every document."""
import hashlib
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.brute import WORD
from civisight.llm.common import _CLEAN, Shelf
from civisight.llm.substring_dedup import substring_dedup


def brute_rows(rows, k=13):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for p in range(len(w) - k + 1):
                key = tuple(w[p:p + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - k + 1):
                if first[tuple(w[p:p + k])] < i:
                    gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def test_rows_against_plain_version(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    everywhere, some = say(20), [say(40) for _ in range(5)]
    rows = [(i, f"{say(rng.randrange(30))} {everywhere} {rng.choice(some)[rng.randrange(20):]} {say(5)}") for i in range(300)]
    rows += [(i % 40, f"{say(8)} {some[i % 5]} {everywhere}") for i in range(80)]  # repeated ids with other texts
    rows += [(None, everywhere), (None, f"{some[0]} {everywhere}"), (-5, some[1]), (7, None), (8, ""), (9, "short text")]
    rows += rows[:30]  # repeated rows
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, bucket string").repartition(6)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()]
    count = lambda x: sorted(x, key=str)
    assert count(got) == count(brute_rows(rows))
    removed = defaultdict(int)
    for i, _, n, _ in got:
        removed[i] += n
    assert removed[None] == 0 and removed[-5] == 0 and sum(removed.values()) > 300 * 20


def test_what_a_written_table_has_shuffled_goes_with_the_write(spark):
    """Shuffle files of a settled table do not stay on the disk until the driver collects its garbage."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in str(blocks.getAllBlocks().mkString(" ")).split() if b.startswith("shuffle_")}
    clean, before = spark.conf.get(_CLEAN, "false"), shuffles()
    table = Shelf(spark).put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 5
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(_CLEAN, "false") == clean and table.count() == 7
