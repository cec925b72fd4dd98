"""Near-duplicate components on large families over many chunks, null ids and repeated ids."""
import random

from tests.llm.brute import components, shingles
from civisight.llm import ngram_join
from civisight.llm.common import Shelf
from civisight.llm.ngram_join import ngram_components, ngram_dedup


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def _family(rng, base, size, changes):
    for _ in range(size):
        words = list(base)
        for i in rng.sample(range(len(base)), changes):
            words[i] = "".join(rng.choice("klmnop") for _ in range(6))
        yield " ".join(words)


def test_large_families(spark):
    rng = random.Random(9)
    base, wide = _words(rng, 150), _words(rng, 160)
    texts = list(_family(rng, base, 2000, 2)) + list(_family(rng, wide, 120, 2)) + list(_family(rng, wide, 120, 3)) + [" ".join(_words(rng, 60)) for _ in range(100)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    got = {r.doc_id: r.component_id for r in ngram_components(docs).collect()}
    # brute force over the pairs of a family only: texts of different families share nothing
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    families = {}
    for i, t in rows:
        mine = set(t.split())
        families.setdefault("base" if len(mine & set(base)) > 100 else "wide" if len(mine & set(wide)) > 100 else i, []).append(i)
    below = 0
    for ids in families.values():
        for n, p in enumerate(ids):
            for q in ids[:n]:
                a, b = root(p), root(q)
                if a != b:
                    both = len(sets[p] & sets[q])
                    if 100 * both >= 80 * (len(sets[p]) + len(sets[q]) - both):
                        up[max(a, b)] = min(a, b)
                    else:
                        below += 1
    assert below > 1000  # many pairs of a family miss the threshold
    assert got == {i: root(i) for i in sets}


def test_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c = (_words(rng, 60) for _ in range(3))
    near = lambda w: " ".join(["other", *w[1:]])
    rows = [(None, " ".join(a)), (7, near(a)), (3, " ".join(b)), (3, " ".join(c)), (9, near(b)), (2, near(c)), (None, "lonely words here"), (None, None), (11, "")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 56, 7), (7, 56, 7), (3, 56, 3), (3, 56, 2), (9, 56, 3), (2, 56, 2),
                                           (None, 1, None), (None, 0, None), (11, 0, 11)], key=str)
    assert components([(1, None)]) == {1: (0, 1)}
    kept = [r.doc_id for r in ngram_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert kept.count(7) == 1 and 9 not in kept and 11 in kept


def test_chance_bands_do_not_make_one_family(spark, monkeypatch):
    """Sets chained by single bands are not one family, sets that share several bands stay one."""
    monkeypatch.setattr(ngram_join, "CELL", 20)
    monkeypatch.setattr(ngram_join, "SUPPORTS", (2,))
    chain = [(1000 + i, node) for i in range(59) for node in (i, i + 1)]
    dense = [(9000 + b, 5000 + i) for b in range(3) for i in range(30)]
    got = {r.node: r.family for r in ngram_join._families(Shelf(spark), spark.createDataFrame(chain + dense, "band long, node long")).collect()}
    assert len(got) == 90 and len({got[i] for i in range(60)}) == 60 and len({got[5000 + i] for i in range(30)}) == 1


def test_components_with_small_blocks_and_rounds(spark, monkeypatch):
    """Families that are cut, bands between them, and cells dealt in rounds give the components of the plain version."""
    for name, value in (("CELL", 4), ("SUPPORTS", (2, 16)), ("ROUND", 150), ("ROUND_TOKENS", 3000), ("HOT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, rows = random.Random(12), []
    for _ in range(4):
        base, tail = _words(rng, 45), _words(rng, 9)
        for t in _family(rng, base, 9, 1):
            words = t.split()
            rows.append((len(rows), " ".join(words + tail if rng.random() < 0.5 else words[:rng.randint(36, 45)])))
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), star_rounds=0).collect()}
    assert got == {i: c for i, (_, c) in components(rows).items()}
