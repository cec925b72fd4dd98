"""Operators 1, 7, 8 and 10 against plain versions."""
import hashlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from civisight.llm.exact_dedup import exact_dedup, exact_groups
from civisight.llm.line_dedup import line_dedup
from civisight.llm.ngram_join import _bands, _met, _sets, band_keys, ngram_components, ngram_dedup, size_bounds
from civisight.llm.substring_dedup import substring_dedup


def test_exact_groups(docs, texts):
    low = [(i, brute.ascii_lower(t or "")) for i, t in texts]
    groups = {}
    for i, t in low:
        groups.setdefault(t, []).append(i)
    want = Counter((i, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in low)
    rows = exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_keeps_columns(docs):
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 400 not in ids and 403 in ids and 100 in ids and 0 not in ids


def test_long_equal_beginnings(spark):
    head = "same " * 30_000
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (None, head + "b")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 3, 2, False), (3, 3, 2, True), (2, 2, 2, True), (None, 2, 2, False)}


def test_components(docs, texts):
    want = brute.components(list(dict(texts).items()))
    rows = ngram_components(docs).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    kept = {r.doc_id for r in ngram_dedup(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


@pytest.mark.parametrize("size", [5, 9, 30, 41, 146, 600, 3000])
def test_linked_sets_meet_in_a_band(size):
    """The pigeonhole promise, at the largest difference a link allows."""
    rng = np.random.default_rng(size)
    bounds = size_bounds(10_000)
    for _ in range(30):
        a = np.unique(rng.integers(1, 2**63, size).astype(np.uint64))
        grow = rng.integers(0, len(a) // 4 + 1)
        swap = max(0, (2 * len(a) + grow) // 9 - grow) // 2
        b = np.unique(np.append(a[swap:], rng.integers(1, 2**63, swap + grow).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert np.intersect1d(band_keys(a, bounds, 80), band_keys(b, bounds, 80)).size


def test_hot_bands(spark):
    """A large group of near copies that no single hub links."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2000)]
    base = [words[i] for i in rng.integers(0, 2000, 60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 60))] = words[int(rng.integers(0, 2000))]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_band_hot_in_one_chunk_and_cold_in_another():
    """Documents of one template, not linked to each other, and one in another chunk that is linked to all of them."""
    base = [f"t{i}" for i in range(164)]
    chunk = lambda ids, own: pa.RecordBatch.from_pylist([{"doc_id": i, "text": " ".join(base + [f"d{i}x{j}" for j in range(own)])} for i in ids])
    family, other, bounds = chunk(range(150), 22), chunk([1000], 5), size_bounds(364)
    sets = [{r["node"] for b in _sets(iter([x]), 5) for r in b.to_pylist()} for x in (family, other)]
    blobs = [tuple(r.values()) for x in (family, other) for b in _bands(iter([x]), 5, 80, bounds, 4) for r in b.to_pylist()]
    met = {}
    for part in range(4):
        for batch in _met([r for r in blobs if r[0] == part]):
            for r in batch.to_pylist():
                met.setdefault(r["band"], set()).add(r["node"])
    assert set().union(*(m for m in met.values() if m >= sets[1])) == sets[0] | sets[1]


def test_substrings(docs, texts):
    rows = substring_dedup(docs).collect()
    want = brute.substring_dedup(list(dict(texts).items()))
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
    assert {r.kept_text for r in rows if r.doc_id == 400} == {None}


def test_lines(spark):
    rows = [(1, "a\nb\nc\n\nd"), (2, "x\n b \n\nc\ny"), (3, "a\nb\nc"), (4, "b\nb\nb"), (5, None), (6, ""), (7, "c\nd\nz"), (8, "lone\nb"), (9, "b\nb\nb")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (5, 0, "a\nb\nc\n\nd"), 2: (5, 2, "x\n\ny"), 3: (3, 3, ""), 4: (3, 2, "b"), 5: (0, 0, None), 6: (1, 0, ""),
                   7: (3, 2, "z"), 8: (2, 0, "lone\nb"), 9: (3, 3, "")}


@pytest.mark.parametrize("operator", [exact_groups, ngram_components, substring_dedup, line_dedup])
def test_no_rows(nothing, operator):
    assert operator(nothing).collect() == []
