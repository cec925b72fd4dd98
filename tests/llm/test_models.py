"""Operators 2 to 5: round trips, plain sums and held-out accuracy."""
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from civisight.llm import lm_score
from civisight.llm.common import Shelf
from civisight.llm.langid import predict_languages
from civisight.llm.lm_score import lm_scores
from civisight.llm.packing import pack_documents, patterns, tokenizer_path
from civisight.llm.quality import quality_filter, quality_scores

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = pack_documents(docs, per_rank=7).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    seen, sequences = Counter(), {}
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, p) for p in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    times = Counter(i for i, _ in texts)
    assert seen == {(i, p): times[i] for i, x in ids.items() for p in range(len(x))}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_demand(seed):
    rng = np.random.default_rng(seed)
    sizes, demand = np.unique(rng.integers(1, 65, 400 * (seed + 1)), return_counts=True)
    plan = patterns(sizes, demand, 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all((p * sizes).sum() <= 64 for p, _ in plan)
    free = []
    for size in sorted(np.repeat(sizes, demand).tolist(), reverse=True):  # first fit decreasing
        at = next((i for i, f in enumerate(free) if f >= size), None)
        if at is None:
            free.append(64)
            at = -1
        free[at] -= size
    assert sum(t for _, t in plan) <= len(free) * 1.01 + 1


def test_quality_held_out(real):
    documents, labels = real
    rows = {r.doc_id: r for r in quality_scores(documents, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert quality_filter(documents, labels).columns == documents.columns


def test_quality_without_labels(docs, spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(docs, none).collect()
    assert len(rows) == len(texts) and {r.score for r in rows} == {0.5}


def test_languages_held_out(real, spark):
    documents, _ = real
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "123 -- 4", "fr"), (90003, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict_languages(documents.select("doc_id", "text", "lang").unionByName(odd), max_docs=100).collect()}
    assert {got[i].lang_pred for i in (90001, 90002, 90003)} == {"und"}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in documents.collect() if got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) >= 0.99 * len(held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)


def test_languages_without_labels(docs, spark):
    rows = predict_languages(docs.withColumn("lang", docs["lang"].substr(9, 0)).where("false").select("doc_id", "text", "lang")).collect()
    assert rows == []
    plain = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in predict_languages(plain).collect()] == [("und", 0.0)]


def test_lm_base_scores(docs, texts):
    counts, tokens = Counter(), {}
    for i, t in texts:
        tokens[i] = brute.WORD.findall(brute.ascii_lower(t or "")) + [None]
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    rows = lm_scores(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]), n)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_lm_beats_base_on_held_out_texts(real):
    held = lm_scores(real[0]).filter("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_of_unseen_words_is_a_distribution(spark):
    """Over all one-word texts the model's probabilities sum to less than one."""
    rows = [(i, "abc abd") for i in range(40)]
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0]
    letters = [chr(97 + i) for i in range(26)]
    rows += [(held[i], w) for i, w in enumerate(letters + [a + b for a in letters for b in letters])]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out and doc_id >= 1000").collect()
    assert 0 < sum(10 ** r.score for r in got) < 1


def test_lm_models_learn_from_all(spark):
    """Kinds and mixer weights come from all training texts and words, not from the first few."""
    texts = ["the cat sat on the mat"] * 5 + ["der Hund lag auf dem Sofa"] * 25
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    (one,) = (kinds := lm_score.learn_kinds(train, Shelf(spark), 2, 1)).logs
    counts = np.array(sorted(Counter(w for t in texts for w in t.lower().split()).values())) + 0.5
    assert len(kinds.prior) == 1 and np.sort(np.exp(one)) == pytest.approx(counts / counts.sum())
    both = lm_score.learn_kinds(train, Shelf(spark), 2, 30)
    assert sorted(np.exp(both.prior) * 32 - 1) == pytest.approx([5, 25])

    words = [f"w{i:03d}" for i in range(50)]
    word, pair = np.zeros(50, lm_score._WORD), np.zeros(50, lm_score._PAIR)
    word["hash"], word["size"], pair["word"], pair["train"] = np.arange(50), 4, np.arange(50), 1
    index = list(lm_score._index([(0, 0, word.tobytes(), pair.tobytes(), "".join(words).encode(), np.int64(0).tobytes())], 1))
    tables = np.zeros((lm_score._FIRST[-1], 2), np.float32)
    (learned,) = lm_score._weights(iter(index), tables, 10)
    assert set(learned.column(2).to_pylist()) == {50.0}


@pytest.mark.parametrize("operator", [pack_documents, predict_languages, lm_scores])
def test_no_rows(nothing, operator):
    assert operator(nothing).collect() == []


def test_token_ids_of_odd_texts():
    """Pieces encoded once give the ids of the whole text, also around signs and special names."""
    import random

    import pyarrow as pa

    from civisight.llm.packing import _tokenizer, token_ids
    from civisight.llm.words import slices

    rng, letters = random.Random(3), "abzAZ09 \n'!.,-_$%é…—ß́İΣςñ>\"中"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    texts += ["don't I'll x!'s a's'S 12ab3", "", "a <|endoftext|> b <|ENDOFTEXT|>"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tokenizer = _tokenizer(tokenizer_path())
    for rows, data, offsets in slices(batch, limit=5000):
        ids, cut = token_ids(data, offsets, tokenizer_path(), 1)
        for text, a, b in zip(rows.column(0).to_pylist(), cut[:-1], cut[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def _index_of(words):
    word, pair = np.zeros(len(words), lm_score._WORD), np.zeros(len(words), lm_score._PAIR)
    word["hash"], word["size"], pair["word"], pair["train"] = np.arange(len(words)), [len(w) for w in words], np.arange(len(words)), 1
    return list(lm_score._index([(0, 0, word.tobytes(), pair.tobytes(), "".join(words).encode(), np.int64(0).tobytes())], 1))


def _counts_of(index):
    tables = np.zeros((lm_score._FIRST[-1], 2), np.float32)
    for batch in lm_score._tables(iter(index)):
        at = batch.column(0)[0].as_py() * lm_score.CHUNK
        tables[at:at + lm_score.CHUNK] = np.frombuffer(batch.column(2)[0].as_py(), "<u4").reshape(-1, 2)
    return tables


def test_lm_lookups_against_plain_counts():
    """Counts follow every bit of every word; looked-up inputs are those of the counts, with the bit's own left out."""
    index = _index_of([f"w{i * 7919 % 5000:04d}" for i in range(300)])
    tables, size = _counts_of(index), 300 * 6 * 8
    assert [int(tables[a:b].sum()) for a, b in zip(lm_score._FIRST[:-1], lm_score._FIRST[1:])] == [size] * 5
    (part,) = lm_score._parts(iter(index))
    whole, less = lm_score.Lookup(tables), lm_score.Lookup(tables, own=True)
    for bit, slots in part.spelling(np.arange(300)).bits():
        for own, lookup in ((0, whole), (1, less)):
            x, gate = lookup.of(bit, slots)
            for column, s in zip(x, slots):
                zero, one = tables[s, 0] - own * (1 - bit), tables[s, 1] - own * bit
                assert zero.min() >= 0 and one.min() >= 0 and column == pytest.approx(np.log((one + 0.3) / (zero + 0.3)), abs=1e-5)
            assert (gate == np.minimum(np.floor(np.log2(zero + one + 1)), lm_score.GATES - 1)).all()


def test_lm_mixer_takes_one_step_for_all_bits_of_a_block(monkeypatch):
    """Steps of the mixer are as many as blocks of bytes, not eight times as many."""
    index, steps, exp = _index_of([f"{i * 7919 % 100003:05d}word" for i in range(3000)]), [], np.exp
    tables = _counts_of(index)
    monkeypatch.setattr(np, "exp", lambda x: steps.append(x.size) or exp(x))
    (learned,) = lm_score._weights(iter(index), tables, 3000)
    assert sum(steps) == 3000 * 10 * 8 and len(steps) <= 3000 * 10 // 256 + 1
    assert set(learned.column(2).to_pylist()) == {3000.0}


def test_lm_facts_of_rows_without_words_or_id(spark):
    rows = [(1, "a b a"), (2, ""), (3, None), (None, "a b"), (-1, " \n"), (20, "A é")]
    got = {(r.doc_id, r.n_tokens, r.held_out) for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, len((t or "").split()) + 1, i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows}


def test_lm_counts_take_every_occurrence():
    """A word's bits count as often as it occurs in training; the mixer is fitted with all of its occurrences left out."""
    words, times = ["alpha", "beta", "gamma"], np.array([1, 7, 300])
    word, pair = np.zeros(3, lm_score._WORD), np.zeros(3, lm_score._PAIR)
    word["hash"], word["size"], pair["word"], pair["train"] = np.arange(3), [len(w) for w in words], np.arange(3), times
    index = list(lm_score._index([(0, 0, word.tobytes(), pair.tobytes(), "".join(words).encode(), np.int64(0).tobytes())], 1))
    tables = _counts_of(index)
    size = 8 * int(((word["size"] + 1) * times).sum())
    assert [int(tables[a:b].sum()) for a, b in zip(lm_score._FIRST[:-1], lm_score._FIRST[1:])] == [size] * 5
    (part,) = lm_score._parts(iter(index))
    spelling, lookup = part.spelling(np.arange(3)), lm_score.Lookup(tables, own=True)
    of = times[spelling.word]
    for bit, slots in spelling.bits():
        x, gate = lookup.of(bit, slots, of)
        for column, s in zip(x, slots):
            zero, one = np.maximum(tables[s, 0] - of * (1 - bit), 0), np.maximum(tables[s, 1] - of * bit, 0)
            assert column == pytest.approx(np.log((one + 0.3) / (zero + 0.3)), abs=1e-5)
        assert (gate == np.minimum(np.floor(np.log2(zero + one + 1)), lm_score.GATES - 1)).all()


def test_lm_parts_grow_with_the_texts(spark, monkeypatch):
    """Words are dealt to as many parts as their bytes ask for, at any width of the shuffle; scores are of the same texts."""
    seen, exchange = [], lm_score.exchange
    monkeypatch.setattr(lm_score, "exchange", lambda packed, parts, *rest: seen.append(parts) or exchange(packed, parts, *rest))
    monkeypatch.setattr(lm_score, "PART", 100)
    rows = [(i, f"some words of text {i % 7} and w{i}") for i in range(60)]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_tokens").collect()
    assert seen[0] == -(-sum(len(t) for _, t in rows) // 100) > 10
    assert sorted(map(tuple, got)) == [(i, len(t.split()) + 1) for i, t in rows]
