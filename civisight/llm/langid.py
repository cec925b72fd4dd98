"""Language identification: unigram pieces over a fixed public vocabulary, all segmentations summed.

Each language has a probability per piece of the vocabulary. A word's probability is the sum
over all its segmentations (forward algorithm); a text's log probability is the sum over its words.
The piece probabilities are learned by expectation-maximisation, the E step being a Spark job over the
word counts of at most ``max_docs`` labelled documents per language (those with the smallest hash of
their id).

Words are runs of letters in lower case; a run of over 32 letters is read in pieces of 32. A text that
is null or has no letter gets ``und`` and score 0, as all texts do when nothing can be learned from; rows
with a null language or id are not learned from; ties go to the first language by name; repeated
rows are treated alike; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import Shelf, smallest_hashes
from civisight.llm.words import Words, slices

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 32
START = "▁"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters of the public vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START)))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(size.max(initial=0))), np.uint64)
    codes[np.arange(codes.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, size


class Pieces:
    """Hash index of the vocabulary; the last id stands for single letters outside it."""

    def __init__(self, pieces: list[str]):
        codes, size = _codes(pieces)
        value = np.zeros(len(pieces), np.uint64)
        for i in range(codes.shape[1]):
            value = np.where(i < size, value * _BASE + codes[:, i] + _U(1), value)
        self.order = np.argsort(value)
        self.value, self.longest, self.unknown = value[self.order], int(size.max(initial=1)), len(pieces)

    def spans(self, codes: np.ndarray, size: np.ndarray):
        """(start, end, word indices, piece ids) of all pieces that occur, by start and length."""
        for s in range(codes.shape[1]):
            alive = np.flatnonzero(size > s)
            value = np.zeros(len(alive), np.uint64)
            for e in range(s + 1, min(s + self.longest, codes.shape[1]) + 1):
                longer = size[alive] >= e
                alive, value = alive[longer], value[longer]
                if not len(alive):
                    break
                value = value * _BASE + codes[alive, e - 1] + _U(1)
                place = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
                hit = self.value[place] == value
                ids = self.order[place]
                if e == s + 1:
                    yield s, e, alive, np.where(hit, ids, self.unknown)
                elif hit.any():
                    yield s, e, alive[hit], ids[hit]


def forward(pieces: Pieces, chance: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: probability of the word's first letters, all segmentations summed."""
    alpha = np.zeros((len(size), codes.shape[1] + 1, chance.shape[1]))
    alpha[:, 0] = 1
    for s, e, w, ids in pieces.spans(codes, size):
        alpha[w, e] += alpha[w, s] * chance[ids]
    return alpha


def expected(pieces: Pieces, chance: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language, for words with counts[word, language]."""
    codes, size = _codes(words)
    alpha = forward(pieces, chance, codes, size)
    every = list(pieces.spans(codes, size))
    beta = np.zeros_like(alpha)
    beta[np.arange(len(size)), size] = 1
    weight = counts / np.maximum(alpha[np.arange(len(size)), size], 1e-300)
    total = np.zeros_like(chance)
    for s, e, w, ids in reversed(every):
        flow = chance[ids] * beta[w, e]
        beta[w, s] += flow
        used = alpha[w, s] * flow * weight[w]
        for k in range(chance.shape[1]):
            total[:, k] += np.bincount(ids, weights=used[:, k], minlength=len(chance))
    return total


def _runs(word: str) -> list[str]:
    out = []
    for run in LETTERS.findall(word.lower()):
        run = START + run
        out += [run[i:i + LONGEST] for i in range(0, len(run), LONGEST)]
    return out


def _counted(batches: Iterator[pa.RecordBatch]):
    """(lang, word, n) of each batch; rows are (lang, text)."""
    for batch in batches:
        total = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(text.split()).items():
                for run in _runs(word):
                    total[lang, run] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["lang", "word", "n"])


def learn(docs: DataFrame, pieces: list[str], max_docs: int = 1000, rounds: int = 3, shelf: Shelf | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, chance[piece, language]) from docs(doc_id, text, lang)."""
    shelf, index = shelf or Shelf(docs.sparkSession), Pieces(pieces)
    usable = docs.filter("lang is not null and text is not null")
    # texts are joined to the chosen ids, so that none is ordered
    chosen = smallest_hashes(usable.filter("doc_id is not null").select("doc_id", "lang").distinct(), max_docs, per="lang")
    sample = usable.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    words = shelf.put(sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
                      .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((len(pieces) + 1, 0))
    chance = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    for _ in range(rounds):
        def uses(batches: Iterator[pa.RecordBatch], chance=chance):
            total = np.zeros_like(chance)
            for batch in batches:
                at = np.array([languages.index(x) for x in batch.column(0).to_pylist()], np.int64)
                counts = np.zeros((batch.num_rows, len(languages)))
                counts[np.arange(batch.num_rows), at] = np.array(batch.column(2))
                total += expected(index, chance, batch.column(1).to_pylist(), counts)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        # bounded by the vocabulary times the languages
        rows = words.mapInArrow(uses, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(chance.shape, 1e-2)
        total[rows["piece"], rows["lang"]] += rows["n"]
        chance = total / total.sum(0)
    return languages, chance


def _scored(batches: Iterator[pa.RecordBatch], index: Pieces, languages: list[str], chance: np.ndarray):
    rare = np.log(chance.min()) if languages else 0.0
    for batch in batches:
        for rows, data, offsets in slices(batch, limit=8 << 20):
            words = Words(data, offsets)
            _, where, back, times = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
            raw, runs, owner = words.data.tobytes(), [], []
            for i, p in enumerate(where.tolist()):
                for run in _runs(raw[words.start[p]:words.end[p]].decode()):
                    runs.append(run)
                    owner.append(i)
            logs, letters = np.zeros((len(where), len(languages))), np.zeros(len(where), bool)
            for at in range(0, len(runs), 20_000):
                some = runs[at:at + 20_000]
                codes, size = _codes(some)
                alpha = forward(index, chance, codes, size)[np.arange(len(size)), size]
                log = np.where(alpha > 0, np.log(np.maximum(alpha, 1e-300)), rare * size[:, None])
                np.add.at(logs, owner[at:at + 20_000], log)
                letters[owner[at:at + 20_000]] = True
            n, found = rows.num_rows, np.zeros(rows.num_rows, bool)
            total = np.column_stack([np.bincount(words.row, weights=logs[back, k], minlength=n) for k in range(len(languages))]) if len(where) and languages else np.zeros((n, max(1, len(languages))))
            if len(where):
                found = np.bincount(words.row, weights=letters[back], minlength=n) > 0
            share = np.exp(total - total.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            known = found if languages else np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, share[np.arange(n), best], 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])


def predict_languages(docs: DataFrame, max_docs: int = 1000, folds: int = 3, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs(doc_id, text, lang).

    Rows whose crc32(doc_id as text) mod ``folds`` is 1 are held out of learning.
    """
    shelf, pieces = Shelf(docs.sparkSession), vocabulary(path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    languages, chance = learn(docs.filter(fold != 1), pieces, max_docs, shelf=shelf)
    index = Pieces(pieces)
    return docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text").mapInArrow(
        lambda b: _scored(b, index, languages, chance), "doc_id long, held_out boolean, lang_pred string, score double")
