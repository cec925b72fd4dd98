"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the statistics, with a covariance shrunk towards its diagonal; the
score is the difference of log densities (Mahalanobis distances by cached Cholesky factors), put
on a probability scale. The fit reads at most ``max_rows`` labelled rows (those with the smallest
hash of their id), everything else reads all documents.

Null and empty texts have the statistics of an empty text and get a score; rows without a usable
label, with a null id or held out are not learned from; labels repeated for an id count each time;
with no labelled row of a class the score is the share of label 1 (0.5 without any); repeated rows
are scored alike; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import Shelf, by_id, smallest_hashes
from civisight.llm.words import Words, mix, slices

STATISTICS = ("log_words", "word_length", "long_words", "symbols", "upper", "digits", "marks", "same_as_last",
              "same_words", "same_windows", "same_lines", "line_words")
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 3
_KIND[[33, 46, 63]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = 5


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values per row."""
    if not len(row):
        return np.zeros(rows)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
    return np.bincount(row[new], minlength=rows).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each row, one column per name in STATISTICS."""
    rows, words = len(offsets) - 1, Words(data, offsets)
    row = words.row
    n = np.diff(words.first).astype(float)
    cover = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(cover * 6 + _KIND[data], minlength=rows * 6).reshape(rows, 6).astype(float)
    size = (words.end - words.start).astype(float)
    again = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    at, three = words.windows(3)
    breaks = np.flatnonzero(data == 10)
    # a line is the sum of its words' hashes
    line = np.searchsorted(breaks, words.start) + row.astype(np.int64) if len(row) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))[:len(line)]
    lines = np.bincount(row[starts], minlength=rows).astype(float) if len(row) else np.zeros(rows)
    text = mix(np.add.reduceat(words.hash, starts)) if len(row) else np.zeros(0, np.uint64)
    ratio = lambda a, b: a / np.maximum(b, 1)
    part = lambda a, b: np.log(0.002 + ratio(a, b))
    per = lambda w: np.bincount(row, weights=w, minlength=rows)
    letters = kinds[:, 1] + kinds[:, 2]
    return np.column_stack([
        np.log1p(n), np.log1p(ratio(per(size), n)), part(per(size > 20), n), part(kinds[:, 5], kinds.sum(1)),
        part(kinds[:, 1], letters), part(kinds[:, 3], kinds.sum(1)), part(kinds[:, 4], n),
        part(np.bincount(row[1:][again], minlength=rows), n), ratio(_distinct(row, words.hash, rows), n),
        part(np.bincount(row[at], minlength=rows) - _distinct(row[at], three, rows), n),
        part(lines - _distinct(row[starts], text, rows), lines), np.log1p(ratio(n, lines))])


def _measured(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in x.T)], names=["doc_id", *STATISTICS])


class Discriminant:
    """Two shrunk Gaussians and a logistic scale for the difference of their log densities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float):
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.centre) / self.scale
        self.means, self.factors, self.logs = [], [], []
        for label in (0, 1):
            own = z[y == label]
            apart = own - own.mean(0)
            spread = np.einsum("ki,kj->ij", apart, apart) / len(own) + 1e-3 * np.eye(z.shape[1])
            spread = (1 - shrink) * spread + shrink * np.diag(np.diag(spread) + 0.05)
            factor = np.linalg.cholesky(spread)
            self.means.append(own.mean(0))
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(np.log(np.diag(factor)).sum())
        self.slope, self.shift = 1.0, 0.0
        d = self.difference(x)
        for _ in range(25):  # two-parameter logistic fit by Newton steps, slightly damped
            p = 1 / (1 + np.exp(-(self.slope * d + self.shift)))
            w, g = p * (1 - p) + 1e-6, y - p
            a = np.array([[(w * d * d).sum() + 1, (w * d).sum()], [(w * d).sum(), w.sum() + 1]])
            step = np.linalg.solve(a, np.array([(g * d).sum() - (self.slope - 1), g.sum() - self.shift]))
            self.slope, self.shift = max(self.slope + step[0], 1e-3), self.shift + step[1]

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        far = [-0.5 * (np.einsum("ki,ji->kj", z - m, f) ** 2).sum(1) - c for m, f, c in zip(self.means, self.factors, self.logs)]
        return np.clip((far[1] - far[0]) / 4, -15, 15)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, shrinks=(0.02, 0.1, 0.3)) -> Discriminant | float:
    """The discriminant whose shrinkage does best on every fourth row; a share if a class has under 4 rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return float(y.mean()) if len(y) else 0.5
    test = np.arange(len(y)) % 4 == 0
    best = shrinks[-1]
    if min((y[~test] == 0).sum(), (y[~test] == 1).sum()) >= 4:
        loss = []
        for s in shrinks:
            p = np.clip(Discriminant(x[~test], y[~test], s).score(x[test]), 1e-6, 1 - 1e-6)
            loss.append(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
        best = shrinks[int(np.argmin(loss))]
    return Discriminant(x, y, best)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs(doc_id, text); labels(doc_id, quality).

    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out of the fit.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    table = shelf.put(docs.mapInArrow(_measured, schema), "statistics")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    labelled = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labelled = smallest_hashes(labelled.filter(~held), max_rows)
    sample = table.filter(~held).join(labelled, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS, "quality").limit(max_rows)
    rows = sample.select(*STATISTICS, "quality").toPandas()
    model = fit(rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float))

    def scored(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.column_stack([np.array(batch.column(2 + i), float) for i in range(len(STATISTICS))])
            p = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", held.alias("held_out"), *STATISTICS).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of docs that the classifier does not reject; rows without an id stay; all columns are kept."""
    return by_id(docs, quality_scores(docs, labels, **options).filter("predicted = 0 and doc_id is not null"), "left_anti")
