"""Vectorised words of many texts: byte positions, 64-bit hashes, windows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SIGN = np.zeros(256, np.uint8)  # 1: letters and digits, 2: signs, 4: neither
SIGN[:] = 4
SIGN[33:127] = 2
SIGN[39] = 4
SIGN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        made = np.multiply.accumulate(steps)
        if n > 1 << 22:
            return made
        _powers[name] = have = made
    return have


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about ``limit`` bytes of text; a null text is empty."""
    at = batch.schema.get_field_index(text)
    column = batch.column(at).cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows of one slice: ``row``, ``start``, ``end``, ``hash``; ``first`` indexes rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, split: bool = False):
        """``split`` also cuts words between ASCII letters or digits and ASCII signs (but for apostrophes)."""
        data = LOWER[data] if lower else data
        self.data, n = data, len(data)
        inside = ~SPACE[data]
        begin, finish = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            finish[:-1] &= ~inside[1:]
            if split:
                kind = SIGN[data]
                cut = kind[1:] + kind[:-1] == 3
                begin[1:] |= cut
                finish[:-1] |= cut
            edges = offsets[:-1][offsets[:-1] < n]
            begin[edges] = inside[edges]
            edges = offsets[1:][offsets[1:] > 0] - 1
            finish[edges] = inside[edges]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))
        if hashes:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_RANDOM[data] * _power("up", _BASE, n)[:n], out=total[1:])
            back = _power("down", pow(_BASE, -1, 1 << 64), n)
            value = (total[self.end] - total[self.start]) * (back[self.start] if n else _U(1))
            self.hash = mix(value + (self.end - self.start).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of every k consecutive words of one row."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(n, np.uint64)
        for i in range(k):
            value = value * _U(_BASE) + self.hash[i:i + n]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        return at, mix(value[at])
