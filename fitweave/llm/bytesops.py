"""Vectorised helpers over the UTF-8 bytes of Arrow text columns.

Tasks see half a megabyte of text at a time (`pieces`), so the memory of a
Python worker does not follow the batch size; a single longer text is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table that is True inside the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACES = table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text; a longer single text stands alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0))
    totals, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        before = int(totals[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(totals, before + limit, side="right")))
        yield batch.slice(low, high - low)
        low = high


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null counts as an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs that do not cross a document's edge."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to 2^bits."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.ones(1, dtype=np.uint64)
        factor = base
        for _ in range(bits):
            powers = np.concatenate([powers, powers * np.uint64(factor)])
            factor = factor * factor & _MASK
        out.append(powers)
    return out[0], out[1]


def _symbol_codes() -> np.ndarray:
    """One odd-looking 64-bit code for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of arbitrary byte spans of one buffer by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _powers(max(21, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_symbol_codes()[data] * self.powers[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hashes of the ``width`` bytes at each position that has so many."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width))


def last_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its minimum, the last one of equals.

    The low 32 bits of a value give way to the position, so equal leading bits
    are decided by place alone, alike in every copy of the same bytes.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64((1 << 32) - 1)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = (values & ~bits) | (bits - np.arange(len(values), dtype=np.uint64))
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (bits - (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & bits)).astype(np.int64)
