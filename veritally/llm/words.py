"""Words of whole texts as 64-bit hashes, with NumPy inside a task.

Words are runs of bytes other than the six ASCII white-space characters, with
A-Z lowered. A word's hash is a polynomial over its bytes taken from prefix
sums, so the cost per byte is a few array operations. Work goes in pieces of
whole texts of about ``PIECE`` bytes; a longer text is a piece of its own.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@contextmanager
def without_cycles() -> Iterator[None]:
    """No search for cycles meanwhile: large tables of plain values hold none, and walking them costs more than the work."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, purpose: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * ODD + np.uint64(purpose)) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``size`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    values = seeds(256, 1)
    values[65:91] = values[97:123]
    return values


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        made = []
        for base in (ODD, INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        if n > 2 * PIECE:
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


@lru_cache(maxsize=1)
def white() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (n + 1)."""
    inside = ~white()[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[-1] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash per word in text order, and for each text the number of words before it (n + 1)."""
    starts, ends, first = word_bounds(data, offsets)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct hashes of ``size`` words in a row; fewer words are one shingle."""
    words, first = word_hashes(data, offsets)
    factors = seeds(size, 2)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    rolling = np.zeros(len(words), np.uint64)
    for j in range(size):
        rolling += padded[j : j + len(words)] * factors[j]
    rolling = mix(rolling)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolling[a : b - size + 1]))
        elif b > a:
            out.append(mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
