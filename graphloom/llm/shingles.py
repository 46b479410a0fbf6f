"""Five-word shingles of whole texts as 64-bit hashes, computed with numpy over the bytes of many documents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
WORDS = 5
CHUNK = 1 << 20  # bytes of text that are hashed at once; a longer document is hashed alone

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_COEFFICIENTS = np.cumprod(np.full(WORDS, 0xD6E8FEB86659FD93, U))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, b, U)
            p[0] = U(1)
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (constants of a public 64-bit finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column, nulls as empty texts."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Ranges of documents of about ``most`` bytes, one at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, ASCII letters in lower case, and how many words lie before each document.

    A word's hash is the difference of two prefix sums of byte times power, moved to the same power, and mixed with
    its length.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    ink = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    after[-1], after[:-1] = False, ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:]))
    up, down = powers(n)
    sums = np.cumsum((data.astype(U) + U(1)) * up)
    low = np.where(starts > 0, sums[starts - 1], U(0))
    h = mix((sums[ends] - low) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))
    return h, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes of each document, in order; empty for documents without words."""
    data, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        own = offsets[i : j + 1]
        h, at = word_hashes(data[own[0] : own[-1]], own - own[0])
        if len(h) >= WORDS:
            m = len(h) - WORDS + 1
            s = h[:m] * _COEFFICIENTS[0]
            for k in range(1, WORDS):
                s += h[k : k + m] * _COEFFICIENTS[k]
            s = mix(s)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(s[a : b - WORDS + 1])
            elif b > a:  # the whole sequence, kept apart from longer ones by its length
                x = (h[a:b] * _COEFFICIENTS[: b - a]).sum(dtype=U) + U(b - a)
                yield mix(np.array([x], U))
            else:
                yield np.zeros(0, U)
