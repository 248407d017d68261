"""Texts of an Arrow batch as byte arrays, and word hashes over them, without a Python object per row or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def number(i: int) -> np.uint64:
    """The i-th of a fixed row of 64-bit numbers."""
    return mix(np.array([i + 1], np.uint64) * np.uint64(_BASE))[0]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry for the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_table(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(lower-casing map, is-word map) over bytes. ``space``: words end at white space; ``plain``: words are ASCII letters and digits and all non-ASCII bytes."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, bool)
    if kind == "space":
        word[[32, *range(9, 14)]] = False
    else:
        word[:128] = False
        word[[*range(48, 58), *range(97, 123)]] = True
    return lower, word


def words(data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of some rows, in order; the row of each; and where each row's words begin (one more entry for the end).

    Equal words have equal hashes; hashes are 64 bits wide.
    """
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    low = tables[0][data]
    inside = tables[1][low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    stop[tails] = inside[tails]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(data)], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(s, at)
    return h, np.repeat(np.arange(n), np.diff(first)), first


def grams(h: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word runs, and where each row's begin. ``short``: a row of fewer words has its whole sequence as one run."""
    n = np.diff(first)
    runs = np.maximum(n - k + 1, 0)
    if short:
        runs = np.where((n > 0) & (runs == 0), 1, runs)
    where = np.concatenate([[0], np.cumsum(runs)])
    start = np.arange(where[-1]) - np.repeat(where[:-1] - first[:-1], runs)
    size = np.minimum(np.repeat(n, runs), k)
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for i in range(k):
        part = padded[start + i] * number(1000 + i)
        if short:
            part[size <= i] = 0
        out += part
    if short:
        out += (k - size).astype(np.uint64) * number(2000)
    return mix(out), where
