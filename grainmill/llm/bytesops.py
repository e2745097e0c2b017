"""Vectorised text helpers for use inside Arrow tasks: words, word hashes and shingles of a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: a value for each byte, drawn from the mixer
_VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[:] = out
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def term_bytes() -> np.ndarray:
    """Which bytes belong to a search term: ASCII digits and letters, and all of non-ASCII characters."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    for a, b in (b"09", b"AZ", b"az"):
        inside[a : b + 1] = True
    return inside


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space or of ``inside`` bytes, A-Z lower-cased), their row, start and end byte."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), z, z, z
    word = ~_SPACE[data] if inside is None else inside[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    pw, inv = powers(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(_VALUE[_LOWER[data]] * pw[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(_U))
    return h, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row, laid end to end, and the n + 1 offsets of the rows in them.

    A row of fewer than k words has its whole word sequence as one shingle; a row without words has none.
    """
    n = len(offsets) - 1
    h, row, _, _ = word_hashes(data, offsets)
    words = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    comb = np.zeros(len(h), _U)
    for j in range(k):
        m = len(h) - j
        if m > 0:
            comb[:m] += h[j:] * _U((0xD6E8FEB86659FD93 * (2 * j + 1) ** 3 | 1) % (1 << 64))
    last = first[1:][row] if len(row) else row
    keep = np.arange(len(h)) + k <= last
    short = np.flatnonzero((words > 0) & (words < k))
    for i in short:
        a, b = int(first[i]), int(first[i + 1])
        keep[a] = True
        comb[a] = sum(int(h[a + j]) * (0xA24BAED4963EE407 * (2 * j + 1) + (b - a)) for j in range(b - a)) % (1 << 64)
    comb, row = mix(comb[keep]), row[keep]
    count = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    for i in range(n):
        comb[at[i] : at[i + 1]].sort()
    if len(comb):
        new = np.empty(len(comb), bool)
        new[0], new[1:] = True, (comb[1:] != comb[:-1]) | (row[1:] != row[:-1])
        comb, row = comb[new], row[new]
    return comb, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
