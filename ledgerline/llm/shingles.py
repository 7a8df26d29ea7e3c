"""Hashes of words and of runs of words, computed over whole Arrow columns with numpy.

A word is a run of bytes other than space and 9 to 13; A-Z count as a-z. The hash of a
word is a polynomial modulo 2^64 over a random table of bytes, taken for all words at
once as the difference of two running sums; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer word is hashed alone.
PIECE = 1 << 19
U = np.uint64

_random = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_STEPS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every bit depends on all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(PIECE + 1, base, U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of bytes and, for each of the texts that begin at starts, the number of words before it."""
    up, down = _tables()
    space = _SPACE[data]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    inner = starts[starts < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= space[1:]
    before = inner[inner > 0] - 1
    last[before] = word[before]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(s), U)
    at = 0
    while at < len(s):
        base = s[at]
        stop = int(np.searchsorted(e, base + PIECE, "right"))
        if stop <= at:
            whole = bytes(data[s[at] : e[at]]).translate(_LOWER)
            out[at] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
            at += 1
            continue
        part = data[base : e[stop - 1]]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        i, j = s[at:stop] - base, e[at:stop] - base
        out[at:stop] = (sums[j] - sums[i]) * down[i]
        at = stop
    return mix(out), np.searchsorted(s, starts)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    total = words[:n] * _STEPS[0]
    for k in range(1, width):
        total = total + words[k : k + n] * _STEPS[k]
    return mix(total)


def texts(column: pa.Array, piece: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) for consecutive rows of some MB; words of row first + i: hashes[bounds[i]:bounds[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece, "right")) - 1)
        begin, end = offsets[row], offsets[stop]
        hashes, bounds = word_hashes(data[begin:end], offsets[row:stop] - begin)
        bounds = np.append(bounds, len(hashes))
        if not valid[row:stop].all():  # a null has no bytes, so its bounds are equal already
            assert (np.diff(bounds)[~valid[row:stop]] == 0).all()
        yield row, hashes, bounds
        row = stop


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of a text; with fewer words than width the whole sequence is one."""
    if len(words) == 0:
        return words
    if len(words) < width:
        return mix((words * _STEPS[: len(words)]).sum(keepdims=True) + U(len(words)))
    return np.unique(runs(words, width))
