"""Words and word shingles of Arrow text columns as 64-bit hashes, straight from the UTF-8 bytes.

Words are runs of bytes other than space and \\t-\\r; A-Z count as a-z. A word's hash is a polynomial over
random byte values, read off running sums, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at once; bounds the working memory of a task, and fits the caches of a core.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    values[space] = 0
    values[65:91] = values[97:123]
    return values, space


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 0x9E3779B97F4A7C15 | 1
    up, down = np.full(n, p, U), np.full(n, pow(p, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; nulls have no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row. A chunk holds rows up to CHUNK bytes, or one longer row."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield from _chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def _chunk(data: np.ndarray, offsets: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
    values, space = _tables()
    n = len(data)
    if not n:
        yield from ((first + r, np.empty(0, U)) for r in range(len(offsets) - 1))
        return
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~space.take(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True  # a word does not go on into the next row
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    up, down = _powers(max(CHUNK, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, U)
    powered = values.take(data)
    powered *= up[:n]
    np.cumsum(powered, out=sums[1:])
    hashes = sums.take(ends)
    hashes -= sums.take(starts)
    hashes *= down.take(starts)
    hashes += (ends - starts).view(U)
    hashes = mix(hashes)
    at = np.searchsorted(starts, offsets).tolist()
    for r in range(len(offsets) - 1):
        yield first + r, hashes[at[r] : at[r + 1]]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes, in order, of runs of `size` words; of all words as one run if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    x = np.full(len(words) - size + 1, U(size))
    for k in range(size):
        x = mix(x * U(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k])
    return np.unique(x)
