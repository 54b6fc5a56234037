"""Numbers drawn by hash: the first four bytes of the MD5 of seed-resample-draw, for many draws at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Draws hashed at a time: the arrays of a step stay in the cache of a core.
AT_ONCE = 16_384
K = [int(2**32 * abs(math.sin(i + 1))) for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def hashed(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first word of the MD5 of n messages of one block each, read from its highest byte; words are columns or constants."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    # the last three steps don't change the first word
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[WORD[i]]
        if isinstance(word, int):
            np.add(f, np.uint32((K[i] + word) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(K[i]), out=f), np.add(f, word, out=f)
        np.left_shift(f, np.uint32(TURNS[i]), out=g), np.right_shift(f, np.uint32(32 - TURNS[i]), out=f), np.bitwise_or(f, g, out=f)
        # the array of a is free for the next step
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(b, np.uint32(START[0]), out=f)
    return f.byteswap()


def _digits(low: int, high: int) -> np.ndarray:
    """The decimal digits of low to high - 1, all of one length, as bytes."""
    x, n = np.arange(low, high), len(str(low))
    return np.stack([(x // 10 ** (n - 1 - k) % 10 + 48).astype(np.uint8) for k in range(n)], 1)


def drawn(seed: int, resamples: list[int], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(resample, whole numbers of 32 bits) of n draws of each resample, in pieces."""
    low = 0
    while low < n:
        high = min(n, low + AT_ONCE, 10 ** len(str(low)))
        digits = _digits(low, high)
        for size in sorted({len(str(r)) for r in resamples}):
            alike, start = [r for r in resamples if len(str(r)) == size], len(f"{seed}--") + size
            end = start + digits.shape[1]
            # the words with digits in them, whose places depend on the length of what stands before alone
            every = np.zeros((high - low, 64), np.uint8)
            every[:, start:end] = digits
            columns = {w: np.ascontiguousarray(every.view("<u4")[:, w]) for w in range(start // 4, (end - 1) // 4 + 1)}
            some = max(1, AT_ONCE // (high - low))
            for at in range(0, len(alike), some):
                yield from zip(alike[at : at + some], _resampled(seed, alike[at : at + some], columns, end, high - low))
        low = high


def _resampled(seed: int, resamples: list[int], columns: dict[int, np.ndarray], end: int, n: int) -> np.ndarray:
    """n numbers of each of some resamples, whose own digits are as many."""
    block = np.zeros((len(resamples), 64), np.uint8)
    for row, r in zip(block, resamples):
        head = f"{seed}-{r}-".encode()
        row[: len(head)], row[end] = np.frombuffer(head, np.uint8), 128
        row[56:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
    words: list[np.ndarray | int] = []
    for w, own in enumerate(block.view("<u4").T):
        if w in columns:
            words.append((own[:, None] | columns[w][None]).ravel())
        else:
            words.append(int(own[0]) if (own == own[0]).all() else np.repeat(own, n))
    return hashed(words, len(resamples) * n).reshape(len(resamples), n)
