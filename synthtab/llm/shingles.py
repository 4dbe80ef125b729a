"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed for many texts at once.

A-Z is lower-cased, words are runs of bytes other than ASCII white space.  A
word's hash is a polynomial over its bytes taken from one running sum; a
shingle mixes the hashes of its words by position.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text hashed at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


BYTES = constants(256, 11)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``data`` (already lower case)."""
    buf = np.frombuffer(data, np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    size = 1 << max(21, int(len(buf)).bit_length())
    up, down = powers(size)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[buf] * up[: len(buf)], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64)), start, end


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``words`` make one shingle, none make none."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes, start, _ = word_hashes(b"\n".join(texts).lower())
    first = np.cumsum(lengths + 1) - lengths - 1
    word_first = np.searchsorted(start, np.append(first, np.iinfo(np.int64).max))
    factor = constants(words, 29)
    if len(hashes) >= words:
        shingle = sum(hashes[j : len(hashes) - words + 1 + j] * factor[j] for j in range(words))
        shingle = mix(shingle)
    out = []
    for a, b in zip(word_first[:-1].tolist(), word_first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingle[a : b - words + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], positions: int) -> np.ndarray:
    """16-bit min-hashes, one row for each set (empty sets: zeros)."""
    out = np.zeros((len(sets), positions), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        turn, times = constants(positions, 101), constants(positions, 211)
        for k in range(positions):
            least = np.minimum.reduceat((values ^ turn[k]) * times[k], starts)
            out[full, k] = mix(least) >> np.uint64(48)
    return out
