"""Words of Arrow text columns as 64-bit hashes, computed on whole byte blocks with numpy.

Both word rules of the corpus operators are rules on UTF-8 bytes once A-Z is
lower-cased: white space is ASCII, and every byte of a non-ASCII character is
0x80 or above.  So a block of texts is split and hashed without decoding it.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that end a word: every ASCII byte that is neither digit nor letter.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x41:0x5B] = False
NOT_ALNUM[0x61:0x7B] = False

_CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _CHUNK + 1)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes [start, end); spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        terms = (lowered[a:b].astype(np.uint64) + np.uint64(1)) * up[:b - a]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of rows ``offsets`` of ``data``, and the n + 1 word offsets of the rows."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = first[first > 0] - 1
    end[last] = inside[last]
    ends = np.flatnonzero(end) + 1
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, counts_at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``size`` words (fewer words: the whole row)."""
    n = len(hashes)
    runs = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        runs += hashes[k:k + len(runs)] * np.uint64((0xA0761D6478BD642F + 2 * k * 0xE7037ED1A0B428DB) & (2 ** 64 - 1) | 1)
    runs = mix(runs)
    out = []
    for a, b in zip(counts_at[:-1].tolist(), counts_at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x + hashes[k:k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
