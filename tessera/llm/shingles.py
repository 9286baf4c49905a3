"""Word shingles of whole texts as 64-bit hashes, by numpy over a batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes hashed at once.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads each bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _ODD, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in data (bytes of UTF-8 texts, one after the other; texts begin at starts) and the count of
    words before each text. A-Z count as lower case; a word is a run of bytes other than ASCII white space."""
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    first = ~space
    first[1:] &= space[:-1]
    edge = np.zeros(len(low), bool)
    edge[starts[starts < len(low)]] = True
    first |= edge & ~space
    last = ~space
    last[:-1] &= space[1:] | edge[1:]
    size = 1 << max(len(low), 1).bit_length()
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(size)
    up, down = _TABLES[size]
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return hashes, np.searchsorted(s, starts)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its set of shingles, sorted. Fewer words make one shingle, no word none."""
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= CHUNK):
            held += len(texts[upto])
            upto += 1
        part = texts[at:upto]
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(x) for x in part], out=starts[1:])
        w, before = word_hashes(np.frombuffer(b"".join(part), np.uint8), starts)
        rolled = np.zeros(max(len(w) - words + 1, 0), np.uint64)
        for k in range(words):
            rolled = _mixed(rolled * _ODD + w[k : k + len(rolled)])
        for i in range(len(part)):
            lo, hi = before[i], before[i + 1]
            if hi - lo >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                x = np.full(1, hi - lo, np.uint64)
                for k in range(lo, hi):
                    x = _mixed(x * _ODD + w[k])
                yield x
            else:
                yield np.zeros(0, np.uint64)
        at = upto
