"""64-bit hashes of all words and shingles of many texts at once, with numpy.

A word is a run of bytes other than the six ASCII white-space ones, lower-cased A-Z (or left
as it is, with another table of bytes). Its
hash is a polynomial in a fixed odd base over random byte values, taken from prefix sums
modulo 2**64 and finished by a bijective mixer, so no word is ever a Python object.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 20  # positions whose powers are held


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
UNCHANGED = np.arange(256, dtype=np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POW = _powers(int(BASE), 4096)
_INV = _powers(pow(int(BASE), -1, 1 << 64), 4096)
_POW_HIGH = _powers(pow(int(BASE), 4096, 1 << 64), 4096)
_INV_HIGH = _powers(pow(int(BASE), -4096, 1 << 64), 4096)


def _power(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """base ** at for 0 <= at < 2**24."""
    return low[at & 4095] * high[(at >> 12) & 4095]


def words(texts: list[bytes], fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, counts, lengths)``: the hash and byte length of every word of all texts in
    order, and the number of words of each text."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    gap = _IS_SPACE[raw]
    edge = np.diff(gap.view(np.int8))
    starts = np.flatnonzero(edge == -1) + 1
    if len(raw) and not gap[0]:
        starts = np.concatenate([[0], starts])
    ends = np.flatnonzero(edge == 1) + 1
    # Positions are taken modulo 2**24 inside the powers: words are far shorter than that, and
    # a longer text only wraps the base exponent, which the inverse power undoes for a word
    # that does not cross the wrap. Words that do are hashed on their own below.
    at = np.arange(len(raw), dtype=np.int64) & ((1 << 24) - 1)
    value = _BYTE[fold[raw]] * _power(at, _POW, _POW_HIGH)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    first = starts & ((1 << 24) - 1)
    h = (total[ends] - total[starts]) * _power(first, _INV, _INV_HIGH)
    for i in np.flatnonzero((starts >> 24) != ((ends - 1) >> 24)):
        w = _BYTE[fold[raw[starts[i]:ends[i]]]]
        power = np.uint64(1)
        acc = np.uint64(0)
        for lo in range(0, len(w), 1 << 12):
            part = w[lo:lo + (1 << 12)]
            acc += (part * _POW[:len(part)]).sum(dtype=np.uint64) * power
            power *= _POW_HIGH[1]
        h[i] = acc
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(np.searchsorted(starts, bounds))
    lengths = ends - starts
    return _mix(h + lengths.astype(np.uint64)), counts, lengths


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, counts)`` of the k-word shingles of each text; a text of 1 to k - 1 words has
    one shingle, the whole sequence."""
    n = len(h)
    starts = np.cumsum(counts) - counts
    out_counts = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    if n == 0:
        return np.empty(0, np.uint64), out_counts
    # The sum over a window of mix(word hash + place) depends on the order of the words.
    acc = np.zeros(n, np.uint64)
    last = np.repeat(starts + counts, counts)
    at = np.arange(n)
    for j in range(k):
        src = at + j
        ok = src < last
        acc[ok] = _mix(acc[ok] ^ h[src[ok]])
    keep = np.repeat(np.maximum(counts - k + 1, 1), counts) > at - np.repeat(starts, counts)
    return acc[keep], out_counts
