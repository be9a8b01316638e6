"""A compressed FM-index over short texts of word numbers, built and searched with numpy.

The Burrows-Wheeler transform of the texts is held as a wavelet matrix of packed bits with
rank counts per machine word. Beside it a bit vector marks where, in suffix order, the first
``window`` words change, so that an interval can be widened to all suffixes that share them
(its parent interval at that depth). Every operation works on whole arrays of positions: all
streamed texts take their backward steps together.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n >> 6) + 1 << 6, np.uint8)
        padded[:n] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.packed).astype(np.uint32)
        self.before = np.concatenate([[np.uint32(0)], np.cumsum(ones, dtype=np.uint32)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.packed[block] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one packed bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        held = symbols
        for digit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (held >> digit) & 1
            ones = bit.astype(bool)
            zeros = len(held) - int(ones.sum())
            self.levels.append((digit, Bits(bit), zeros))
            held = np.concatenate([held[~ones], held[ones]])
        every = np.arange(n_symbols, dtype=np.int64)
        self.base = self._descend(every, np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> digit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._descend(symbols, at) - self.base[symbols]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, same)``: the suffixes of ``text`` in order, by prefix doubling, and for each
    position the class of its first ``depth`` symbols. All suffixes must differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    span, same = 1, None
    while True:
        if same is None and 2 * span > depth:
            # Two overlapping spans cover the depth.
            beyond = np.full(n, -1, np.int64)
            beyond[:n - (depth - span)] = rank[depth - span:]
            same = rank * (n + 1) + beyond + 1
        if same is not None and int(rank.max()) == n - 1:
            break
        second = np.zeros(n, np.int64)
        second[:max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        span *= 2
    return np.argsort(rank, kind="stable"), same


class PassageIndex:
    """FM-index of texts of word numbers (1, 2, ...); each text has an owner."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, window: int):
        self.window, m = window, len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1
        n = int(ends[-1]) + 1
        # Every text ends in a symbol of its own (0 .. m - 1); words come after them.
        text = np.empty(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        text[~is_end] = np.concatenate(texts) + (m - 1)
        text[ends] = np.arange(m)
        order, same = suffix_order(text, window)
        before = text[order - 1]
        symbols = np.maximum(before - (m - 1), 0)
        n_symbols = int(text.max()) - (m - 1) + 1 if n > m else 1
        self.bwt = WaveletMatrix(symbols, max(n_symbols, 2))
        counts = np.bincount(np.maximum(text - (m - 1), 0), minlength=max(n_symbols, 2))
        self.first = np.cumsum(counts) - counts
        self.n = n
        changes = np.concatenate([[True], np.diff(same[order]) != 0])
        self.marks = Bits(changes.astype(np.uint8))
        self.starts = np.append(np.flatnonzero(changes), n)
        owner = np.repeat(owners, self.sizes + 1)
        self.least = np.minimum.reduceat(owner[order], self.starts[:-1])

    def stream(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Read texts from right to left, all of them a word a step.

        Returns ``(length, owner)`` of shape (texts, longest): the matching statistics up to
        ``window`` words, and from each place on that matches so far, the least owner of a text
        that holds those words (else -1). Words that the index does not know are 0.
        """
        m, longest = len(texts), max(map(len, texts), default=0)
        sizes = np.array([len(t) for t in texts], np.int64)
        words = np.zeros((m, longest), np.int64)
        for i, t in enumerate(texts):
            words[i, :len(t)] = t
        length, owner = np.zeros((m, longest), np.int64), np.full((m, longest), -1, np.int64)
        # Each text has a cursor ``at`` and the interval of the ``held`` words from there on. A
        # match that breaks gives up its last word: it is read again from the end one to the left.
        at, end = sizes.copy(), sizes.copy()
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        on = np.flatnonzero(sizes > 0)
        while len(on):
            c = words[on, at[on] - 1]
            new_lo = self.first[c] + self.bwt.rank(c, lo[on])
            new_hi = self.first[c] + self.bwt.rank(c, hi[on])
            known = c > 0
            found = known & (new_lo < new_hi)
            hit, miss = on[found], on[~found]
            lo[hit], hi[hit] = new_lo[found], new_hi[found]
            at[hit] -= 1
            held = end[hit] - at[hit]
            length[hit, at[hit]] = np.maximum(length[hit, at[hit]], held)
            full = hit[held >= self.window]
            # All suffixes that begin with these words, and the window slides one to the left.
            run = self.marks.rank(lo[full] + 1) - 1
            owner[full, at[full]] = self.least[run]
            lo[full], hi[full] = self.starts[run], self.starts[run + 1]
            end[full] = at[full] + self.window
            # A word no text has ends every match that would hold it.
            end[miss] = np.where(known[~found], end[miss] - 1, at[miss] - 1)
            at[miss] = end[miss]
            lo[miss], hi[miss] = 0, self.n
            on = np.flatnonzero(at > 0)
        return length, owner
