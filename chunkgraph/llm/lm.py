"""Language-model scoring by online logistic context mixing over the running text.

A text (lower-cased A-Z) is its sequence of bytes, each of them eight bits. Every bit has a
predictor per hashed context: the last 1, 2, 3, 4 and 6 bytes, whatever words they belong to; the
current word so far; and that with the word before it. A predictor is a pair of bit counts,
gathered over all bytes of all training documents: each half byte counts once in a block of its
context, and blocks of equal contexts add up, within tasks first. The stretched probabilities of
a bit are mixed by weights that a gate selects (longest context seen, bit number); the weights
are learnt online, one mini-batch after another, on counts without the occurrence itself. The
mixed probability is refined by an adaptive table over (gate, mixed probability) and averaged
with it. A text's score is the sum of the log probabilities of all its bits.

Every training document is learnt from. Learners, at most one for each shuffle partition and each
of at least ``LEARN_BYTES``, go through their documents by a hash of id and text; their weights
are averaged by the bits each of them saw at a gate, their refinement counts add up.

The count tables grow with the training bytes, ``BYTES_PER_BLOCK`` for each block of a context,
up to ``MAX_BITS`` (2^18 blocks of 16 a context, 28 MB of one-byte predictions in all): that is
broadcast, and twice that while the mixer is learnt; each worker holds it as the codes on the way of
each half byte (117 MB), so that a lookup finds four bits. Beyond it, contexts share blocks.
Counts, weights, refinement, words and scores cover all documents and whole texts.

The same passes give the *base* score: word unigrams with additive smoothing 0.1. Words with
at least 1/HEAD_SHARE of all occurrences (so at most that many) are resolved inside the
scan, all others by a hash join on a 64-bit word hash.

Defined results: null and empty texts have only the end token and score 0; without any training
row every token is unknown and every bit has probability one half; very long texts are scored in
pieces that carry their contexts over; repeated rows each count and come back; empty tables give
empty tables. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import weakref
import zlib
from collections import Counter
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm.common import read, release, shuffle_partitions, store
from chunkgraph.llm.langid import crc_of
from chunkgraph.llm.wordhash import _BYTE, _IS_SPACE
from chunkgraph.session import ship_package

#: Bytes of the running text that a context holds; after them the two word contexts.
ORDERS = (1, 2, 3, 4, 6)
CONTEXTS = len(ORDERS) + 2
MIN_BITS, MAX_BITS = 10, 18
BYTES_PER_BLOCK = 2
CHUNK_BLOCKS = 1 << 12
#: Rows of a table that are worked on together, so that copies of it stay small.
_PART = 1 << 18
PRIOR = 0.4
GATES = (CONTEXTS + 1) * 8
BUCKETS = 33
#: Training bytes of a learner, at least, and bytes of its mini-batches: a sixteenth of what it has
#: seen, between these bounds.
LEARN_BYTES = 2 << 20
BATCH_BYTES, BATCH_MAX = 1024, 1 << 14
RATE = 0.3
#: Bytes whose bits are predicted together, so that their blocks stay in the processor's cache.
_SPAN = 1 << 14
#: Bits that are multiplied by weights together: small products take a quick way.
_COLUMNS = 1 << 14
#: Bytes that are scored together; a longer text is scored in pieces.
PIECE = 1 << 17
#: Codes of stretched predictions: 0 is unseen, else (code - 128) / STEPS.
STEPS = 12.0
HEAD_SHARE = 1 << 19
#: Distinct words a task holds before it hands its counts on.
HOLD_UNITS = 400_000
SMOOTHING = 0.1
_LOOKBACK = max(ORDERS)
_BASE = 0x9E3779B1
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_BYTE32 = (_BYTE >> np.uint64(32)).astype(np.uint32)
_HELD_POWERS = [np.ones(0, np.uint32)] * 2
_HELD_PATHS: list = []


# ----------------------------------------------------------------- contexts

def _scatter(x: np.ndarray) -> np.ndarray:
    """Hash of 32-bit values, in place; tables take its upper bits."""
    x *= _ODD[0]
    x ^= x >> np.uint32(15)
    x *= _ODD[1]
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^32."""
    if len(_HELD_POWERS[0]) < n:
        _HELD_POWERS[:] = [np.multiply.accumulate(np.concatenate([[1], np.full(n - 1, b)]), dtype=np.uint32)
                           for b in (_BASE, pow(_BASE, -1, 1 << 32))]
    return _HELD_POWERS[0][:n], _HELD_POWERS[1][:n]


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbol, first, hashes)`` of every byte of the texts: the byte, where each text starts
    and a 32-bit hash per context. Texts are lower-cased already; contexts end at a text's start."""
    size = np.array([len(t) for t in texts], np.int64)
    joined = b"".join([bytes(_LOOKBACK + 2), *texts])
    raw = np.frombuffer(joined, np.uint8)[_LOOKBACK + 2:]
    n, first = len(raw), np.cumsum(size) - size
    hashes = np.empty((CONTEXTS, n), np.uint32)
    if not n:
        return raw, first, hashes
    # The four bytes before each, the last one uppermost, and the two before these.
    last = np.ndarray((n,), "<u4", joined, _LOOKBACK - 2, (1,)).astype(np.uint32)
    early = np.ndarray((n,), "<u2", joined, _LOOKBACK - 4, (1,)).astype(np.uint32)
    early *= _ODD[2]
    for row, order in zip(hashes, ORDERS):
        if order <= 4:
            np.right_shift(last, np.uint32(32 - 8 * order), out=row)
        else:
            np.bitwise_xor(last, early, out=row)
        _scatter(row)
    for held in range(_LOOKBACK):  # near a text's start there are only so many bytes before
        at = first[size > held] + held
        short = np.zeros((2, len(at)), np.uint32)
        for back in range(1, held + 1):
            short[int(back > 4)] |= raw[at - back].astype(np.uint32) << np.uint32(8 * (4 - back if back <= 4 else 6 - back))
        short[0] ^= short[1] * _ODD[2]
        shift = np.uint32(8 * (4 - held) if 0 < held < 4 else 0)
        for row, order in zip(hashes, ORDERS):
            if order > held:
                row[at] = _scatter(short[0] >> shift) ^ np.uint32((held + 1) * int(_ODD[3]) & 0xFFFFFFFF)
    gap = _IS_SPACE[raw]
    lead = np.empty(n, bool)  # the byte before is of another text or white space
    lead[1:] = gap[:-1]
    lead[first[size > 0]] = True
    start = np.flatnonzero(lead)
    run = np.diff(start, append=n)
    # A word's hash so far: a polynomial in an odd base, taken from prefix sums.
    power, inverse = _powers(n + 1)
    value = _BYTE32[raw]
    value *= power[:n]
    total = np.zeros(n + 1, np.uint32)
    np.cumsum(value, out=total[1:], dtype=np.uint32)
    prefix = total[:n] - np.repeat(total[start], run)
    prefix *= np.repeat(inverse[start], run)
    # The word before: its last byte is the nearest non-space byte before this word's start.
    solid = np.maximum.accumulate(np.where(gap, np.int32(-1), np.arange(n, dtype=np.int32)))
    end = np.where(start > 0, solid[np.maximum(start - 1, 0)], -1)
    held = end >= first[np.searchsorted(first, start, "right") - 1]
    end = np.maximum(end, 0)
    begin = start[np.searchsorted(start, end, "right") - 1]
    word = np.where(held, _scatter((total[end + 1] - total[begin]) * inverse[begin]) | np.uint32(1), np.uint32(0))
    np.add(prefix, np.repeat(word * _ODD[2], run), out=hashes[-1])
    hashes[-2] = prefix
    _scatter(hashes[-2:])
    return raw, first, hashes


def blocks(symbol: np.ndarray, hashes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each half of the bytes: its value, and its block in the table of each context."""
    high, low = symbol >> 4, symbol & 15
    shift, offset = np.uint32(32 - bits), (np.arange(CONTEXTS, dtype=np.uint32) << np.uint32(bits))[:, None]
    before = hashes >> shift
    before += offset
    after = hashes ^ ((high.astype(np.uint32) + np.uint32(1)) * _ODD[2])
    after *= _ODD[3]
    after >>= shift
    after += offset
    return [(high, before), (low, after)]


#: The nodes that a half byte's four bits pass, first to last, and the bits.
_PATH = np.array([[(1 << j) | v >> (4 - j) for j in range(4)] for v in range(16)])
_BIT = np.array([[v >> (3 - j) & 1 for j in range(4)] for v in range(16)], np.uint8)


def node_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of half bytes ``(blocks, 16)`` -> counts of zeros and ones at each node, as float16."""
    zeros, ones = np.zeros(counts.shape, np.float16), np.zeros(counts.shape, np.float16)
    for lo in range(0, len(counts), _PART):
        level = counts[lo:lo + _PART].astype(np.float32)
        for j in (3, 2, 1, 0):
            pair = level.reshape(len(level), 1 << j, 2)
            zeros[lo:lo + _PART, 1 << j:2 << j] = np.minimum(pair[:, :, 0], 60000)
            ones[lo:lo + _PART, 1 << j:2 << j] = np.minimum(pair[:, :, 1], 60000)
            level = pair.sum(2)
    return zeros, ones


class Model(NamedTuple):
    bits: int            # log2 of the blocks of a context
    codes: np.ndarray    # (contexts * blocks * 16) predictions
    weights: np.ndarray  # (GATES, contexts + 1)
    refine: np.ndarray   # (GATES, BUCKETS) probabilities


def encode(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    a, b = zeros.astype(np.float32), ones.astype(np.float32)
    z = np.log((b + np.float32(PRIOR)) / (a + np.float32(PRIOR)))
    return np.where(a + b > 0, np.clip(np.rint(z * np.float32(STEPS)) + 128, 1, 255), 0).astype(np.uint8)


def encode_table(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """:func:`encode` of whole tables, a part at a time."""
    out = np.empty(len(zeros), np.uint8)
    for lo in range(0, len(out), _PART):
        out[lo:lo + _PART] = encode(zeros[lo:lo + _PART], ones[lo:lo + _PART])
    return out


def paths(table: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each block and half byte the four codes on its way, ``entries[half]`` in the block's
    part of the table, less 128: four signed bytes in one number, -128 if unseen."""
    of = table.reshape(len(table) // (16 * (entries.max() // 16 + 1)), -1)
    out = np.empty((len(of), 16), np.uint32)
    for lo in range(0, len(of), CHUNK_BLOCKS):
        part = np.ascontiguousarray(of[lo:lo + CHUNK_BLOCKS].T).astype(np.uint32)
        to = np.empty((16, part.shape[1]), np.uint32)
        for v, nodes in enumerate(entries):
            to[v] = part[nodes[0]] | part[nodes[1]] << 8 | part[nodes[2]] << 16 | part[nodes[3]] << 24
        out[lo:lo + CHUNK_BLOCKS] = to.T
    out ^= np.uint32(0x80808080)
    return out.reshape(-1)


def _held_paths(table: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """:func:`paths` of the table that this worker's tasks share; only the latest is held."""
    if not _HELD_PATHS or _HELD_PATHS[0]() is not table:
        _HELD_PATHS.clear()
        _HELD_PATHS[:] = [weakref.ref(table), paths(table, entries)]
    return _HELD_PATHS[1]


def _gate_weights(weights: np.ndarray) -> np.ndarray:
    """(half, bit, longest, input) weights of codes, the bias last."""
    w = weights.reshape(CONTEXTS + 1, 2, 4, CONTEXTS + 1).transpose(1, 2, 0, 3).copy()
    w[..., :-1] /= STEPS
    return w.astype(np.float32)


class _Mix:
    """Buffers for ``n`` half bytes, the four bits of each beside each other. ``x`` (input, 4 n): the
    codes on their ways, 0 if unseen, and 1 for the bias; ``z`` (4 n): the weighted sum of the gate
    of the longest context seen, cut to +-12; ``rest`` and ``gate``: the bits whose longest context,
    in their order, is not the last one, and which."""

    def __init__(self, n: int):
        self.n = n
        self.x = np.ones((CONTEXTS + 1, 4 * n), np.float32)
        self.z = np.empty(4 * n, np.float32)
        self.own = np.zeros((4, min(4 * n, _COLUMNS)), np.float32)
        self.last = np.tile(np.float32(BUCKETS) * (np.arange(1, 5, dtype=np.float32) * (CONTEXTS + 1) - 1), n)

    def mix(self, half: np.ndarray, block: np.ndarray, table: np.ndarray, weights: np.ndarray) -> None:
        block <<= np.uint32(4)
        block |= half
        code = table.take(block.astype(np.intp), mode="wrap").view(np.int8)
        seen = (code != -128).view(np.int8)
        np.negative(seen, out=seen)
        code &= seen
        self.x[:-1] = code
        longest = seen[0] & np.int8(1)
        for c in range(1, CONTEXTS):
            seen[c] &= np.int8(c + 1)
            np.maximum(longest, seen[c], out=longest)
        # Nearly all bits have the last gate; the others are summed again.
        last = np.ascontiguousarray(weights[:, -1])
        for lo in range(0, 4 * self.n, _COLUMNS):
            full = last @ self.x[:, lo:lo + _COLUMNS]
            for j in range(4):
                self.z[lo + j:lo + _COLUMNS:4] = full[j, j::4]
        self.rest = np.flatnonzero(longest != CONTEXTS)
        self.gate = longest[self.rest].astype(np.intp)
        for lo in range(0, len(self.rest), self.n):
            rest = self.rest[lo:lo + self.n]
            self.z[rest] = np.einsum("ri,ir->r", weights[rest & 3, self.gate[lo:lo + self.n]], self.x[:, rest])
        np.clip(self.z, -12, 12, out=self.z)

    def cells(self) -> np.ndarray:
        """The refinement cell of each bit, numbered by (bit, longest, bucket), as float."""
        cell = self.z * np.float32(2)
        cell += np.float32(16)
        np.rint(cell, out=cell)
        np.clip(cell, 0, BUCKETS - 1, out=cell)
        cell += self.last
        if len(self.rest):
            cell[self.rest] += BUCKETS * (self.gate - CONTEXTS)
        return cell

    def slopes(self, error: np.ndarray) -> np.ndarray:
        """The sums of error times input by (bit, longest, input); ``error`` is used up."""
        n = CONTEXTS + 1
        out = np.zeros((4 * n, n))
        if len(self.rest):
            gates, own = (self.rest & 3) * n + self.gate, error[self.rest]
            for c, x in enumerate(self.x):
                out[:, c] = np.bincount(gates, own * x[self.rest], minlength=4 * n)
            error[self.rest] = 0
        out = out.reshape(4, n, n)
        for lo in range(0, 4 * self.n, _COLUMNS):
            part = self.own[:, :len(error[lo:lo + _COLUMNS])]
            for j in range(4):
                part[j, j::4] = error[lo + j:lo + _COLUMNS:4]
            out[:, -1] += part @ self.x[:, lo:lo + _COLUMNS].T
        return out


def _squash(z):
    return 1 / (1 + np.exp(-z))


def _bits(symbol: np.ndarray) -> list[np.ndarray]:
    """The bits of the two halves of the bytes."""
    bit = np.unpackbits(symbol).reshape(-1, 8)
    return [bit[:, :4].astype(np.float32).reshape(-1), bit[:, 4:].astype(np.float32).reshape(-1)]


def byte_scores(symbol: np.ndarray, hashes: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each byte."""
    out = np.zeros(len(symbol))
    table, weights = _held_paths(model.codes, _PATH), _gate_weights(model.weights)
    refine = model.refine.reshape(CONTEXTS + 1, 2, 4, BUCKETS).transpose(1, 2, 0, 3).reshape(2, -1)
    refine = np.concatenate([1 - refine, refine], 1).astype(np.float32)  # a zero's, a one's
    mix = _Mix(0)
    for lo in range(0, len(symbol), _SPAN):
        span = out[lo:lo + _SPAN]
        mix = mix if mix.n == len(span) else _Mix(len(span))
        bits = _bits(symbol[lo:lo + _SPAN])
        for part, (half, block) in enumerate(blocks(symbol[lo:lo + _SPAN], hashes[:, lo:lo + _SPAN], model.bits)):
            mix.mix(half, block, table, weights[part])
            bit, cell = bits[part], mix.cells()
            cell += bit * np.float32(refine.shape[1] // 2)
            z = mix.z
            bit *= np.float32(-2)
            bit += np.float32(1)
            z *= bit
            p = np.exp(z, out=z)  # of the bit that came
            p += np.float32(1)
            np.divide(np.float32(1), p, out=p)
            p += refine[part].take(cell.astype(np.intp), mode="wrap")
            p *= np.float32(0.5)
            np.maximum(p, np.float32(1e-6), out=p)
            span += np.log(p[::4] * p[1::4] * p[2::4] * p[3::4])
    out /= math.log(10)
    return out


def pieces(text: bytes):
    """``(piece, skip)`` of a text: each piece brings along the bytes its contexts need (two words
    and ``_LOOKBACK`` bytes), ``skip`` of them scored before."""
    lo = 0
    while lo < len(text) or lo == 0:
        back = lo
        if lo:
            words = 0
            while back > 0 and (words < 3 or lo - back < _LOOKBACK) and lo - back < PIECE // 2:
                back -= 1
                words += bool(_IS_SPACE[text[back]]) and not _IS_SPACE[text[min(back + 1, len(text) - 1)]]
        yield text[back:lo + PIECE], lo - back
        lo += PIECE


def _runs(texts: list[bytes]):
    """Lists of ``(text number, piece, skip)`` of about ``PIECE`` bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for p, skip in pieces(t):
            held.append((i, p, skip))
            size += len(p)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _fresh(run: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """``(symbol, hashes)`` of a run's bytes, without those that an earlier piece has."""
    symbol, _, hashes = contexts([p for _, p, _ in run])
    if not any(skip for _, _, skip in run):
        return symbol, hashes
    fresh = np.concatenate([np.arange(len(p)) >= skip for _, p, skip in run])
    return symbol[fresh], hashes[:, fresh]


def text_scores(texts: list[bytes], model: Model) -> list[float]:
    """log10 probability of each text."""
    out = [0.0] * len(texts)
    for run in _runs(texts):
        symbol, _, hashes = contexts([p for _, p, _ in run])
        lp = byte_scores(symbol, hashes, model)
        at = 0
        for i, p, skip in run:
            out[i] += float(lp[at + skip:at + len(p)].sum())
            at += len(p)
    return out


# ----------------------------------------------------------------- learning

def table_bits(n_bytes: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, n_bytes / BYTES_PER_BLOCK)))))


def _gather_counts(batches, bits: int):
    """(chunk, counts): the half-byte counts of the task's texts, in compressed chunks of blocks,
    each in the narrowest numbers that hold it, whose width comes first."""
    n = np.zeros((CONTEXTS << bits, 16), np.uint32)
    flat, one = n.reshape(-1), np.uint32(1)
    for batch in batches:
        for run in _runs([(t or b"").lower() for t in batch.column(0).to_pylist()]):
            symbol, hashes = _fresh(run)
            for half, block in blocks(symbol, hashes, bits):
                for row in block:
                    np.add.at(flat, ((row << np.uint32(4)) | half).astype(np.intp), one)
    for i in range(0, len(n), CHUNK_BLOCKS):
        part = n[i:i + CHUNK_BLOCKS]
        most = part.max()
        if most:
            part = part.astype(np.min_scalar_type(most))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // CHUNK_BLOCKS], pa.int32()),
                 pa.array([bytes([part.itemsize]) + zlib.compress(part.tobytes(), 1)], pa.binary())],
                names=["chunk", "counts"])
    del n, flat
    release()


def _sum_counts(batches):
    """One block of sums per chunk, in float16; beyond that range a block is scaled down."""
    current, total = None, None

    def emit():
        scale = np.minimum(1, 60000 / np.maximum(total.max(1, keepdims=True), 1))
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()),
             pa.array([zlib.compress((total * scale).astype(np.float16).tobytes(), 1)], pa.binary())],
            names=["chunk", "counts"])

    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(counts[1:]), f"u{counts[0]}").reshape(-1, 16)
            if chunk != current:
                if current is not None:
                    yield emit()
                current, total = chunk, part.astype(np.float64)
            else:
                total += part
    if current is not None:
        yield emit()


def without(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Codes of whole tables less one zero (even entries) and less one one (odd entries)."""
    out = np.empty((len(zeros), 2), np.uint8)
    for lo in range(0, len(out), _PART):
        a, b = zeros[lo:lo + _PART].astype(np.float32), ones[lo:lo + _PART].astype(np.float32)
        out[lo:lo + _PART, 0] = encode(np.maximum(a - 1, 0), b)
        out[lo:lo + _PART, 1] = encode(a, np.maximum(b - 1, 0))
    return out.reshape(-1)


class Learner:
    """Weights and refinement counts, learnt online over texts that the counts include."""

    def __init__(self):
        self.w = np.full((GATES, CONTEXTS + 1), 0.3)
        self.w[:, -1] = 0
        self.power = np.full_like(self.w, 1e-3)
        self.mass = np.zeros(GATES)
        self.seen = np.zeros((GATES, BUCKETS, 2))
        self.done = 0

    def learn(self, symbol: np.ndarray, hashes: np.ndarray, table: np.ndarray, bits: int) -> None:
        """``table``: the :func:`paths` of codes :func:`without` the occurrence itself."""
        lo, mix, n = 0, _Mix(0), CONTEXTS + 1
        while lo < len(symbol):
            hi = min(len(symbol), lo + min(BATCH_MAX, max(BATCH_BYTES, self.done // 16)))
            weights = _gate_weights(self.w)
            g, seen = np.zeros((2, 4, n, n)), np.zeros((2, 4, n, BUCKETS, 2))
            for at in range(lo, hi, _SPAN):
                to = min(hi, at + _SPAN)
                mix = mix if mix.n == to - at else _Mix(to - at)
                both = _bits(symbol[at:to])
                for part, (half, block) in enumerate(blocks(symbol[at:to], hashes[:, at:to], bits)):
                    mix.mix(half, block, table, weights[part])
                    bit, cell = both[part], mix.cells()
                    cell *= np.float32(2)
                    cell += bit
                    seen[part] += np.bincount(cell.astype(np.intp), minlength=seen[part].size).reshape(seen[part].shape)
                    error = np.negative(mix.z, out=mix.z)
                    np.exp(error, out=error)
                    error += np.float32(1)
                    np.divide(np.float32(-1), error, out=error)
                    error += bit
                    g[part] += mix.slopes(error)
            g[..., :-1] /= STEPS
            mass = seen.sum((3, 4))
            g /= np.maximum(mass, 1)[..., None]
            g = g.transpose(2, 0, 1, 3).reshape(GATES, n)
            self.seen += seen.transpose(2, 0, 1, 3, 4).reshape(GATES, BUCKETS, 2)
            self.mass += mass.transpose(2, 0, 1).reshape(GATES)
            self.power += g * g
            self.w += RATE * g / np.sqrt(self.power)
            self.done += hi - lo
            lo = hi

    def sums(self) -> np.ndarray:
        """Weights times the bits seen, the bits seen, and the refinement counts, in one row."""
        return np.concatenate([(self.w * self.mass[:, None]).reshape(-1), self.mass, self.seen.reshape(-1)])


def mixer(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, refine)`` of all learners, from the sum of their :meth:`Learner.sums`."""
    held, mass, seen = np.split(sums, np.cumsum([GATES * (CONTEXTS + 1), GATES]))
    mass = mass[:, None]
    w = np.where(mass > 0, held.reshape(GATES, -1) / np.maximum(mass, 1), Learner().w)
    # A bucket starts as one observation of its own middle.
    seen, middle = seen.reshape(GATES, BUCKETS, 2), _squash(np.arange(BUCKETS) / 2 - 8)
    return w, (seen[:, :, 1] + middle) / (seen.sum(2) + 1)


def _learn(batches, codes, bits: int):
    """(sums) of each learner: the texts of a learner come together, in its order."""
    current, learner = None, None
    for batch in batches:
        texts, of = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if of[lo] != current:
                if learner is not None:
                    yield _sums_row(learner)
                current, learner = of[lo], Learner()
            for run in _runs([(t or b"").lower() for t in texts[lo:hi]]):
                symbol, hashes = _fresh(run)
                learner.learn(symbol, hashes, _held_paths(codes.value, 2 * _PATH + _BIT), bits)
    if learner is not None:
        yield _sums_row(learner)
    release()


def _sums_row(learner: Learner) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([learner.sums()], pa.list_(pa.float64()))], names=["sums"])


def train(texts: DataFrame, n_bytes: int) -> Model:
    """Learn from ``texts(doc_id, text)`` of about ``n_bytes``. The driver gets tables of bounded
    size. If there is a column ``part``, its numbers are the learners of a large table, whose
    texts lie together and in order."""
    spark = texts.sparkSession
    bits = table_bits(n_bytes)
    summed = (texts.select("text").mapInArrow(partial(_gather_counts, bits=bits), "chunk int, counts binary")
                   .repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk")
                   .mapInArrow(_sum_counts, "chunk int, counts binary")).toArrow()
    counts = np.zeros((CONTEXTS << bits, 16), np.float16)
    for chunk, raw in zip(summed["chunk"].to_pylist(), summed["counts"].to_pylist()):
        part = np.frombuffer(zlib.decompress(raw), np.float16).reshape(-1, 16)
        counts[chunk * CHUNK_BLOCKS:chunk * CHUNK_BLOCKS + len(part)] = part
    zeros, ones = (x.reshape(-1) for x in node_counts(counts))
    del counts, summed
    n = max(1, min(shuffle_partitions(spark), n_bytes // LEARN_BYTES))
    if n < shuffle_partitions(spark) or "part" not in texts.columns:
        order = F.xxhash64("doc_id", "text")
        texts = (texts.select("text", "doc_id", order.alias("o"), F.pmod(order, F.lit(n)).alias("part"))
                      .repartition(n, "part").sortWithinPartitions("part", "o", "doc_id"))
    left = spark.sparkContext.broadcast(without(zeros, ones))
    sums = (texts.select("text", F.col("part").cast("long").alias("part"))
                 .mapInArrow(partial(_learn, codes=left, bits=bits), "sums array<double>")
                 .select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))).toArrow()
    left.destroy()
    total = np.zeros(len(Learner().sums()))
    total[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return Model(bits, encode_table(zeros, ones), *mixer(total))


# ----------------------------------------------------------------- words (the base score)

def _count_words(batches):
    """(unit, c, bytes): training occurrences of words, 0 for words of other documents only; one
    row without a word carries the number of training bytes."""
    held: Counter = Counter()
    names = ["unit", "c", "bytes"]

    def flush():
        keys = list(held)
        for i in range(0, len(keys), 50_000):
            part = keys[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([held[k] for k in part], pa.int64()),
                 pa.nulls(len(part), pa.int64())], names=names)
        held.clear()

    n_bytes = 0
    for batch in batches:
        for text, trains in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or b"").lower().split()
            if trains:
                held.update(words)
                n_bytes += len(text or b"")
            else:
                held.update(dict.fromkeys(words, 0))
            if len(held) > HOLD_UNITS:
                yield from flush()
    yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int64()),
                                      pa.array([n_bytes], pa.int64())], names=names)


def word_hash(key: bytes) -> int:
    """Signed 64-bit hash of a word."""
    h = xxhash.xxh3_64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _hash_words(batches, head_floor: int):
    """(h, c, head): the head keeps its word."""
    for batch in batches:
        keys, c = batch.column(0).to_pylist(), batch.column(1)
        top = [k if n >= head_floor else None for k, n in zip(keys, c.to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([word_hash(k) for k in keys], pa.int64()), c,
                                          pa.array(top, pa.binary())], names=["h", "c", "head"])


# ----------------------------------------------------------------- scoring

PARTS = T.StructType([T.StructField("rid", T.LongType()), T.StructField("h", T.LongType()),
                      T.StructField("k", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                      T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                      T.StructField("n_bytes", T.LongType()), T.StructField("n_known", T.LongType()),
                      T.StructField("base", T.DoubleType()), T.StructField("lp", T.DoubleType())])
_PARTS = pa.schema([(f.name, {"long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_(),
                              "double": pa.float64()}[f.dataType.typeName()]) for f in PARTS])


def _document_parts(batches, head, model):
    """Per document one row with its score and the sums over its head words, and one row per
    other word."""
    (index, log_count), lm = head.value, model.value
    get, digest = index.get, xxhash.xxh3_64_intdigest
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            rids, ids, held, texts = (c.to_pylist() for c in batch.columns)
            lowered = [(t or b"").lower() for t in texts]
            scores = text_scores(lowered, lm)
            rows, other_rid, other_h, other_k = [], [], [], []
            for rid, doc, out, text, lp in zip(rids, ids, held, lowered, scores):
                found = Counter(text.split())
                base, known, n_words = 0.0, 0, 0
                for word, k in found.items():
                    n_words += k
                    i = get(word)
                    if i is None:
                        other_rid.append(rid)
                        other_h.append(digest(word))
                        other_k.append(k)
                    else:
                        known += k
                        base += k * log_count[i]
                # The summary meets no word; its own hash spreads it over the join.
                rows.append((rid, word_hash(b"\x00 %d" % rid), 0, doc, out, n_words + 1, len(text), known, base, lp))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)
            n = len(other_rid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(other_rid, pa.int64()), pa.array(np.array(other_h, np.uint64).view(np.int64)),
                 pa.array(other_k, pa.int32()), *[pa.nulls(n, f.type) for f in list(_PARTS)[3:]]], schema=_PARTS)
    release()


def score_documents(docs: DataFrame, trains: Column, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte)`` of every row; the rows for which ``trains`` holds are learnt from."""
    spark = docs.sparkSession
    ship_package(spark)
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"),
                       F.coalesce(trains, F.lit(False)).alias("trains"))
    # The bit passes are heavy on each byte: texts move once, to as many parts as the cluster works
    # on, whatever the row groups of the source.
    order = F.xxhash64("doc_id", "text")
    lean = store(lean.repartition(shuffle_partitions(spark), order).withColumn("part", F.spark_partition_id())
                     .sortWithinPartitions(order, "doc_id"), "lm-texts")
    vocabulary = store(lean.select("text", "trains").mapInArrow(_count_words, "unit binary, c long, bytes long")
                           .groupBy("unit").agg(F.sum("c").alias("c"), F.sum("bytes").alias("bytes")), "lm-words")
    facts = vocabulary.agg(F.sum("c").alias("words"), F.count_if(F.col("unit").isNotNull() & (F.col("c") > 0)).alias("types"),
                           F.sum("bytes").alias("bytes")).first()
    ends = lean.where("trains").count()
    tokens = (facts.words or 0) + ends
    types = (facts.types or 0) + (1 if ends else 0)
    model = spark.sparkContext.broadcast(train(lean.where("trains").select("doc_id", "text", "part"), facts.bytes or 0))
    floor = max(1, -(-(facts.words or 0) // HEAD_SHARE))
    hashed = store(vocabulary.where("unit IS NOT NULL").select("unit", "c").mapInArrow(
        partial(_hash_words, head_floor=floor), "h long, c long, head binary"), "lm-hashed")
    top = hashed.where("head IS NOT NULL").toArrow()  # at most HEAD_SHARE rows
    head = spark.sparkContext.broadcast(({k: i for i, k in enumerate(top["head"].to_pylist())},
                                         np.log10(top["c"].to_numpy() + SMOOTHING).tolist()))
    parts = lean.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                        (~F.col("trains")).alias("held_out"), "text").mapInArrow(
        partial(_document_parts, head=head, model=model), PARTS)
    rest = hashed.where("head IS NULL").select("h", F.col("c").alias("uc"))
    j = parts.join(rest, "h", "left")
    k = F.col("k")
    d = j.select(
        "rid", "doc_id", "held_out", "n_tokens", "n_bytes", "lp",
        F.coalesce("n_known", F.when(F.col("uc") > 0, k).otherwise(0)).alias("known"),
        F.coalesce("base", k * F.log10(F.col("uc") + SMOOTHING)).alias("base")).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"),
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.max("lp").alias("lp"))
    share = math.log10(tokens + SMOOTHING * (types + 1))
    return d.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + SMOOTHING) - F.col("n_tokens") * share).alias("base_score"),
        F.col("lp").alias("score"), "n_bytes",
        F.try_divide(-F.col("lp") * math.log2(10), F.col("n_bytes")).alias("bits_per_byte"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from nine tenths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, crc_of() % 10 != 0)
