"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern and every pre-token is merged on
its own. Merging uses a *rank queue*: each merge rank has a bucket with the positions where
that merge can happen, and a hierarchical bitmap over the ranks (64-way) tells by
find-first-set which bucket is next. The tokens form linked lists; an entry whose pair has
changed since it was queued is stale and is skipped when it comes up. The cost grows as
n log n, so a pre-token of any length is merged whole.

All pre-tokens a slice of documents needs go through one queue together, a bucket at a time
(:meth:`Codec.merge_all`); :meth:`Codec.merge` takes one pre-token and one position at a
time. The workers keep a two-generation cache of recent segments (a space and the word after
it, say); it bounds memory and changes no result.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are
encoded each on its own; an empty table gives an empty table; ``ids``, ``n_tokens`` and
``decoded`` of the output replace input columns of those names.
"""

from __future__ import annotations

import base64
import re
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm.common import ranges, read, release
from chunkgraph.session import ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Segments per cache generation; longer ones than this many characters are not cached.
CACHE_SEGMENTS = 250_000
CACHE_CHARS = 64
#: Documents of about this many characters share one rank queue.
SLICE_CHARS = 4 << 20
#: White space as the pattern's ``\s`` takes it.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Places where a pre-token always ends, whatever stands further away: after a character
#: that is not white space, and before the last one of a run of white space.
CUT = re.compile(f"(?<=[^{_S}])(?=[{_S}])|(?<=[{_S}])(?=[{_S}][^{_S}])")
#: A text without a run of white space (the common case) is cut by plain string splits.
RUN = re.compile(f"[{_S}][{_S}]")


class RankQueue:
    """Buckets of positions by rank under a hierarchical bitmap; empties as it is drained."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        n = max(n_ranks, 1)
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.put(rank, [position])

    def _first(self) -> int:
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            i = i << 6 | (word & -word).bit_length() - 1
        return i

    def _clear(self, rank: int) -> None:
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank and its first position, removed."""
        if not self.buckets:
            return None
        rank = self._first()
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self._clear(rank)
        return rank, position

    def put(self, rank: int, positions: list[int]) -> None:
        """Add positions to a bucket that is taken whole by :meth:`take`."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        for level in self.levels:
            word = level[rank >> 6]
            level[rank >> 6] = word | 1 << (rank & 63)
            if word:
                break
            rank >>= 6

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its whole bucket, removed."""
        if not self.buckets:
            return None
        rank = self._first()
        self._clear(rank)
        return rank, self.buckets.pop(rank)


class Codec:
    """Encoder and decoder for one vocabulary: ``{token bytes: rank}`` and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.queue = RankQueue(size)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that makes a token, as sorted keys.
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items()
                       for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [-1], np.int64)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ranks, longest, n = self.ranks, self.longest, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        # A token is known by its first byte: end[i] is where it ends (and the next one
        # starts), prev[i] where the one before it starts, want[i] the rank of its pair.
        end = list(range(1, n + 1))
        prev = list(range(-1, n))
        want = [ranks.get(piece[i:i + 2], -1) for i in range(n - 1)]
        want.append(-1)
        push, pop = self.queue.push, self.queue.pop
        for i, r in enumerate(want):
            if r >= 0:
                push(r, i)
        while (top := pop()) is not None:
            r, i = top
            if want[i] != r:
                continue  # stale
            j = end[i]
            e = end[i] = end[j]
            want[j] = -1
            want[i] = -1
            if e < n:
                prev[e] = i
                if end[e] - i <= longest:
                    r = ranks.get(piece[i:end[e]], -1)
                    if r >= 0:
                        want[i] = r
                        push(r, i)
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:e], -1) if e - p <= longest else -1
                want[p] = r
                if r >= 0:
                    push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make together, -1 for none."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (packed int32) of many pre-tokens, merged together bucket by bucket.

        Within a pre-token a bucket may be taken whole as long as its merges open no pair of
        a lower rank; the few pre-tokens where one does are merged one position at a time.
        """
        out: list[bytes | None] = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                todo.append(i)
        if not todo:
            return out
        size = np.array([len(pieces[i]) for i in todo])
        stop = np.cumsum(size)
        start = stop - size
        tok = self.byte_rank[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        n = len(tok)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[stop - 1] = -1
        prv[start] = -1
        want = np.full(n, -1)
        gone = np.zeros(n, bool)
        at = np.flatnonzero(nxt >= 0)
        want[at] = self._pair(tok[at], tok[at + 1])
        at = at[want[at] >= 0]
        at = at[np.argsort(want[at], kind="stable")]
        ranks = want[at]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ranks)) + 1, [len(at)]])
        put, take = self.queue.put, self.queue.take
        if len(at):
            for lo, hi, r in zip(cut[:-1].tolist(), cut[1:].tolist(), ranks[cut[:-1]].tolist()):
                put(r, at[lo:hi].tolist())
        redo: set[int] = set()
        while (top := take()) is not None:
            r, bucket = top
            p = _sorted_set(np.array(bucket))
            p = p[want[p] == r]  # the others are stale
            if not len(p):
                continue
            q = nxt[p]
            if (q[:-1] == p[1:]).any():  # a run of the same pair: every other one merges
                keep, skip = [], -1
                for k, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x == skip:
                        skip = -1
                    else:
                        keep.append(k)
                        skip = y
                p, q = p[keep], q[keep]
            s = nxt[q]
            tok[p], nxt[p] = r, s
            more = s >= 0
            prv[s[more]] = p[more]
            gone[q] = True
            want[q] = -1
            want[p] = -1
            before = prv[p]
            x = _sorted_set(np.concatenate([p[more], before[before >= 0]]))
            new = self._pair(tok[x], tok[nxt[x]])
            want[x] = new
            ok = new >= 0
            x, new = x[ok], new[ok]
            if (new < r).any():
                redo.update(np.searchsorted(stop, x[new < r], "right").tolist())
            for rank, position in zip(new.tolist(), x.tolist()):
                put(rank, [position])
        left = ~gone
        ids = tok[left].astype("<i4").tobytes()
        ends = np.cumsum(np.add.reduceat(left.astype(np.int64), start)) * 4
        lo = 0
        for k, (i, hi) in enumerate(zip(todo, ends.tolist())):
            out[i] = (np.array(self.merge(pieces[i]), "<i4").tobytes() if k in redo
                      else ids[lo:hi])
            lo = hi
        return out

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Ids of text segments, each cut into its pre-tokens; a pre-token is merged once."""
        index: dict[str, int] = {}
        made = [[index.setdefault(t, len(index)) for t in self.pattern.findall(s)] for s in segments]
        ids = self.merge_all([t.encode("utf-8") for t in index])
        return [ids[m[0]] if len(m) == 1 else b"".join([ids[i] for i in m]) for m in made]

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """Put the segments of ``keys`` into the cache; returns those too long for it.

        The key of a segment that is a space and a word is the word, that of a newline and a
        word is the segment itself; that of any other segment is the segment behind a space.
        """
        if len(self.new) + len(keys) > CACHE_SEGMENTS:
            self.old, self.new = self.new, {}
        known = {k: v for k in keys if (v := self.old.get(k)) is not None}
        fresh = [k for k in keys if k not in known]
        found = dict(zip(fresh, self._segments([_segment_of(k) for k in fresh])))
        self.new.update(known)
        long = {k: v for k, v in found.items() if len(k) > CACHE_CHARS}
        self.new.update((k, v) for k, v in found.items() if k not in long)
        return long

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of whole texts."""
        get = self.new.get
        out: list[bytes] = []
        waiting: list[tuple[int, list, list]] = []
        missed: set[str] = set()
        for t in texts:
            keys = _cut(t) if t else []
            values = list(map(get, keys))
            if None in values:
                missed.update([k for k, v in zip(keys, values) if v is None])
                waiting.append((len(out), keys, values))
                out.append(b"")
            else:
                out.append(b"".join(values))
        if missed:
            long = self._learn(missed)
            get = self.new.get
            for i, keys, values in waiting:
                out[i] = b"".join([v if v is not None else get(k) or long[k]
                                   for k, v in zip(keys, values)])
        return [np.frombuffer(x, "<i4") for x in out]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        if not len(ids):
            return b""
        return gather(self.flat, self.offsets, self.lengths, ids)


def _sorted_set(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; for arrays as short as most buckets are."""
    if len(x) < 2:
        return x
    x.sort()
    fresh = np.empty(len(x), bool)
    fresh[0] = True
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x if fresh.all() else x[fresh]


def _cut(text: str) -> list[str]:
    """The cache keys of the segments of a text, in order."""
    if text[0].isspace() or text[-1].isspace() or RUN.search(text):
        return [s[1:] if s[0] == " " and len(s) > 1 and not s[1].isspace() else " " + s
                for s in CUT.split(text)]
    # "a b\nc" -> segments "a", " b", "\nc"
    first, *rest = text.replace("\n", " \n").split(" ")
    return [" " + first, *rest]


def _segment_of(key: str) -> str:
    return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key


def gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The pieces ``flat[offsets[i]:offsets[i] + lengths[i]]`` for all ids, one after another."""
    out = []
    for lo in range(0, len(ids), 1 << 18):
        part = ids[lo:lo + (1 << 18)]
        n = lengths[part]
        shift = offsets[part] - (np.cumsum(n) - n)
        at = np.repeat(shift, n)
        at += np.arange(len(at))
        out.append(flat[at].tobytes())
    return b"".join(out)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """``{token: rank}`` of a rank file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


_CODECS: dict[tuple[int, int, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of a rank file, made once per Python worker."""
    key = (len(data), hash(data), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def _encode_rows(batches, vocabulary, pattern: str, names: list[str], text_at: int, decode: bool):
    c = codec(vocabulary.value, pattern)
    for batch in batches:
        column = batch.column(text_at)
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for lo, hi in ranges(size, SLICE_CHARS):
            ids = c.encode_all(column.slice(lo, hi - lo).to_pylist())
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.empty(0, "<i4")
            rows = batch.slice(lo, hi - lo)
            out = {name: rows.column(i) for i, name in enumerate(names) if name is not None}
            out["n_tokens"] = pa.array(n)
            out["ids"] = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            if decode:
                out["decoded"] = pa.array([c.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    release()


def _decode_rows(batches, vocabulary, pattern: str, at: int):
    c = codec(vocabulary.value, pattern)
    for batch in batches:
        ids = batch.column(at).to_pylist()
        got = [None if x is None else c.decode(np.array(x, "<i4")) for x in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())],
                                         names=[*batch.schema.names, "decoded"])


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank file as a broadcast (its size is the vocabulary's) and the pattern."""
    if path is None or pattern is None:
        import public_tokenizers
        path = path or public_tokenizers.path(VOCABULARY)
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern


def bpe_encode(docs: DataFrame, text_col: str = "text", path: str | None = None,
               pattern: str | None = None, decode: bool = False,
               keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_tokens`` and ``ids`` and, with ``decode``, ``decoded`` (bytes made
    from the ids). ``path`` is the rank file on the driver."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary, pattern = _vocabulary(spark, path, pattern)
    added = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False)}
    if decode:
        added["decoded"] = T.BinaryType()
    cols = [c for c in docs.columns if c not in added or c == text_col]
    out = [c for c in cols if c not in added and (keep_text or c != text_col)]
    schema = T.StructType([*[docs.schema[c] for c in out],
                           *[T.StructField(k, v) for k, v in added.items()]])
    return docs.select(cols).mapInArrow(
        partial(_encode_rows, vocabulary=vocabulary, pattern=pattern, decode=decode,
                names=[c if c in out else None for c in cols], text_at=cols.index(text_col)), schema)


def bpe_decode(df: DataFrame, ids_col: str = "ids", path: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """``df`` plus ``decoded``, the bytes of ``ids_col`` (null ids: null)."""
    ship_package(df.sparkSession)
    vocabulary, pattern = _vocabulary(df.sparkSession, path, pattern)
    d = df.drop("decoded")
    return d.mapInArrow(partial(_decode_rows, vocabulary=vocabulary, pattern=pattern,
                                at=d.columns.index(ids_col)),
                        T.StructType([*d.schema, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of the ids and of the decoded bytes."""
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe_encode(docs, decode=True, keep_text=False))
