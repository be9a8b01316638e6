"""Substring dedup: passages of ``window`` words that an earlier document holds go.

Shards are made by content. Every window of a document has an *anchor*, its least hashed run of
``ANCHOR_WORDS`` words (about one anchor per 13 words; shorter runs would be
shared by stock phrases in ever new surroundings), so equal windows have equal anchors,
and the words up to ``window`` around an anchor - its *passage* - hold every window it stands
for. Anchors that one document alone holds go at once; equal passages of an anchor are one
passage that knows its least document. If an anchor has one passage left, that document is the
first holder of all its windows. The other passages go to shards by anchor: a shard builds a
compressed FM-index of its passages (:mod:`chunkgraph.llm.fmindex`) and streams them through
it; backward search gives the matching statistics, and intervals of at least ``window`` words
are reported with the least document that holds them. A passage is never cut, and a shard has
a bounded number of passages. An anchor with more than ``ANCHOR_PASSAGES`` different passages
(a passage that very many documents share, seen in ever new surroundings) does not go into one
shard: its windows are hashed (128 bits), spread, and get their least document by an aggregate.

A word goes if a window that covers it is also held by a document with a smaller id; windows
are judged on the input. Texts are compressed before they move: once to the anchors whose
passages must be read, once to the words that go.

Defined results: null and empty texts have no words; texts shorter than ``window`` stay; rows
without an id stay and do not count for others; rows that share an id do not count for each
other, whatever their texts; equal texts keep the one with the smallest id; very long texts are
handled whole; an empty table gives an empty table. Of columns that clash, only the output's
``n_words`` and ``n_removed`` replace input columns of that name; no other name matters.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm import wordhash
from chunkgraph.llm.common import read, release, slices, store
from chunkgraph.llm.fmindex import PassageIndex
from chunkgraph.session import ship_package

WINDOW = 50
ANCHOR_WORDS = 25
#: Passages of a shard on average, and of one anchor at most.
SHARD_PASSAGES = 4096
ANCHOR_PASSAGES = 16384

ANCHORS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("passage", T.LongType()),
                        T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()),
                        T.StructField("size", T.IntegerType())])
#: ``at`` is a tag of the text (31 bits) and the number of the passage's first word (32 bits).
_TAG_SHIFT = 32
PASSAGES = "anchor long, passage long, least long, text binary"
FOUND = "anchor long, passage long, cuts array<struct<lo: int, hi: int, first_doc: long>>"
_CUTS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("first_doc", pa.int64())]))


def text_tag(text: bytes) -> int:
    """Tells texts apart that share an id."""
    return xxhash.xxh32_intdigest(text) >> 1


# ----------------------------------------------------------------- anchors

def find_anchors(texts: list[bytes], window: int, k: int):
    """``(anchor, passage, text number, first word, words)`` arrays of all anchors of texts."""
    h, counts, _ = wordhash.words(texts, wordhash.UNCHANGED)
    n = len(h)
    if n < window:
        return None
    base = int(wordhash.BASE)
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.uint64(base)
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])

    def run(lo, hi):
        return wordhash._mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))

    places = np.arange(n - k + 1)
    grams = run(places, places + k)
    # Least 32-bit hash of each window, the first one of equals.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    width, span = window - k + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[:len(least) - rest], least[rest:])
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(n - window + 1)
    chosen = (least[starts + window <= ends[doc[starts]]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(chosen):
        return None
    chosen = chosen[np.concatenate([[True], np.diff(chosen) != 0])]
    owner = doc[chosen]
    begin = ends[owner] - counts[owner]
    lo = np.maximum(chosen + k - window, begin)
    hi = np.minimum(chosen + window, ends[owner])
    passage = wordhash._mix(run(lo, hi) ^ (chosen - lo).astype(np.uint64))
    return grams[chosen].view(np.int64), passage.view(np.int64), owner, lo - begin, hi - lo


def _emit_anchors(batches, window: int, k: int):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts, 1 << 18):
            part = [t or b"" for t in texts[lo:hi]]
            got = find_anchors(part, window, k)
            if got is None:
                continue
            anchor, passage, owner, first, size = got
            tags = np.array([text_tag(t) for t in part], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(passage), pa.array(np.array(ids[lo:hi], np.int64)[owner]),
                 pa.array(tags[owner] << _TAG_SHIFT | first), pa.array(size.astype(np.int32))],
                names=ANCHORS.fieldNames())
    release()


# ----------------------------------------------------------------- texts on the move

def _squeeze(batches):
    """Texts compressed; the other columns as they are."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [None if t is None else pack(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]],
                                         names=batch.schema.names)
    release()


def _moving(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_squeeze, docs.schema)


def _unpack(raw: bytes | None) -> bytes:
    return b"" if raw is None else zstandard.ZstdDecompressor().decompress(raw)


def _cut_passages(batches):
    """Texts of the wanted passages: rows (id, text, list of wanted)."""
    schema = pa.schema([("anchor", pa.int64()), ("passage", pa.int64()), ("least", pa.int64()),
                        ("text", pa.binary())])
    for batch in batches:
        for raw, wanted in zip(batch.column(1), batch.column(2)):
            text = _unpack(raw.as_py())
            tag, words, out = text_tag(text), text.split(), []
            for w in wanted.as_py():
                if w["at"] >> _TAG_SHIFT == tag:
                    lo = w["at"] & 0xFFFFFFFF
                    out.append({"anchor": w["anchor"], "passage": w["passage"], "least": w["least"],
                                "text": b" ".join(words[lo:lo + w["size"]])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    release()


# ----------------------------------------------------------------- shards

def _number(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers from 1."""
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known) + 1) for w in t], np.int64) for t in texts]


def _report(table: pa.Table, window: int) -> pa.Table:
    """One shard: index its passages, stream them, report intervals with their first holder."""
    least = table.column("least").to_numpy()
    texts = _number([t.split() for t in table.column("text").to_pylist()])
    _, owner = PassageIndex(texts, least, window).stream(texts)
    # Neighbouring windows with one first holder are one interval.
    row, at = np.nonzero(owner >= 0) if owner.size else (np.empty(0, int), np.empty(0, int))
    who = owner[row, at]
    new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(at) != 1) | (np.diff(who) != 0)])[:len(row)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    cuts = pa.StructArray.from_arrays(
        [pa.array(at[first].astype(np.int32)), pa.array((at[last] + window).astype(np.int32)), pa.array(who[first])],
        names=["lo", "hi", "first_doc"])
    bounds = np.searchsorted(row[first], np.arange(table.num_rows + 1)).astype(np.int32)
    return pa.table({"anchor": table.column("anchor"), "passage": table.column("passage"),
                     "cuts": pa.ListArray.from_arrays(pa.array(bounds), cuts)})


def _hash_windows(batches, window: int):
    """Every window of passages: (w1, w2, anchor, passage, place, least)."""
    names = ["w1", "w2", "anchor", "passage", "lo", "least"]
    for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
        out: list[list] = [[] for _ in names]
        for a, p, doc, text in zip(*[c.to_pylist() for c in batch.columns[:4]]):
            words = text.split()
            for i in range(len(words) - window + 1):
                key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[i:i + window])), "<i8")
                for col, v in zip(out, (int(key[0]), int(key[1]), a, p, i, doc)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "lo" else pa.int64())
                                          for n, c in zip(names, out)], names=names)
    release()


def _search(passages: DataFrame, window: int) -> DataFrame:
    """Intervals of the passages that the FM-indexes report."""
    shards = max(1, -(-passages.count() // SHARD_PASSAGES))
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))

    def report(table: pa.Table) -> pa.Table:
        out = _report(table, window)
        release()
        return out

    return dealt.groupBy("shard").applyInArrow(report, FOUND)


def _search_hot(passages: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many passages, window by window."""
    rows = passages.select("anchor", "passage", "least", "text").mapInArrow(
        partial(_hash_windows, window=window),
        "w1 long, w2 long, anchor long, passage long, lo int, least long")
    rows = store(rows, "hot-windows")
    firsts = rows.groupBy("w1", "w2").agg(F.min("least").alias("first_doc"))
    cut = F.struct("lo", (F.col("lo") + window).alias("hi"), "first_doc")
    return rows.join(firsts, ["w1", "w2"]).groupBy("anchor", "passage").agg(
        F.array_sort(F.collect_list(cut)).alias("cuts"))


# ----------------------------------------------------------------- the operator

def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """``(doc_id, cuts)``: words of ``docs(doc_id, text)`` that an earlier document holds, as
    ``(at, size)``; ``at`` as in :data:`ANCHORS`."""
    found = docs.where(F.col("doc_id").isNotNull()).mapInArrow(
        partial(_emit_anchors, window=window, k=k), ANCHORS)
    anchors = store(found, "window-anchors")
    shared = (anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                     .where("lo < hi").select("anchor"))
    anchors = store(anchors.join(shared, "anchor", "left_semi"), "shared-anchors")
    passages = anchors.groupBy("anchor", "passage").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "at", "size")).alias("from"))
    counts = passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_passages"))
    passages = store(passages.join(counts, "anchor"), "passages")
    alone = passages.where("n_passages = 1").select("anchor", "passage", F.array(F.struct(
        F.lit(0).alias("lo"), F.col("from.size").alias("hi"), F.col("least").alias("first_doc"))).alias("cuts"))
    wanted = passages.where("n_passages > 1").groupBy(F.col("from.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("anchor", "passage", "least", F.col("from.at").alias("at"),
                                F.col("from.size").alias("size"))).alias("wanted"))
    cut = _moving(docs).join(wanted, "doc_id").mapInArrow(_cut_passages, PASSAGES)
    cut = store(cut, "passage-texts")
    busy = passages.where(F.col("n_passages") > ANCHOR_PASSAGES).select("anchor").distinct()
    hot = cut.join(busy, "anchor", "left_semi")
    reported = alone.unionByName(_search(cut.join(busy, "anchor", "left_anti"), window)) \
                    .unionByName(_search_hot(hot, window))
    # One row per occurrence of a passage; its intervals stay in an array until they are judged.
    held = F.filter("cuts", lambda c: c["first_doc"] < F.col("doc_id"))
    found = anchors.join(reported, ["anchor", "passage"]).select("doc_id", "at", held.alias("cuts"))
    return found.where(F.size("cuts") > 0).select("doc_id", F.transform("cuts", lambda c: F.struct(
        (F.col("at") + c["lo"]).alias("at"), (c["hi"] - c["lo"]).alias("size"))).alias("cuts"))


def _without(text: bytes, places: list | None, sizes: list | None) -> tuple[list[bytes], int]:
    """``(words that stay, words before)``."""
    words = text.split()
    if not places:
        return words, len(words)
    at, size = np.array(places, np.int64), np.array(sizes, np.int64)
    mine = at >> _TAG_SHIFT == text_tag(text)
    lo = at[mine] & 0xFFFFFFFF
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, lo, 1)
    np.add.at(cover, lo + size[mine], -1)
    gone = np.cumsum(cover)[:-1] > 0
    return [w for w, g in zip(words, gone) if not g], len(words)


def _remove(batches):
    """Rows (row, text, places, sizes) -> the text without the words at those places."""
    names = ["row", "text", "n_words", "n_removed"]
    for batch in batches:
        rows, raw = batch.column(0), batch.column(1)
        for lo, hi in slices(raw.to_pylist()):
            texts, before, gone = [], [], []
            for i in range(lo, hi):
                left, n = _without(_unpack(raw[i].as_py()), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                texts.append(b" ".join(left).decode())
                before.append(n)
                gone.append(n - len(left))
            yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), pa.array(texts, pa.string()),
                                              pa.array(before, pa.int64()), pa.array(gone, pa.int64())], names=names)
    release()


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with the words that stay, joined by one space, as ``text_col``, plus
    ``n_words`` (before) and ``n_removed``; ``k`` is the length of an anchor."""
    ship_package(docs.sparkSession)
    if not 0 < k < window:
        raise ValueError("windows must be longer than their anchors")
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    gone = repeated_passages(lean, window, k).groupBy(F.col("doc_id").alias("_gone")).agg(
        F.flatten(F.collect_list("cuts")).alias("_cuts"))
    # All other columns travel in one struct, out of the way of any name.
    others = [F.col(c) for c in docs.columns if c != text_col]
    wide = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       F.struct(*others).alias("row"))
    joined = _moving(wide).join(gone, F.col("doc_id") == F.col("_gone"), "left").select(
        "row", "text", F.col("_cuts.at").alias("at"), F.col("_cuts.size").alias("size"))
    schema = T.StructType([wide.schema["row"], T.StructField("text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = joined.mapInArrow(_remove, schema)
    new = ("n_words", "n_removed")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c)
                        for c in docs.columns if c not in new], *new)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that an earlier one holds, as a digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
