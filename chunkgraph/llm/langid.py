"""Language identification with language-bitmask n-gram filters.

Byte n-grams of the lower-cased text (letters, with one space at word ends) are counted per
language over all training documents. An n-gram belongs to a language when its rate there
is well above the mean rate over the languages. All memberships go into one bit-sliced Bloom
filter: a table of 64-bit masks, one bit per language (further slices beyond 64); an n-gram
sets its languages' bits in ``HASHES`` slots, and the AND of its slots returns all languages
that contain it at once. A text's hits are counted per language, corrected by the share of
false positives each language's fill implies, ``(hits - n * fp) / (1 - fp)``, and the largest
count decides. The filter's size follows the counted members, so that no language fills more
than ``MAX_FILL`` of it, up to ``MAX_SLOTS`` masks (32 MB per 64 languages, the size of the
broadcast model); a language with still more members keeps its most frequent ones.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text with
letters but no known n-gram gets the most frequent training language with score 0; ties go
to the language that sorts first; without any training row every text is ``und``. Rows of
null lang teach nothing, repeated rows count as often as they come, very long texts are counted
and scored whole, empty tables give empty tables. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm.common import read, slices, store
from chunkgraph.session import ship_package

ORDERS = (3, 4)
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 22
HASHES = 3
MAX_FILL = 0.125
#: Per-language tables of at most this many rows may be broadcast.
BROADCAST_ROWS = 10_000
#: An n-gram belongs to a language whose rate is this many times the mean rate.
RATE_FACTOR = 1.5
MIN_COUNT = 2
#: Distinct n-grams a task holds before it hands its counts on.
HOLD_GRAMS = 2_000_000
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_MAP = np.full(256, 32, np.uint8)
_MAP[128:] = np.arange(128, 256)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    langs: list[str]
    default: str
    table: np.ndarray  # (slices, slots) masks
    false_positive: np.ndarray  # per language


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, doc)``: the n-grams of all texts, packed with their order, and the index of
    the text each comes from. Runs of other characters count as one space."""
    joined = b"".join([b"\x20" + (t or "").lower().encode("utf-8", "replace") + b"\x20" for t in texts])
    raw = _MAP[np.frombuffer(joined, np.uint8)]
    sizes = np.array([len((t or "").lower().encode("utf-8", "replace")) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    raw, doc = raw[keep].astype(np.uint64), doc[keep]
    codes, owner = [], []
    for n in ORDERS:
        if len(raw) < n:
            continue
        m = len(raw) - n + 1
        code = np.full(m, n, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | raw[j:j + m]
        same = doc[:m] == doc[n - 1:]
        codes.append(code[same])
        owner.append(doc[:m][same])
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(codes), np.concatenate(owner)


def _count_rows(batches):
    """(lang, gram, n) summed over the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        for lang, (g, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
        for lo, hi in slices(texts, 2 << 20):
            for lang in sorted(set(langs[lo:hi])):
                g, _ = grams([t for t, x in zip(texts[lo:hi], langs[lo:hi]) if x == lang])
                g, n = np.unique(g, return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], g])
                    u, at = np.unique(both, return_inverse=True)
                    g, n = u, np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = (g, n.astype(np.int64))
            if sum(len(g) for g, _ in held.values()) > HOLD_GRAMS:
                yield from flush()
    yield from flush()


def slots_of(codes: np.ndarray, n_slots: int) -> list[np.ndarray]:
    """The filter slots of n-grams, of a power of two: double hashing."""
    a = _mix(codes * np.uint64(0x9E3779B97F4A7C15))
    b = _mix(a ^ np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return [((a + np.uint64(j) * b) & np.uint64(n_slots - 1)).astype(np.int64) for j in range(HASHES)]


def slots_for(members: int) -> int:
    """A power of two that keeps the fill of a language with so many members under MAX_FILL."""
    return min(MAX_SLOTS, max(MIN_SLOTS, 1 << int(np.ceil(np.log2(max(1, HASHES * members / MAX_FILL))))))


def _mask_rows(batches, n_slots: int):
    """(slice, slot, mask) of the memberships of each n-gram."""
    for batch in batches:
        codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        index = batch.column(1).to_numpy(zero_copy_only=False)
        mask = (np.uint64(1) << (index % 64).astype(np.uint64)).view(np.int64)
        for s in slots_of(codes, n_slots):
            yield pa.RecordBatch.from_arrays([pa.array((index // 64).astype(np.int32)), pa.array(s),
                                              pa.array(mask)], names=["slice", "slot", "mask"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn the filter from all rows of ``docs``, which are read once. What reaches the driver
    is one row per language and at most ``MAX_SLOTS`` masks per 64 languages."""
    spark = docs.sparkSession
    ship_package(spark)
    lean = docs.where(F.col(lang_col).isNotNull()).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    counts = store(lean.mapInArrow(_count_rows, "lang string, gram long, n long")
                       .groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    seen = lean.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect()
    if not seen:
        return Model([], UND, np.zeros((1, MIN_SLOTS), np.uint64), np.zeros(0))
    langs = sorted(r.lang for r in seen)
    default = min(seen, key=lambda r: (-r.docs, r.lang)).lang
    # Orders differ in size, so rates are taken per order; the order is the code's top byte.
    order = F.when(F.col("gram") >= (ORDERS[-1] << 8 * ORDERS[-1]), ORDERS[-1]).otherwise(ORDERS[0])
    per = counts.withColumn("order", order)
    totals = {(r.order, r.lang): r.t for r in
              per.groupBy("order", "lang").agg(F.sum("n").alias("t")).collect()}
    index = spark.createDataFrame([(o, lang, float(t), langs.index(lang)) for (o, lang), t in totals.items()],
                                  "order int, lang string, total double, i int")
    small = F.broadcast(index) if len(totals) <= BROADCAST_ROWS else index
    rates = per.join(small, ["order", "lang"]).withColumn("rate", F.col("n") / F.col("total"))
    sums = rates.groupBy("gram").agg(F.sum("rate").alias("all"),
                                     F.collect_list(F.struct("i", "n", "rate")).alias("by"))
    # ``by`` has at most one entry per language.
    member = store(sums.select("gram", "all", F.explode("by").alias("m"))
                       .where((F.col("m.n") >= MIN_COUNT)
                              & (F.col("m.rate") >= min(RATE_FACTOR / len(langs), 1.0) * F.col("all")))
                       .select("gram", F.col("m.i").alias("i"), F.col("m.n").alias("n")), "gram-members")
    held = {r.i: r.c for r in member.groupBy("i").agg(F.count(F.lit(1)).alias("c")).collect()}
    n_slots = slots_for(max(held.values(), default=0))
    room = int(MAX_FILL * n_slots / HASHES)
    crowded = {i: 1 - room / c for i, c in held.items() if c > room}
    if crowded:
        # Only at MAX_SLOTS: the frequency from which on a language's members have room.
        least = {i: member.where(F.col("i") == i).agg(F.percentile_approx("n", q, 100_000)).first()[0]
                 for i, q in crowded.items()}
        floor = reduce(lambda c, kv: c.when(F.col("i") == kv[0], F.lit(kv[1])), least.items(), F)
        member = member.where(F.col("n") > F.coalesce(floor, F.lit(0)))
    masks = (member.select("gram", "i")
                   .mapInArrow(partial(_mask_rows, n_slots=n_slots), "slice int, slot long, mask long")
                   .groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask"))).toArrow()
    table = np.zeros(((len(langs) + 63) // 64, n_slots), np.uint64)
    table[masks["slice"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / n_slots
                     for i in range(len(langs))])
    return Model(langs, default, table, fill ** HASHES)


def scores(texts: list, model: Model) -> np.ndarray:
    """Corrected hit counts, one row per text and one column per language."""
    codes, doc = grams(texts)
    out = np.zeros((len(texts), len(model.langs)))
    total = np.bincount(doc, minlength=len(texts)).astype(float)
    at = slots_of(codes, model.table.shape[1])
    for s in range(len(model.table)):
        hit = model.table[s][at[0]]
        for j in at[1:]:
            hit &= model.table[s][j]
        for i in range(64 * s, min(64 * s + 64, len(model.langs))):
            bit = (hit >> np.uint64(i % 64) & np.uint64(1)).astype(np.float64)
            out[:, i] = np.bincount(doc, bit, minlength=len(texts))
    fp = model.false_positive
    return np.maximum((out - total[:, None] * fp) / np.maximum(1 - fp, 1e-9), 0)


def _predict_rows(batches, shared):
    model = shared.value
    for batch in batches:
        texts = batch.column(1).to_pylist()
        pred, score = [], []
        for lo, hi in slices(texts):
            part = texts[lo:hi]
            if model.langs:
                c = scores(part, model)
                best, total = c.argmax(1), c.sum(1)
            for k, t in enumerate(part):
                if not model.langs or not t or not _LETTER.search(t):
                    pred.append(UND)
                    score.append(0.0)
                elif total[k] <= 0:
                    pred.append(model.default)
                    score.append(0.0)
                else:
                    pred.append(model.langs[best[k]])
                    score.append(float(c[k, best[k]] / total[k]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
             batch.column(2)], names=["doc_id", "lang_pred", "score", "held_out"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            held_out: Column | None = None) -> DataFrame:
    """``(doc_id, lang_pred, score, held_out)`` of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"))
    return lean.mapInArrow(partial(_predict_rows, shared=shared),
                           "doc_id long, lang_pred string, score double, held_out boolean")


def crc_of(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from two thirds of them."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_of() % 3 == 1
    model = train(docs.where(~held_out).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model, held_out=held_out).select(
        "doc_id", "held_out", "lang_pred", "score")
