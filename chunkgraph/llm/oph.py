"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Every 5-word shingle of a text is hashed once; the high bits of the hash name one of ``BINS``
bins, the rest compete for the bin's minimum. An empty bin copies the value of a full bin
that it finds by its own fixed random walk over the bins (optimal densification: the walk
depends on the bin and the attempt only, so two texts copy alike). Of each bin the ``BITS``
low-order bits are kept and packed; likeness is the share of equal bins, corrected for the
2**-BITS chance of equality: ``(m - c) / (1 - c)``, cut to 0..1.

Defined results: null, empty and blank texts have an empty fingerprint; two empty ones are
alike (1.0), an empty one and another are not (0.0). Fewer words than a shingle make one
shingle. Equal texts have equal fingerprints, wherever they are computed; repeated rows each
come back, in the successive form they are neighbours. A very long text is hashed whole. An empty
table gives an empty table. Only the id and text columns are read, so no other column name
matters.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm import wordhash
from chunkgraph.llm.common import quantile_bounds, read, shuffle_partitions, slices
from chunkgraph.session import ship_package

BINS = 512
BITS = 4
SHINGLE_WORDS = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Id ranges per shuffle partition in :func:`successive_likeness`.
RANGES_PER_PARTITION = 4


def _walks(bins: int) -> np.ndarray:
    """For every bin the order in which it tries other bins, as an endless hash sequence."""
    attempts = 64
    seed = (np.arange(bins, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(
        1, attempts + 1, dtype=np.uint64)[None, :]
    return (wordhash._mix(seed) % np.uint64(bins)).astype(np.int64)


_WALKS = {BINS: _walks(BINS)}


def densify(table: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a full one."""
    bins = table.shape[1]
    walk = _WALKS.setdefault(bins, _walks(bins))
    out = table.copy()
    row, col = np.nonzero((table == _EMPTY) & (table != _EMPTY).any(1)[:, None])
    attempt = 0
    while len(row):
        if attempt < walk.shape[1]:
            src = walk[col, attempt]
        else:  # very few full bins: go on with fresh draws of the same sequence
            src = (wordhash._mix((col.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt + 1))
                   % np.uint64(bins)).astype(np.int64)
        value = table[row, src]
        hit = value != _EMPTY
        out[row[hit], col[hit]] = value[hit]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


def sketches(texts: list, bins: int = BINS, bits: int = BITS, k: int = SHINGLE_WORDS
             ) -> tuple[np.ndarray, np.ndarray]:
    """``(values, full)``: the kept low bits of every bin of each text, and whether the text
    has any shingle."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    out = np.zeros((len(texts), bins), np.uint8)
    full = np.zeros(len(texts), bool)
    for lo, hi in slices(texts):
        h, counts = wordhash.shingles(*wordhash.words([t or b"" for t in texts[lo:hi]])[:2], k)
        table = np.full((hi - lo) * bins, _EMPTY)
        doc = np.repeat(np.arange(hi - lo), counts)
        at = doc * bins + (h >> shift).astype(np.int64)
        np.minimum.at(table, at, h & ((np.uint64(1) << shift) - np.uint64(1)))
        table = densify(table.reshape(hi - lo, bins))
        full[lo:hi] = counts > 0
        # A mixer makes the kept bits independent of the size of the minimum.
        out[lo:hi] = (wordhash._mix(table) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    out[~full] = 0
    return out, full


def pack(values: np.ndarray, full: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints as hex strings ("" for a text without shingles)."""
    planes = np.unpackbits(values[:, :, None], axis=2)[:, :, 8 - bits:]
    rows = np.packbits(planes.reshape(len(values), -1), axis=1)
    return [r.tobytes().hex() if f else "" for r, f in zip(rows, full)]


def unpack(fingerprint: str, bits: int = BITS) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return planes @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: np.ndarray, a_full, b: np.ndarray, b_full, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of sketches, corrected for chance matches."""
    c = 2.0 ** -bits
    est = np.clip(((a == b).mean(-1) - c) / (1 - c), 0, 1)
    a_full, b_full = np.asarray(a_full), np.asarray(b_full)
    return np.where(a_full & b_full, est, np.where(a_full | b_full, 0.0, 1.0))


def _fingerprint_rows(batches, bins: int, bits: int, k: int):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        values, full = sketches(texts, bins, bits, k)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pack(values, full, bits))], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bins: int = BINS, bits: int = BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row."""
    ship_package(docs.sparkSession)
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    return lean.mapInArrow(partial(_fingerprint_rows, bins=bins, bits=bits, k=shingle_words),
                           "doc_id long, fingerprint string")


def _range_udf(bounds: list[int]):
    """The ranges an id goes to: its own and, for the first id of a range, also the one
    before it (the last range precedes the first)."""
    n = len(bounds)
    cut = np.array(bounds, np.int64)

    @F.pandas_udf("array<int>")
    def of(ids):
        import pandas as pd
        v = ids.fillna(cut[0]).to_numpy().astype(np.int64)
        own = np.maximum(np.searchsorted(cut, v, "right") - 1, 0)
        return pd.Series([[int(o), int(o - 1) % n] if h else [int(o)]
                          for o, h in zip(own, cut[own] == v)])
    return of


SUCCESSIVE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])


def splice(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _successive_rows(batches, bins: int, bits: int, k: int):
    """Rows arrive sorted by (range, ghost, doc_id, text); a ghost is the head of the next
    range. Every row is paired with the row after it."""
    def emit(rows, alone=False):
        """``rows``: consecutive (doc_id, text); all but the last are judged. Rows ``alone``
        have no next one."""
        texts = [t for _, t in rows]
        edited = [splice(a, "" if alone else b).encode() for a, b in zip(texts, texts[1:])]
        own, own_full = sketches([t.encode() for t in texts], bins, bits, k)
        new, new_full = sketches(edited, bins, bits, k)
        n = len(edited)
        after, after_full = own[1:], own_full[1:]
        if alone:
            after, after_full = np.zeros_like(after), np.zeros_like(after_full)
        ids = [d for d, _ in rows[:-1]]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array(pack(own[:n], own_full[:n], bits), pa.string()),
            pa.array(pack(new, new_full, bits), pa.string()),
            pa.array(likeness(own[:n], own_full[:n], new, new_full, bits)),
            pa.array(likeness(own[:n], own_full[:n], after, after_full, bits))],
            names=[f.name for f in SUCCESSIVE])

    current, rows, held, closed = None, [], 0, False
    for batch in batches:
        for group, ghost, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            if group < 0:
                yield emit([(doc, text), (None, "")], alone=True)
                continue
            if group != current:
                if rows and not closed and len(rows) > 1:
                    yield emit(rows)
                current, rows, held, closed = group, [], 0, False
            if closed:
                continue  # a further row with the head's id
            text = text or ""
            rows.append((doc, text))
            held += len(text)
            closed = ghost
            if held > (1 << 20) or closed:
                if len(rows) > 1:
                    yield emit(rows)
                rows, held = [rows[-1]], len(rows[-1][1])
    if rows and not closed and len(rows) > 1:
        yield emit(rows)


def successive_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        bins: int = BINS, bits: int = BITS,
                        shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its splice with the next text in id order.

    The texts move once, to id ranges; the ranges' bounds are ids of the table, and the row
    with such an id also goes, as a ghost, to the range before, so that every row meets the
    next one. The row after the last is the first. Rows of equal id follow each other in
    order of their texts; a row without an id has no place in the order and is followed by
    an empty text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    least = lean.agg(F.min("doc_id").alias("m")).first().m
    if least is None:
        least = 0
    bounds = sorted({least, *quantile_bounds(lean, "doc_id", parts * RANGES_PER_PARTITION)})
    nowhere = F.array((-1 - F.pmod(F.xxhash64("text"), F.lit(parts * RANGES_PER_PARTITION))).cast("int"))
    placed = lean.withColumn("_to", F.when(F.col("doc_id").isNull(), nowhere)
                             .otherwise(_range_udf(bounds)("doc_id")))
    placed = placed.select(F.posexplode("_to").alias("_ghost", "_range"), "doc_id", "text")
    placed = placed.select("_range", (F.col("_ghost") == 1).alias("_ghost"), "doc_id", "text")
    placed = (placed.repartition(parts, "_range")
                    .sortWithinPartitions("_range", "_ghost", F.asc_nulls_first("doc_id"), "text"))
    return placed.mapInArrow(partial(_successive_rows, bins=bins, bits=bits, k=shingle_words),
                             SUCCESSIVE)


def op1_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return successive_likeness(read(spark, sf_dir, "documents"))
