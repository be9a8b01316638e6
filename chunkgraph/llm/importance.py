"""Importance resampling towards a target distribution, over hashed n-gram counts.

A text is lower-cased (A-Z only) and every run of separators becomes one space, so that one
scan per n - ``regex`` with ``overlapped=True`` between two lookarounds - emits the span of
every run of n words; the CRC-32 of the span's bytes gives its bucket. The bucket numbers of a
document are stored once (two bytes each). What follows reads that store only: bucket totals
(counted within each task first), the documents' mean gains, and the draw.

The draw is Gumbel top-k: a document's score is its weight plus noise from a hash of its id,
and the highest scores win. Ranks come from a range-partitioned sort with per-partition
offsets, so neither the ranking nor the draw passes through one task.

Defined results: null and empty texts have no words, no features and weight 0; a row without
an id draws with the noise of an empty id; very long texts are scanned whole, one text at a
time; ties go to the smaller id, rows that share an id and a score are ranked side by side;
an empty corpus gives an empty table, an empty target gains that only reflect the corpus. Only
the id and text columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm.common import read, release, slices, store
from chunkgraph.operators.index import dense_ids
from chunkgraph.session import ship_package

MAX_N = 2
BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
SEED = 7

#: Bytes that separate words, and A-Z to lower case; bytes of other characters belong to words.
_SEPARATORS = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - set(range(0x41, 0x5B))
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                         T.StructField("n_features", T.LongType()),
                         T.StructField("buckets", T.BinaryType())])


def ngram_pattern(n: int) -> regex.Pattern:
    """Runs of ``n`` words in a text whose words are separated by single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]++" + rb" [^ ]++" * (n - 1) + rb"(?![^ ])")


def normalise(text: bytes | None) -> bytes:
    """Lower-cased words with single spaces between them."""
    return b" ".join((text or b"").translate(_FOLD).split())


def feature_buckets(line: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    """Bucket number of every n-gram of a normalised text, repeats included."""
    crc = zlib.crc32
    hashes = np.fromiter((crc(m[0]) for p in patterns for m in p.finditer(line, overlapped=True)),
                         np.uint32)
    return hashes % np.uint32(buckets)


def _width(buckets: int):
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _scan(batches, max_n: int, buckets: int):
    patterns = [ngram_pattern(n) for n in range(1, max_n + 1)]
    width = _width(buckets)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in slices(texts):
            lines = [normalise(t) for t in texts[lo:hi]]
            found = [feature_buckets(x, patterns, buckets) for x in lines]
            n_words = [x.count(b" ") + 1 if x else 0 for x in lines]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n_words, pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([f.astype(width).tobytes() for f in found], pa.binary())],
                names=FEATURES.fieldNames())
    release()


def hashed_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: the buckets of all its n-grams up to ``max_n`` (:data:`FEATURES`)."""
    ship_package(docs.sparkSession)
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    return lean.mapInArrow(partial(_scan, max_n=max_n, buckets=buckets), FEATURES)


def _tally(batches, buckets: int):
    """Bucket counts of one task: at most ``buckets`` rows."""
    total = np.zeros(buckets, np.int64)
    width = _width(buckets)
    for batch in batches:
        for raw in batch.column(0):
            total += np.bincount(np.frombuffer(raw.as_buffer(), width), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])],
                                     names=["bucket", "n"])


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Counts per bucket over a whole table; ``buckets`` rows reach the driver at most."""
    rows = (features.select("buckets").mapInArrow(partial(_tally, buckets=buckets),
                                                  "bucket long, n long")
                    .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of target to corpus share per bucket, smoothed by one."""
    size, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))))
            for s, t in zip(corpus, target)]


def _weigh(batches, gains: np.ndarray, width):
    for batch in batches:
        weights = []
        for raw in batch.column(3):
            at = np.frombuffer(raw.as_buffer(), width)
            weights.append(int(gains[at].sum()) // len(at) if len(at) else 0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(weights, pa.int64())],
            names=["doc_id", "n_words", "n_features", "weight"])


def gumbel_noise(id_col: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a hash of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", target_text_col: str = "text", max_n: int = MAX_N,
                      buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS,
                      seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document.

    ``percent`` of the documents with at least ``min_words`` words are drawn; ``rank`` counts
    them from the highest score and is null for the others.
    """
    features = store(hashed_features(docs, id_col, text_col, max_n, buckets), "ngram-buckets")
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"),
                                           F.col(target_text_col).alias("text")),
                             max_n=max_n, buckets=buckets)
    gains = np.array(bucket_gains(bucket_totals(features, buckets), bucket_totals(wanted, buckets)),
                     np.int64)
    weighed = features.mapInArrow(partial(_weigh, gains=gains, width=_width(buckets)),
                                  "doc_id long, n_words long, n_features long, weight long")
    scored = store(weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed)),
                   "importance-scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    n_drawn = percent * eligible.count() // 100
    ranked = dense_ids(eligible.withColumn("_down", -F.col("score")),
                       ["_down", "doc_id", "n_features"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(names).unionByName(rest.select(names))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are."""
    drawn = importance_scores(docs, target, id_col, text_col, **options).where("rank IS NOT NULL")
    return docs.join(drawn.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and rank in the draw towards the benchmark's texts."""
    return importance_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
