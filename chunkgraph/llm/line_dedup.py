"""Exact line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. A *run* holds 128-bit line keys that a batch was
the first to hold, bucketed and sorted by hash; runs are disjoint. The distinct keys of a new
batch are merge-joined with all runs, which moves only the batch: a key that a run has was seen
in a smaller id, so its lines go in the whole batch; the keys that no run has (the anti-join)
are new, stay in the smallest id of this batch that holds them, and become the batch's own run.
After ``fanout`` runs of one level they are compacted into one run of the next level, by merging
files: disjoint runs need no aggregation. Each batch leaves the lines that go as a small stored
table; the runs are deleted at the end, also when a batch fails.

A line goes when its key is held by at least two documents and this one is not the
smallest id holding it. Keys that hold more than a fixed share of a batch's lines (so there is a
bounded number of them) are resolved inside the scan; all others by one hash-partitioned join.

Defined results: null and empty texts are one empty line; the lines of a row without an id
are kept and do not count for others; rows that share an id are one document; very long texts
are split and rebuilt one at a time; of equal lines the one in the smallest id stays, also its
repeats there; an empty table gives an empty table. ``n_lines`` and ``n_dropped`` of the output
replace input columns of that name; no other column name matters.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm.common import (WS_CHARS, quantile_bounds, read, release, remove_path,
                                   scratch_path, shuffle_partitions, slices, store)
from chunkgraph.session import ship_package

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: A key with over 1/HOT_SHARE of all (document, key) pairs is resolved in the scan.
HOT_SHARE = 256
#: Keeper of a line that every document of a batch loses; equal to no id.
_NOBODY = "nobody"
_WS = WS_CHARS.encode()
KEY_SCHEMA = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                           T.StructField("first_doc", T.LongType()),
                           T.StructField("n", T.LongType())])
RUN_SCHEMA = T.StructType(KEY_SCHEMA.fields[:2])
DROP_SCHEMA = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                            T.StructField("doc_id", T.LongType()),
                            T.StructField("hot", T.BooleanType())])


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte key of a line, None when the normalised line is too short to count."""
    k = line.strip(_WS).lower()
    if len(k) < min_chars or (len(k) < 4 * min_chars
                              and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def _doc_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in (text or b"").split(b"\n")}
    keys.discard(None)
    return keys


def _emit_keys(batches, min_chars: int):
    """(h1, h2, first_doc, n), combined within each slice of a batch."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts, 8 << 20):
            seen: dict[bytes, list[int]] = {}
            for doc, text in zip(ids[lo:hi], texts[lo:hi]):
                for k in _doc_keys(text, min_chars):
                    got = seen.get(k)
                    if got is None:
                        seen[k] = [doc, 1]
                    else:
                        got[0] = min(got[0], doc)
                        got[1] += 1
            if seen:
                h = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
                v = np.array(list(seen.values()), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(v[:, 0]), pa.array(v[:, 1])],
                    names=["h1", "h2", "first_doc", "n"])
    release()


def _emit_occurrences(batches, min_chars: int, hot: dict[bytes, int]):
    """One row per (document, key); hot keys are decided here and leave only if they drop."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts, 8 << 20):
            keys, docs, flags = [], [], []
            for doc, text in zip(ids[lo:hi], texts[lo:hi]):
                for k in _doc_keys(text, min_chars):
                    keeper = hot.get(k)
                    if keeper is None or keeper != doc:
                        keys.append(k)
                        docs.append(doc)
                        flags.append(keeper is not None)
            if keys:
                h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()),
                     pa.array(flags, pa.bool_())], names=["h1", "h2", "doc_id", "hot"])
    release()


def _render(batches, min_chars: int):
    """(row, text, h1 list, h2 list) -> the text rebuilt from the lines that stay."""
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in slices(texts, 8 << 20):
            kept, n_lines, n_dropped = [], [], []
            for i in range(lo, hi):
                lines = (texts[i] or b"").split(b"\n")
                left, a = lines, batch.column(2)[i].as_py()
                if a:
                    raw = np.stack([np.array(a, "<i8"), np.array(batch.column(3)[i].as_py(), "<i8")], 1).tobytes()
                    drop = {raw[j:j + 16] for j in range(0, len(raw), 16)}
                    left = [x for x in lines if line_key(x, min_chars) not in drop]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [rows.slice(lo, hi - lo), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])
    release()


class Runs:
    """The levelled runs: disjoint bucketed tables of keys in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex[:12]}", scratch_path(self.spark, "line-run")
        (df.select("h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
           .option("path", path).saveAsTable(name))
        return name, path

    def add(self, keys: DataFrame) -> None:
        """Store one run of new keys; compact full levels."""
        self._put(0, self._write(keys))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            # Plain files: Spark 4.1 takes a union of bucketed scans as dealt by the key already.
            merged = self._write(self.spark.read.schema(RUN_SCHEMA).parquet(*[p for _, p in old])
                                 .repartition(self.buckets, "h1", "h2"))
            self.levels[level] = []
            self._drop(old)
            level += 1
            self._put(level, merged)

    def _put(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, path)

    def close(self) -> None:
        """Delete all runs, names and files."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def against_runs(keys: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """``keys`` with ``old``: whether a run has the key.

    Each run has a key once and is bucketed by it, so this is a chain of merge joins that
    moves only the keys.
    """
    out, seen = keys, []
    for i, run in enumerate(runs):
        seen.append(f"_in{i}")
        out = out.join(run.select("h1", "h2", F.lit(True).alias(seen[-1])), ["h1", "h2"], "left")
    old = F.coalesce(*[F.col(c) for c in seen], F.lit(False))
    return out.select(*keys.columns, old.alias("old"))


def _batch_drops(part: DataFrame, runs: Runs, min_chars: int, last: bool) -> DataFrame:
    """``(doc_id, h1, h2)`` of the lines that go in one batch; its new keys join the runs."""
    keys = part.mapInArrow(partial(_emit_keys, min_chars=min_chars), KEY_SCHEMA).groupBy("h1", "h2").agg(
        F.min("first_doc").alias("first_doc"), F.sum("n").alias("n"))
    keys = store(against_runs(keys, runs.tables()), "line-keys")
    if not last:
        runs.add(keys.where("NOT old"))
    # Of a new key its first holder keeps its lines; of an old one nobody here does.
    keeper = F.when(~F.col("old"), F.col("first_doc"))
    repeats = keys.where("old OR n > 1").select("h1", "h2", keeper.alias("keeper"), "n")
    total = repeats.agg(F.sum("n").alias("n")).first().n or 0
    floor = max(1000, total // HOT_SHARE)
    hot = {np.array([r.h1, r.h2], "<i8").tobytes(): _NOBODY if r.keeper is None else r.keeper
           for r in repeats.where(F.col("n") > floor).collect()}  # at most HOT_SHARE rows
    occ = part.mapInArrow(partial(_emit_occurrences, min_chars=min_chars, hot=hot), DROP_SCHEMA)
    # Hot rows are decided already: they take a join key of their own, so that they spread.
    occ = occ.withColumn("_j1", F.when(F.col("hot"), F.xxhash64("doc_id")).otherwise(F.col("h1")))
    rest = repeats.where(F.col("n") <= floor).select(
        F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), "keeper", F.lit(True).alias("_repeat"))
    found = occ.join(rest, (occ["_j1"] == rest["_k1"]) & (occ["h2"] == rest["_k2"]), "left")
    gone = found.where(F.col("hot") | (F.col("_repeat") & ~F.col("keeper").eqNullSafe(F.col("doc_id"))))
    return store(gone.select("doc_id", "h1", "h2"), "line-drops")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, batches: int = BATCHES,
                fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the lines that stay, plus ``n_lines`` (before)
    and ``n_dropped``. ``batches`` sets how many id ranges are taken one after another."""
    spark = docs.sparkSession
    ship_package(spark)
    lean = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    cuts = quantile_bounds(lean, "doc_id", batches)
    runs, drops = Runs(spark, fanout), []
    try:
        for i in range(len(cuts) + 1):
            part = lean
            if i > 0:
                part = part.where(F.col("doc_id") >= cuts[i - 1])
            if i < len(cuts):
                part = part.where(F.col("doc_id") < cuts[i])
            drops.append(_batch_drops(part, runs, min_chars, last=i == len(cuts)))
    finally:
        runs.close()
    gone = reduce(DataFrame.unionByName, drops).groupBy(F.col("doc_id").alias("_gone")).agg(
        F.collect_list("h1").alias("_a"), F.collect_list("h2").alias("_b"))
    # All other columns travel in one struct, out of the way of any name. Rows without an id meet
    # nothing; a second key spreads them.
    wide = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row"),
                       F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("id"))
    wide = wide.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    joined = wide.join(gone.withColumn("_salt", F.lit(0).cast("long")),
                       (F.col("id") == F.col("_gone")) & (F.col("salt") == F.col("_salt")), "left")
    schema = T.StructType([wide.schema["row"], T.StructField("text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = joined.select("row", "text", "_a", "_b").mapInArrow(partial(_render, min_chars=min_chars), schema)
    new = ("n_lines", "n_dropped")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c)
                        for c in docs.columns if c not in new], *new)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of every document, as a digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2("text", 256).alias("kept_sha256"))
