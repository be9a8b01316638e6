"""Evaluation-set queries on the driver's tables.

Samples are ``benchmark(item_id, text)`` (the code to document); ground truth is the
``documents`` text with ``doc_id = item_id``; predictions come from ``conversations`` with
``conv_id = item_id``: the answer is the first assistant turn, cleaned as a model answer is
cleaned, and the retrieved contexts are the first ten turns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.fixed import TOP_N
from chunkgraph.functions import text as tx
from chunkgraph.operators import evalset
from chunkgraph.session import ensure_checkpoint_dir
from chunkgraph.sources.tables import read_table

CONTEXT_SEP = "\n---\n"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = read_table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("source_code"))
    truth = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("docstring"))
    return bench.join(truth, "item_id", "left")


def q_eval_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples in item order (``num_samples=None``)."""
    bench = read_table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("source_code"))
    return evalset.first_n(bench, ["item_id"], None)


def q_sample_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + T4 + P10: the 50-sample set the dataset step writes."""
    return evalset.sample_eval_set(samples(spark, sf_dir), ["item_id"])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    answers = (conv.where(F.col("role") == "assistant")
                   .groupBy("conv_id")
                   .agg(F.min_by("text", "turn").alias("raw")))
    ctx = evalset.top_contexts(conv, "conv_id", "turn", "text", TOP_N)
    return (answers.join(ctx, "conv_id", "full")
                   .select(F.col("conv_id").alias("item_id"),
                           tx.clean_response("raw").alias("answer"), "contexts"))


def q_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 + E2: one evaluation row per sample."""
    rows = evalset.eval_rows(samples(spark, sf_dir), predictions(spark, sf_dir), "item_id")
    return rows.select("item_id", "question", "answer",
                       F.size("contexts").cast("long").alias("n_contexts"),
                       F.array_join("contexts", CONTEXT_SEP).alias("contexts_text"),
                       "ground_truth")


def q_eval_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + T3 + T4 + S5 + E1: the first 20 samples written as one JSON array, and the first
    12 of those read back."""
    path = f"{ensure_checkpoint_dir(spark)}/eval-{uuid.uuid4().hex[:12]}"
    taken = evalset.sample_eval_set(samples(spark, sf_dir), ["item_id"], sample_size=20)
    evalset.write_eval_set(taken, path, ["item_id", "source_code", "docstring"], ["item_id"])
    return evalset.load_eval_set(spark, path, 12, "item_id long, source_code string, docstring string")


def q_eval_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S5 at any size: all documents written as one JSON array and read back in ranges."""
    path = f"{ensure_checkpoint_dir(spark)}/array-{uuid.uuid4().hex[:12]}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    evalset.write_array(docs, path, ["doc_id", "text", "lang"], ["doc_id"])
    return evalset.read_array(spark, path, "doc_id long, text string, lang string", 4 << 20)


QUERIES = {
    "eval_array": q_eval_array,
    "eval_json": q_eval_json,
    "eval_load": q_eval_load,
    "sample_sink": q_sample_sink,
    "eval_rows": q_eval_rows,
}
