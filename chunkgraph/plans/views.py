"""Bindings of the operators to the driver's tables.

* CG - a code graph: one chunk per part, one call edge per pair of consecutive line items
  of an order.
* LN - line tables of ``documents``.

The same definitions are written as DuckDB SQL in :mod:`chunkgraph.plans.oracles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkgraph.session import grow_shuffles
from chunkgraph.sources.tables import read_table


def _successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) for every pair of consecutive line items of an order (with repeats)."""
    grow_shuffles(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return (li.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"))
              .where(F.col("b").isNotNull()))


def cg_edges_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (a, b) part pairs where b follows a inside one order."""
    return _successions(spark, sf_dir).distinct()


def call_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, calls)``: the calls of the code graph in pieces, with repeats."""
    pairs = _successions(spark, sf_dir)
    return pairs.select(F.col("a").alias("id"), F.array(part_name(F.col("b"))).alias("calls"))


def part_name(col) -> F.Column:
    return F.concat(F.lit("part_"), col.cast("string"))


def cg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table ``(caller_id, callee)`` of the code graph."""
    e = cg_edges_num(spark, sf_dir)
    return e.select(F.col("a").alias("caller_id"), part_name(F.col("b")).alias("callee"))


def cg_chunks(spark: SparkSession, sf_dir: str, with_calls: bool = False) -> DataFrame:
    """The chunk table of the code graph.

    ``calls`` (the sorted callee names of each chunk) is attached only when asked for; the
    graph operators work from the edge table, so the array is never built on their path.
    """
    p = read_table(spark, sf_dir, "part")
    chunks = p.select(
        F.col("p_partkey").alias("id"),
        part_name(F.col("p_partkey")).alias("name"),
        F.concat(F.when(F.col("p_size") % 7 == 0, F.lit("tests/")).otherwise(F.lit("src/")),
                 F.regexp_replace(F.lower("p_brand"), "#", "_"), F.lit(".py")).alias("path"),
        F.when(F.col("p_size") % 5 == 0, F.lit("method")).otherwise(F.lit("function")).alias("type"),
        F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("parent_class"),
        F.col("p_name").alias("content"),
        F.col("p_size").alias("line_number"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("docstring"),
    )
    if not with_calls:
        return chunks
    # collect_set deduplicates map-side, so the pairs need no separate distinct shuffle; keys
    # become names after it.
    calls = (_successions(spark, sf_dir)
             .groupBy(F.col("a").alias("caller_id"))
             .agg(F.sort_array(F.transform(F.collect_set("b"), part_name)).alias("calls")))
    return (chunks.join(calls, chunks.id == calls.caller_id, "left")
                  .drop("caller_id")
                  .withColumn("calls", F.coalesce("calls", F.array().cast("array<string>"))))
