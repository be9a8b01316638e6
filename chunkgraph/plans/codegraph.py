"""Registered queries over the code-graph view (CG) of the driver's tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame; the DuckDB form of each is
in :mod:`chunkgraph.plans.oracles`. Column names and integer widths match between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.functions import text as tx
from chunkgraph.operators import graph, index, rank
from chunkgraph.plans import views


def _cg(spark: SparkSession, sf_dir: str):
    return views.cg_chunks(spark, sf_dir), views.cg_edges(spark, sf_dir)


def q_edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 + A2: chunk call lists -> distinct edge rows. A part's calls arrive as many short
    lists, one per order line, so that a part in very many orders is no long array."""
    return graph.build_edges(views.call_lists(spark, sf_dir))


def q_undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks without a docstring."""
    chunks = views.cg_chunks(spark, sf_dir)
    return rank.undocumented_targets(chunks).select("id", "name", "path")


def q_target_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the work queue in order."""
    return rank.target_queue(views.cg_chunks(spark, sf_dir)).select("place", "id")


def q_lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every queued id resolved to its chunk (what the dispatcher fetches)."""
    chunks = views.cg_chunks(spark, sf_dir)
    queue = rank.undocumented_targets(chunks).select(F.col("id").alias("job_id"))
    return index.lookup_by_id(chunks, queue, "job_id").select(
        "job_id", "name", "path", F.col("content").alias("current_code"))


def q_lookup_by_name_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, path) requests - every callee looked up in its caller's file."""
    chunks, edges = _cg(spark, sf_dir)
    callers = chunks.select(F.col("id").alias("caller_id"), F.col("path").alias("req_path"))
    requests = edges.join(callers, "caller_id").select(
        "caller_id", F.col("callee").alias("req_name"), "req_path")
    return index.lookup_by_name_path(chunks, requests, "req_name", "req_path").select(
        "caller_id", "req_name", "req_path", F.col("id").alias("found_id"))


def q_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    return graph.dependencies(chunks, edges)


def q_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    return graph.dependents(chunks, edges)


def q_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    return graph.out_degree(chunks, edges)


def q_context_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    cands = graph.context_candidates(chunks, edges)
    return cands.select("target_id", "cand_id", F.col("dep").cast("int").alias("dep"))


def q_context_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: ranked two-bucket context of every target, one batch plan."""
    chunks, edges = _cg(spark, sf_dir)
    return rank.rank_context(chunks, edges).select(
        "target_id", "cand_id", "cand_name", "dep", "rn", "pos")


def q_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    return rank.context_rows(rank.rank_context(chunks, edges), chunks)


def q_context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    rows = rank.context_rows(rank.rank_context(chunks, edges), chunks)
    return rank.context_strings(rows)


def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    rows = rank.context_rows(rank.rank_context(chunks, edges), chunks)
    return rank.prompts(rank.undocumented_targets(chunks), rank.context_strings(rows))


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense surrogate ids in (path, line_number, name) order."""
    chunks = views.cg_chunks(spark, sf_dir).select("name", "path", "line_number")
    return index.dense_ids(chunks, ["path", "line_number", "name"], "new_id").select(
        "name", "new_id")


def q_chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + A4: full scan of the chunk table, counted by type."""
    return index.value_counts(views.cg_chunks(spark, sf_dir), "type")


def q_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = _cg(spark, sf_dir)
    return index.index_stats(chunks, edges)


def q_calls_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8 + H9: call lists stored as JSON text and read back."""
    chunks = views.cg_chunks(spark, sf_dir, with_calls=True)
    stored = chunks.select("id", tx.calls_to_json("calls").alias("calls_json"))
    parsed = tx.json_to_calls("calls_json")
    return stored.select("id", "calls_json",
                         F.size(parsed).cast("long").alias("n_calls"),
                         F.array_join(parsed, ",").alias("calls_text"))


def q_mark_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: after a full pass every target carries the done marker; others keep theirs."""
    chunks = views.cg_chunks(spark, sf_dir)
    finished = rank.undocumented_targets(chunks).select(F.col("id"))
    return index.mark_done(chunks, finished).select("id", "docstring")


def q_retrieve_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3/J4/J7 by (name, path): every chunk asked for, and as many misses (a wrong path)."""
    c = views.cg_chunks(spark, sf_dir)
    asked = c.select("name", "path").unionByName(
        c.select("name", F.concat(F.lit("no/"), F.col("path")).alias("path")))
    return rank.retrieve_by_name(c, views.cg_edges(spark, sf_dir), asked)


QUERIES = {
    "retrieve_by_name": q_retrieve_by_name,
    "target_queue": q_target_queue,
    "edge_build": q_edge_build,
    "undocumented": q_undocumented,
    "lookup_by_id": q_lookup_by_id,
    "lookup_by_name_path": q_lookup_by_name_path,
    "dependencies": q_dependencies,
    "dependents": q_dependents,
    "out_degree": q_out_degree,
    "context_union": q_context_union,
    "context_rank": q_context_rank,
    "context_rows": q_context_rows,
    "context_string": q_context_string,
    "prompts": q_prompts,
    "chunk_ids": q_chunk_ids,
    "chunk_types": q_chunk_types,
    "index_stats": q_index_stats,
    "calls_json": q_calls_json,
    "mark_done": q_mark_done,
}
