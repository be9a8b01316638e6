"""Queries over a stored index: versions, get-or-create, lookups of few chunks, adjacency.

Each builds its index in a fresh folder of the session's checkpoint folder, as a job of its own
would have, and then reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.operators import rank
from chunkgraph.plans import views
from chunkgraph.plans.corpus import sc_files
from chunkgraph.plans.index_store import IndexStore
from chunkgraph.session import ensure_checkpoint_dir

#: How many of the most called names ``retrieve_stored`` asks for.
TOP_CALLED = 20


def fresh_store(spark: SparkSession) -> IndexStore:
    return IndexStore(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex[:12]}")


def _never() -> DataFrame:
    raise AssertionError("a whole index must not be built again")


def q_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S7 + S8: the index stored, a second build that must not even start, read back."""
    idx = fresh_store(spark)
    idx.build_once(sc_files(spark, sf_dir))
    idx.build_once(_never)
    degree = idx.edges().groupBy(F.col("caller_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return idx.chunks().join(degree, "id", "left").select(
        "id", "name", "path", F.coalesce("n", F.lit(0)).alias("n_edges"))


def q_upsert_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + W2 + S10: the corpus added in two batches, the second with the test files and with
    copies of all files of the first, whose names are stored already."""
    files = sc_files(spark, sf_dir)
    sources = files.where(~F.col("path").startswith("tests/"))
    copies = sources.select(F.concat(F.lit("copy/"), "path").alias("path"), "content")
    idx = fresh_store(spark)
    _, first = idx.upsert(sources)
    _, second = idx.upsert(files.where(F.col("path").startswith("tests/")).unionByName(copies))
    return first.unionByName(second).select(
        "path", F.col("chunk_no").cast("long").alias("chunk_no"), "name", "id",
        F.col("created").cast("int").alias("created"))


def _graph_store(spark: SparkSession, sf_dir: str) -> IndexStore:
    idx = fresh_store(spark)
    idx.publish(views.cg_chunks(spark, sf_dir), views.cg_edges(spark, sf_dir))
    return idx


def q_dependencies_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 read from the stored adjacency."""
    return _graph_store(spark, sf_dir).dependencies()


def q_dependents_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 read from the stored adjacency."""
    return _graph_store(spark, sf_dir).dependents()


def q_retrieve_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + J3 + J4 + J7 for a few targets: the ranked context of the most called chunks, read
    from the files and buckets that hold them."""
    idx = _graph_store(spark, sf_dir)
    top = (idx.edges().groupBy("callee").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "callee").limit(TOP_CALLED))
    cands = idx.context_candidates([r.callee for r in top.collect()])
    return rank.rank_candidates(cands, doc_state="snapshot").select(
        "target_id", "cand_id", "cand_name", "dep", "rn", "pos")


def q_context_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + J7 after a pass over the methods: only what that pass can move is ranked again."""
    chunks, edges = views.cg_chunks(spark, sf_dir), views.cg_edges(spark, sf_dir)
    before = rank.rank_context(chunks, edges, doc_state="snapshot")
    done = rank.undocumented_targets(chunks).where("type = 'method'").select("id")
    return rank.refresh_context(before, chunks, edges, done).select(
        "target_id", "cand_id", "cand_name", "dep", "rn", "pos")


QUERIES = {
    "stored_index": q_stored_index,
    "upsert_index": q_upsert_index,
    "dependencies_stored": q_dependencies_stored,
    "dependents_stored": q_dependents_stored,
    "retrieve_stored": q_retrieve_stored,
    "context_refresh": q_context_refresh,
}
