"""Call-graph joins and context retrieval on a small graph with a cycle and a self-call."""

from pyspark.sql import functions as F

from chunkgraph.functions import text as tx
from chunkgraph.operators import graph, rank
from chunkgraph.schemas import CHUNKS
from tests.conftest import chunk_row


def names_by(df, key, val):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[val])
    return out


def test_edges_are_the_call_lists_taken_apart(mill):
    edges = {(r.caller_id, r.callee) for r in graph.build_edges(mill).collect()}
    assert edges == {(11, "knead"), (12, "rise"), (13, "knead"), (13, "rise"), (13, "wait")}


def test_call_lists_as_json(mill):
    got = {r.name: r.j for r in mill.select("name", tx.calls_to_json("calls").alias("j")).collect()}
    assert got == {"serve": '["knead"]', "knead": '["rise"]', "rise": '["knead","rise","wait"]', "sweep": "[]"}


def test_callees_and_callers_with_a_cycle_and_a_self_call(mill):
    edges = graph.build_edges(mill)
    assert names_by(graph.dependencies(mill, edges), "chunk_id", "dep_name") == {
        11: {"knead"}, 12: {"rise"}, 13: {"knead", "rise"}}
    assert names_by(graph.dependents(mill, edges), "chunk_id", "user_name") == {
        12: {"serve", "rise"}, 13: {"knead", "rise"}}


def test_context_of_every_chunk(mill):
    ranked = rank.rank_context(mill, graph.build_edges(mill), targets=mill)
    assert names_by(ranked, "target_id", "cand_name") == {
        11: {"knead"}, 12: {"rise", "serve"}, 13: {"knead", "rise"}}
    rows = rank.context_rows(ranked, mill).where("target_id = 12").collect()
    # rise is called by knead and calls it: one row, among the callees, after the callers
    assert [r.name for r in sorted(rows, key=lambda r: r.pos)] == ["serve", "rise"]
    assert all(r.content for r in rows)


def test_a_target_that_is_no_chunk_has_no_context(spark, mill):
    nobody = spark.createDataFrame([(77, "nobody", "mill/none.py")], "id long, name string, path string")
    assert rank.rank_context(mill, graph.build_edges(mill), targets=nobody).count() == 0


def test_out_degree_keeps_chunks_without_edges(mill):
    got = {r.name: (r.n_calls, r.n_resolved) for r in graph.out_degree(mill, graph.build_edges(mill)).collect()}
    assert got == {"serve": (1, 1), "knead": (1, 1), "rise": (3, 2), "sweep": (0, 0)}


def test_exact_name_match_only(spark):
    rows = [chunk_row(1, "f", "m.py", "function", "f", calls=["self.g", "m.g"]),
            chunk_row(2, "g", "m.py", "function", "g")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    deps = graph.dependencies(chunks, graph.build_edges(chunks))
    assert deps.count() == 0
    assert graph.build_edges(chunks).where(F.col("callee") == "self.g").count() == 1
