"""The stored index: versions, build once, get-or-create, lookups of few chunks, adjacency."""

import os
import re

import pytest

from chunkgraph.operators import extract, graph, rank
from chunkgraph.plans import index_store
from chunkgraph.plans.index_store import IndexStore, Manifest, VersionConflict
from chunkgraph.plans.stored import _graph_store, fresh_store
from tests.conftest import SF_SMALL

FILES = "path string, content string"


def module(*names):
    return "".join(f"def {n}():\n    {c}()\n\n" for n, c in names)


@pytest.fixture
def idx(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), buckets=4)


def files(spark, **sources):
    return spark.createDataFrame([(f"{p}.py", s) for p, s in sources.items()], FILES)


def names(df):
    return {r.id: r.name for r in df.select("id", "name").collect()}


def test_build_once_reads_the_manifest_before_anything_is_extracted(spark, idx, monkeypatch):
    idx.build_once(files(spark, a=module(("one", "two"), ("two", "one"))))
    monkeypatch.setattr(extract, "extract_chunks", lambda *a, **k: pytest.fail("extracted again"))

    def never():
        raise AssertionError("the files were asked for")

    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("guard", "build_once")
    m = idx.build_once(never)
    assert m.version == 1 and len(jobs("guard")) == 0
    spark.sparkContext.setJobGroup("other", "")
    assert names(idx.chunks()) == {1: "one", 2: "two"}


def test_an_empty_index_is_built(spark, idx):
    assert idx.build_once(files(spark, a="x = 1\n")).rows == 0
    assert idx.build_once(lambda: files(spark, a=module(("one", "two")))).rows == 1


def test_a_build_that_dies_leaves_the_version_before(spark, idx, monkeypatch):
    idx.build_once(files(spark, a=module(("one", "two"))))
    real = IndexStore._write_bucketed

    def dies(self, df, part, what):
        if what == "by_callee":
            raise OSError("executor lost for good")
        real(self, df, part, what)

    monkeypatch.setattr(IndexStore, "_write_bucketed", dies)
    new = spark.createDataFrame([(1, "z.py", "zed", "function", "z")],
                                "id long, path string, name string, type string, content string")
    with pytest.raises(OSError):
        idx.publish(new, spark.createDataFrame([], "caller_id long, callee string"))
    monkeypatch.undo()
    assert names(idx.chunks()) == {1: "one"} and idx.edges().count() == 1
    assert len(idx.vacuum()) == 1  # the folder of the dead build
    idx.publish(new, spark.createDataFrame([(1, "zed")], "caller_id long, callee string"))
    assert names(idx.chunks()) == {1: "zed"} and idx.manifest().version == 2
    assert names(idx.chunks(idx.manifest(1))) == {1: "one"}  # until it is vacuumed
    idx.vacuum()
    assert idx.manifest(1) is None and names(idx.chunks()) == {1: "zed"}


def test_two_writers_cannot_commit_one_version(spark, idx):
    idx.build_once(files(spark, a=module(("one", "two"))))
    with pytest.raises(VersionConflict):
        idx._commit(Manifest(1, 4))
    assert names(idx.chunks()) == {1: "one"}


def test_upsert_is_get_or_create(spark, idx):
    m, out = idx.upsert(files(spark, a=module(("f", "g"), ("g", "h")), b=module(("f", "x"))))
    got = {(r.path, r.name): (r.id, r.created) for r in out.collect()}
    assert got == {("a.py", "f"): (1, True), ("a.py", "g"): (2, True), ("b.py", "f"): (1, False)}
    m, out = idx.upsert(files(spark, c=module(("g", "new"), ("h", "f")), d=module(("h", "y"), ("k", "k"))))
    got = {(r.path, r.name): (r.id, r.created) for r in out.collect()}
    assert got == {("c.py", "g"): (2, False), ("c.py", "h"): (3, True), ("d.py", "h"): (3, False),
                   ("d.py", "k"): (4, True)}
    assert (m.version, m.last_id, m.rows) == (2, 4, 4)
    # a stored definition keeps its row and its edges; new ones resolve the older edges' names
    assert {(r.caller_id, r.callee) for r in idx.edges().collect()} == {(1, "g"), (2, "h"), (3, "f"), (4, "k")}
    assert {(r.chunk_id, r.dep_id) for r in idx.dependencies().collect()} == {(1, 2), (2, 3), (3, 1), (4, 4)}
    again, out = idx.upsert(files(spark, c=module(("g", "new"))))
    assert again.rows == 4 and [(r.id, r.created) for r in out.collect()] == [(2, False)]


def test_many_batches_are_merged(spark, idx, monkeypatch):
    monkeypatch.setattr(index_store, "MAX_PARTS", 2)
    for i in range(4):
        m, _ = idx.upsert(files(spark, **{f"m{i}": module((f"f{i}", "f0"), ("shared", "f1"))}))
    assert len(m.parts) <= 2 and m.rows == 5 and m.last_id == 5
    assert names(idx.chunks()) == {1: "f0", 2: "shared", 3: "f1", 4: "f2", 5: "f3"}
    users = {(r.chunk_id, r.user_name) for r in idx.dependents().collect()}
    assert users == {(1, "f0"), (1, "f1"), (1, "f2"), (1, "f3"), (3, "shared")}


def test_lookups_of_few_chunks_read_few_files(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), buckets=16)
    n = 20_000
    chunks = spark.range(1, n + 1).selectExpr(
        "id", "concat('p', id % 7, '.py') path", "printf('n%06d', id) name", "'function' type", "repeat('x', 200) content")
    edges = spark.range(1, n + 1).selectExpr("id caller_id", "printf('n%06d', (id * 7) % 1000 + 1) callee")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files of a small table
    store.publish(chunks, edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    whole = len(store.chunks().inputFiles())
    few = store.chunks_named(["n000005", "n000006", "missing"])
    assert whole >= 8 and len(few.inputFiles()) <= 2
    assert names(few) == {5: "n000005", 6: "n000006"}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    plan = store._matching("by_callee", "callee", ["n000005"], store.manifest())._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan)
    assert names(store.chunks_with_ids([77, 19_999])) == {77: "n000077", 19999: "n019999"}
    with pytest.raises(KeyError, match="no chunk with id 20001"):
        store.chunks_with_ids([1, 20_001])
    part = f"{store.base}/parts/{store.manifest().parts[0].name}"
    assert len([f for f in os.listdir(f"{part}/by_caller") if f.endswith(".parquet")]) <= 16  # one file a bucket


def test_few_targets_rank_as_in_the_whole_graph(spark):
    store = _graph_store(spark, SF_SMALL)
    chunks, edges = store.chunks(), store.edges()
    some = chunks.orderBy("name").limit(7)
    want = graph.context_candidates(chunks, edges, some)
    got = store.context_candidates([r.name for r in some.collect()])
    key = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert key(got) == key(want) and len(key(got)) > 0
    assert store.context_candidates(["nobody"]).count() == 0


@pytest.mark.parametrize("which", ["dependencies", "dependents"])
def test_stored_adjacency_moves_no_edges(spark, which):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(_graph_store(spark, SF_SMALL), which)()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_refresh_equals_a_full_ranking(spark):
    from chunkgraph.operators.index import mark_done
    store = _graph_store(spark, SF_SMALL)
    chunks, edges = store.chunks(), store.edges()
    before = rank.rank_context(chunks, edges, doc_state="snapshot")
    done = rank.undocumented_targets(chunks).where("id % 4 = 1").select("id")
    got = rank.refresh_context(before, chunks, edges, done.unionByName(done))
    want = rank.rank_context(mark_done(chunks, done), edges, doc_state="snapshot")
    key = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert key(got) == key(want)
    nothing = rank.refresh_context(before, chunks, edges, done.limit(0))
    assert key(nothing) == key(before)


def test_missing_index(spark):
    with pytest.raises(FileNotFoundError):
        fresh_store(spark).chunks()


def test_edges_meet_their_callers_in_the_buckets(spark, idx):
    """The stored edges and ids are not moved to be joined: only the write deals them anew."""
    m = idx.build_once(files(spark, a=module(("one", "two"), ("two", "one"), ("three", "two"))))
    joined = idx._with_callers(m.parts[0])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    want = {(1, "two", "one", "a.py", "function"), (2, "one", "two", "a.py", "function"),
            (3, "two", "three", "a.py", "function")}
    columns = [f.name for f in index_store.CALLERS]
    by_id = {r.name: r.id for r in idx.chunks().collect()}
    got = {tuple(r) for r in joined.select("caller_id", "callee", *columns[2:]).collect()}
    assert got == {(by_id[n], c, n, p, t) for _, c, n, p, t in want}
    assert {tuple(r) for r in idx._read("by_callee", index_store.CALLERS, m.parts).select(*joined.columns).collect()} == {
        tuple(r) for r in joined.collect()}
