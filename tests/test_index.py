"""First-wins dedup (A1/A1b), dense ids (W2), lookups, counts, done marking."""

import pytest

from pyspark.sql import functions as F

from chunkgraph.operators import index


def test_first_wins_keeps_first_in_order(spark):
    df = spark.createDataFrame([("f", "b.py", 0, "second"), ("f", "a.py", 1, "first"),
                                ("g", "a.py", 2, "only"), (None, "c.py", 0, "null key")],
                               "name string, path string, chunk_no int, content string")
    got = {r.name: (r.path, r.content) for r in index.first_wins(df, ["name"], ["path", "chunk_no"]).collect()}
    assert got == {"f": ("a.py", "first"), "g": ("a.py", "only"), None: ("c.py", "null key")}


def test_first_wins_flags(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)],
                               "doc_id long, text string")
    got = {r.doc_id: r.is_new for r in index.first_wins_flags(df, ["text"], ["doc_id"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_hot_key_first_wins(spark):
    # a third of the rows share one key
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id"))
    out = index.first_wins(df, ["k"], ["id"])
    assert out.count() == 2001
    assert out.where("k = 'hot'").first().id == 0


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(13)
    out = index.dense_ids(df, ["v"], "rid", num_partitions=9).collect()
    pairs = sorted((r.v, r.rid) for r in out)
    assert [rid for _, rid in pairs] == list(range(1, 5001))


def test_lookups(spark):
    chunks = spark.createDataFrame([(1, "f", "a.py"), (2, "g", "b.py")],
                                   "id long, name string, path string")
    reqs = spark.createDataFrame([("f", "a.py"), ("g", "a.py")], "n string, p string")
    got = {(r.n, r.p): r.id for r in index.lookup_by_name_path(chunks, reqs, "n", "p").collect()}
    assert got == {("f", "a.py"): 1, ("g", "a.py"): None}
    assert index.missing_lookups(chunks, reqs, "n", "p").count() == 1
    keys = spark.createDataFrame([(2,), (3,)], "job long")
    assert [r.name for r in index.lookup_by_id(chunks, keys, "job", "drop").collect()] == ["g"]
    assert [r.name for r in index.lookup_by_id(chunks, keys.where("job = 2"), "job").collect()] == ["g"]
    with pytest.raises(Exception, match="no chunk with id 3"):
        index.lookup_by_id(chunks, keys, "job").collect()


def test_value_counts_and_stats(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "lib string")
    assert [(r.lib, r.n) for r in index.value_counts(df, "lib").collect()] == [("a", 2), ("b", 1)]
    chunks = spark.createDataFrame([(1, "p", None), (2, "p", "d"), (3, "q", None)],
                                   "id long, path string, docstring string")
    edges = spark.createDataFrame([(1, "x")], "caller_id long, callee string")
    stats = {r.stat: r.value for r in index.index_stats(chunks, edges).collect()}
    assert stats == {"chunks": 3, "undocumented": 2, "paths": 2, "edges": 1}


def test_mark_done(spark):
    chunks = spark.createDataFrame([(1, None), (2, "kept"), (3, None)], "id long, docstring string")
    done = spark.createDataFrame([(1,), (1,)], "id long")
    got = {r.id: r.docstring for r in index.mark_done(chunks, done).collect()}
    assert got == {1: "DONE", 2: "kept", 3: None}


def test_save_index_is_build_once(spark, tmpdir_path):
    from chunkgraph.plans.index_build import build_index, load_index, save_index
    first = spark.createDataFrame([("m.py", "def a():\n    b()\n\ndef b():\n    pass\n")],
                                  "path string, content string")
    save_index(build_index(first), tmpdir_path)
    second = spark.createDataFrame([("n.py", "def z():\n    pass\n")], "path string, content string")
    save_index(build_index(second), tmpdir_path)  # ignored: the index exists
    chunks, edges = load_index(spark, tmpdir_path)
    assert sorted(r.name for r in chunks.collect()) == ["a", "b"]
    assert [(r.caller_id, r.callee) for r in edges.collect()] == [(1, "b")]
    save_index(build_index(second), tmpdir_path, mode="overwrite")
    assert [r.name for r in load_index(spark, tmpdir_path)[0].collect()] == ["z"]


def test_directory_to_index(spark, tmpdir_path):
    import os
    from chunkgraph.plans.index_build import build_index
    from chunkgraph.sources.corpus import scan_directory
    os.makedirs(os.path.join(tmpdir_path, "pkg"))
    with open(os.path.join(tmpdir_path, "pkg", "__init__.py"), "w") as fh:
        fh.write("from pkg.util import helper as h\n\ndef main():\n    h()\n    run()\n")
    with open(os.path.join(tmpdir_path, "pkg", "util.py"), "w") as fh:
        fh.write("def helper():\n    pass\n\ndef run():\n    helper()\n")
    with open(os.path.join(tmpdir_path, "broken.py"), "w") as fh:
        fh.write("def oops(:\n")
    idx = build_index(scan_directory(spark, tmpdir_path))
    ids = {r.name: r.id for r in idx.chunks.collect()}
    assert set(ids) == {"main", "helper", "run"}
    assert {(r.caller_id, r.callee) for r in idx.edges.collect()} == {
        (ids["main"], "pkg.util.helper"), (ids["main"], "run"), (ids["run"], "helper")}
    assert [r.path for r in idx.rejects.collect()] == ["broken.py"]


def test_first_wins_whole_row_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in index.first_wins(df, ["k", "v"], ["v"]).collect()) == [("a", 1), ("b", 2)]
