"""Corpus sources (S1/S4/P6) and evaluation-set reading/writing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chunkgraph.operators import evalset
from chunkgraph.sources import corpus


def write(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_directory_scan_prunes_and_keeps_underscore_files(spark, tmpdir_path):
    root = tmpdir_path
    write(root, "pkg/__init__.py", "")
    write(root, "pkg/_private.py", "def p():\n    pass\n")
    write(root, "pkg/mod.py", "def m():\r\n    pass\r\n")
    write(root, "venv/lib/site.py", "x = 1\n")
    write(root, "a/venv/deep.py", "x = 1\n")
    write(root, ".git/hook.py", "x = 1\n")
    write(root, "pkg/.hidden.py", "x = 1\n")
    write(root, "pkg/notes.txt", "hello\n")
    write(root, "venv2/kept.py", "y = 2\n")
    files = corpus.scan_directory(spark, root)
    got = {r.path: r.content for r in files.collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/_private.py", "pkg/mod.py", "venv2/kept.py"}
    assert got["pkg/mod.py"] == "def m():\n    pass\n"  # universal newlines


def test_path_predicate_matches_walk_rules(spark):
    paths = ["a.py", "x/y/b.py", ".c.py", "x/.d.py", ".git/e.py", "x/venv/f.py", "venv/g.py",
             "venvx/h.py", "x/_i.py", "j.pyc", "k.py.txt", "x/.cache/y/l.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r.path for r in corpus.filter_sources(df).collect()}
    assert kept == {"a.py", "x/y/b.py", "venvx/h.py", "x/_i.py"}


def test_corpus_shape(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "library int, source_code string")
    r = corpus.corpus_shape(df).first()
    assert (r.n_rows, r.n_cols, r.columns) == (2, 2, "library,source_code")


def test_json_array_reader_and_limit(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "test_dataset.json")
    data = [{"source_code": f"def f{i}(): pass", "docstring": f"Doc {i}"} for i in range(7)]
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(data, fh, indent=2)
    all_rows = evalset.load_eval_set(spark, path)
    assert all_rows.count() == 7
    first3 = [r.source_code for r in evalset.load_eval_set(spark, path, num_samples=3).collect()]
    assert first3 == ["def f0(): pass", "def f1(): pass", "def f2(): pass"]


def test_json_reader_missing_path_fails(spark, tmpdir_path):
    with pytest.raises(Exception):
        evalset.load_eval_set(spark, os.path.join(tmpdir_path, "absent.json")).count()


def test_sample_write_roundtrip(spark, tmpdir_path):
    corpus_df = spark.range(0, 120).select(
        F.col("id").alias("k"),
        F.concat(F.lit("code "), F.col("id").cast("string")).alias("source_code"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit("doc")).alias("docstring"))
    sample = evalset.sample_eval_set(corpus_df, ["k"], sample_size=50)
    assert sample.count() == 50 - 8  # ids 0,7,...,49 lack a docstring
    out = os.path.join(tmpdir_path, "eval_out")
    evalset.write_eval_set(sample, out, order=["k"])
    back = evalset.load_eval_set(spark, out, schema="source_code string, docstring string")
    assert back.count() == 42
    assert back.first().source_code == "code 1"


def test_eval_rows_pairs_and_defaults(spark):
    samples = spark.createDataFrame([(1, "q1", "t1"), (2, "q2", "t2")],
                                    "k long, source_code string, docstring string")
    preds = spark.createDataFrame([(1, "a1", ["c1", "c2"])],
                                  "k long, answer string, contexts array<string>")
    rows = {r.k: r for r in evalset.eval_rows(samples, preds, "k").collect()}
    assert (rows[1].question, rows[1].answer, rows[1].contexts, rows[1].ground_truth) == (
        "q1", "a1", ["c1", "c2"], "t1")
    assert rows[2].answer is None and rows[2].contexts == []


def test_top_contexts_bounded(spark):
    turns = spark.range(0, 500).select((F.col("id") % 2).alias("conv"), F.col("id").alias("turn"),
                                       F.col("id").cast("string").alias("text"))
    got = {r.conv: r.contexts for r in evalset.top_contexts(turns, "conv", "turn", "text", 10).collect()}
    assert got[0] == [str(i) for i in range(0, 20, 2)]
    assert len(got[1]) == 10


def test_write_directory_roundtrip(spark, tmpdir_path):
    files = spark.createDataFrame([("pkg/__init__.py", ""), ("pkg/a.py", "def a():\n    pass\n"),
                                   ("b.py", 'def b():\n    """Doc."""\n')],
                                  "path string, content string")
    out = os.path.join(tmpdir_path, "out")
    corpus.write_directory(files, out)
    back = {r.path: r.content for r in corpus.scan_directory(spark, out).collect()}
    assert back == {r.path: r.content for r in files.collect()}
    bad = spark.createDataFrame([("../x.py", "x")], "path string, content string")
    with pytest.raises(Exception):
        corpus.write_directory(bad, out)


def test_files_of_a_tree_are_renamed_inside_their_folder(tmpdir_path, monkeypatch):
    """A rename between folders waits for all others of the filesystem."""
    from chunkgraph.sources import tree
    moves, made = [], []
    replace, makedirs = os.replace, os.makedirs
    monkeypatch.setattr(os, "replace", lambda a, b: (moves.append((a, b)), replace(a, b)))
    writer = tree.TreeWriter({"path": os.path.join(tmpdir_path, "out")}, overwrite=False)
    monkeypatch.setattr(os, "makedirs", lambda p, **kw: (made.append(p), makedirs(p, **kw)))
    names = ["a.py", "pkg/b.py", "pkg/c.py", "pkg/deep/d.py", "pkg/b.py"]
    writer.write(iter([{"path": p, "content": p} for p in names]))
    writer.commit([])
    assert len(moves) == 5 and all(os.path.dirname(a) == os.path.dirname(b) for a, b in moves)
    assert len(made) == len(set(made)) <= 5  # makedirs calls itself for missing parents
    found = sorted(os.path.relpath(os.path.join(d, f), writer.root) for d, _, fs in os.walk(writer.root) for f in fs)
    assert found == sorted(set(names))


def test_directory_scan_walks_subtrees_on_executors(spark, tmpdir_path):
    root = tmpdir_path
    expected = set()
    for a in range(3):
        for b in range(4):
            rel = f"pkg{a}/sub{b}/deep/m{a}{b}.py"
            write(root, rel, f"def f{a}{b}():\n    pass\n")
            expected.add(rel)
            write(root, f"pkg{a}/sub{b}/venv/skip.py", "x = 1\n")
            write(root, f"pkg{a}/sub{b}/deep/.hidden/skip.py", "x = 1\n")
            write(root, f"pkg{a}/sub{b}/deep/_u.py", "")
            expected.add(f"pkg{a}/sub{b}/deep/_u.py")
    write(root, "top.py", "")
    expected.add("top.py")
    for limit in (1, 4, 9, 1000):
        scan = corpus.scan_directory(spark, root, partition_bytes=3000, list_limit=limit)
        assert {r.path for r in scan.collect()} == expected
        assert scan.rdd.getNumPartitions() > 1 or limit == 1  # the whole tree is one folder to walk


def test_a_job_that_fails_leaves_no_tree(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    rows = [(f"pkg/m{i}.py", "x = 1\n") for i in range(40)] + [("../escape.py", "x")]
    bad = spark.createDataFrame(rows, "path string, content string").repartition(4)
    with pytest.raises(Exception, match="leaves the tree"):
        corpus.write_directory(bad, out)
    assert os.listdir(tmpdir_path) == []
    corpus.write_directory(bad.where("path LIKE 'pkg/%'"), out)
    assert len(os.listdir(os.path.join(out, "pkg"))) == 40 and os.listdir(tmpdir_path) == ["out"]
    with pytest.raises(Exception, match="exists"):  # never over another tree
        corpus.write_directory(bad, out)


def test_scan_of_a_missing_or_empty_folder(spark, tmpdir_path):
    with pytest.raises(Exception, match="no folder"):
        corpus.scan_directory(spark, os.path.join(tmpdir_path, "absent")).collect()
    assert corpus.scan_directory(spark, tmpdir_path).count() == 0


@pytest.mark.parametrize("indent", [None, 0, 4])
@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_arrays_of_any_layout_are_split(spark, tmpdir_path, indent, chunk):
    data = [{"k": i, "source_code": t, "docstring": None if i % 3 == 0 else {"a": ["]", "}", i]}["a"][0] * i}
            for i, t in enumerate(['plain', 'quote " and \\', '{"k": 1}, {', "[[}\n", "é\u2028\\\"", "", "\\" * 5, "x" * 300])]
    path = os.path.join(tmpdir_path, "set.json")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(data, fh, indent=indent, ensure_ascii=bool(indent))
    back = evalset.read_array(spark, path, "k int, source_code string, docstring string", chunk)
    assert [r.asDict() for r in back.orderBy("k").collect()] == data
    if chunk == 7:
        assert back.rdd.getNumPartitions() > 3


def test_array_written_in_parts_is_one_array(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "arr")
    df = spark.range(0, 500).select(F.col("id").alias("k"), F.concat(F.lit('a "\n} '), "id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    evalset.write_array(df.where("k % 7 < 5").repartition(9), out, ["k", "v"], ["k"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in parts)
    want = [{"k": i, "v": f'a "\n}} {i}'} for i in range(500) if i % 7 < 5]
    assert json.loads(text) == want and len(parts) > 1
    back = evalset.read_array(spark, out, "k long, v string", 256)
    assert [r.asDict() for r in back.orderBy("k").collect()] == want
    evalset.write_array(df.limit(0), out + "-empty", ["k", "v"], ["k"])
    assert evalset.read_array(spark, out + "-empty", "k long, v string").count() == 0
