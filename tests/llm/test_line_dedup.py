import hashlib

import pytest

from chunkgraph.llm import line_dedup as ld
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def model(docs):
    """{doc_id: (n_lines, n_dropped, kept text)} for unique ids."""
    holders = {}
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


EDGE = ["A shared line here\nown line number one", None, "", "  a SHARED line here\t\nown line two!",
        "short\nshort", "short", "äöüäöüäöü\näöüäöüäöüä", "äöüäöüäöüä\nÄöüäöüäöüä", "a shared line here\r",
        "same old line\nsame old line", "long " * 60000 + "\nsame old line", "\n\n\n", "own line number one"]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_against_the_model(spark, batches, fanout):
    docs = dict(enumerate(EDGE))
    out = ld.dedup_lines(make_docs(spark, EDGE), batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == model(docs)


def test_query_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256)
           for r in ld.op7_line_dedup(spark, SF_SMALL).collect()}
    want = {d: (a, b, hashlib.sha256(t.encode()).hexdigest()) for d, (a, b, t) in model(docs).items()}
    assert got == want


def test_hot_keys_are_resolved_in_the_scan(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT_SHARE", 4)
    texts = [f"the very common line\nown line of document {i}" for i in range(2500)]
    got = {r.doc_id: r.n_dropped for r in ld.dedup_lines(make_docs(spark, texts)).collect()}
    assert got == {i: int(i > 0) for i in range(2500)}


def test_null_ids_repeated_rows_clashes_and_empty_table(spark):
    df = spark.createDataFrame(
        [(None, "the line of them all", 1), (5, "the line of them all", 2),
         (5, "the line of them all", 2), (9, "The line of them all", 3)],
        "doc_id long, text string, n_lines int")
    rows = sorted((r.doc_id or 0, r.n_dropped, r.n_lines) for r in ld.dedup_lines(df).collect())
    assert rows == [(0, 0, 1), (5, 0, 1), (5, 0, 1), (9, 1, 1)]
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_disjoint_and_compact_by_level(spark):
    runs = ld.Runs(spark, 2)
    for i in range(5):
        keys = spark.createDataFrame([(i, 0, i, 1), (99, 0, i, 1)], ld.KEY_SCHEMA)
        marked = ld.against_runs(keys, runs.tables())
        assert {r.h1: r.old for r in marked.collect()} == {i: False, 99: i > 0}
        runs.add(marked.where("NOT old"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [sorted(r.h1 for r in t.collect()) for t in runs.tables()]
    assert held == [[4], [0, 1, 2, 3, 99]]
    names = [n for level in runs.levels for n, _ in level]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_the_runs_decide(spark, monkeypatch):
    """Without the joins with the runs every batch would keep its own first holders."""
    docs = make_docs(spark, [f"the line that all documents share\nown line {i}" for i in range(40)])
    assert sum(r.n_dropped for r in ld.dedup_lines(docs, batches=4).collect()) == 39
    monkeypatch.setattr(ld, "against_runs", lambda keys, runs: keys.selectExpr("*", "false AS old"))
    assert sum(r.n_dropped for r in ld.dedup_lines(docs, batches=4).collect()) == 36


def test_a_failing_batch_leaves_no_tables(spark, monkeypatch):
    calls = []

    def fails(part, runs, min_chars, last, real=ld._batch_drops):
        if calls:
            raise OSError("lost")
        calls.append(runs)
        return real(part, runs, min_chars, last)

    monkeypatch.setattr(ld, "_batch_drops", fails)
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(OSError):
        ld.dedup_lines(make_docs(spark, [f"a line of document {i}" for i in range(40)]))
    assert calls and calls[0].levels == []
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_any_column_name_may_be_there(spark):
    df = spark.createDataFrame([(1, "the line of them all", "a", 2, 3, "x", "y"), (2, "the line of them all", "b", 4, 5, "x", "y")],
                               "doc_id long, text string, row string, _a int, _ld_id int, salt string, id string")
    out = ld.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (1, "the line of them all", "a", 2, 3, "x", "y", 1, 0), (2, "", "b", 4, 5, "x", "y", 1, 1)]
