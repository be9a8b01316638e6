"""Edits over line blocks against the edits of whole files."""

import random

import pytest

from chunkgraph.operators import edit_blocks as eb
from chunkgraph.operators import edits

EDITS = "path string, lo int, hi int, block string, seq int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_random_edits_equal_those_of_whole_files(spark, size):
    rnd = random.Random(size)
    files = [(f"f{i}.py", "\n".join(f"{i}:{j}" for j in range(rnd.randint(1, 40)))) for i in range(12)]
    todo = []
    for path, text in files[:10]:
        n = text.count("\n") + 1
        for k in range(rnd.randint(1, 6)):
            lo = rnd.randint(1, n + 3)
            hi = rnd.choice([None, lo, min(n, lo + rnd.randint(0, 20))]) if lo <= n else None
            todo.append((path, lo, hi, rnd.choice([f"new{k}\n", f"a{k}\nb{k}\n\n", ""]), k))
    f = spark.createDataFrame(files, "path string, content string")
    e = spark.createDataFrame(todo, EDITS)
    want = edits.apply_edits(f, e, ["path"], "content")
    blocks = eb.cut_blocks(f, ["path"], "content", size)
    got = eb.join_blocks(eb.apply_edits_blocked(blocks, e, ["path"], size), ["path"], "content")
    assert rows(got) == rows(want)


def test_blocks_hold_the_lines(spark):
    f = spark.createDataFrame([("a", "1\r\n2\n3\n"), ("b", ""), ("c", None)], "path string, content string")
    cut = eb.cut_blocks(f, ["path"], "content", 2)
    assert rows(cut) == [("a", 0, "1\n2"), ("a", 1, "3\n"), ("b", 0, "")]
    assert rows(eb.join_blocks(cut, ["path"], "content")) == [("a", "1\n2\n3\n"), ("b", "")]


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_bounds_across_blocks(spark, size):
    rnd = random.Random(size)
    pool = ['    """one line"""', '    """open', "    text", '    """', "    '''x", "    end'''", '        """', "def f():", "", '"""',
            '  """ low', "\t'''"]
    files = [(f"f{i}", "\n".join(rnd.choice(pool) for _ in range(rnd.randint(3, 30)))) for i in range(15)]
    reqs = [(p, f"n{i}", rnd.randint(1, t.count("\n") + 2), rnd.choice(["", "    "]))
            for p, t in files for i in range(6)] + [("absent", "n", 1, "")]
    f = spark.createDataFrame(files, "path string, content string")
    r = spark.createDataFrame(reqs, "path string, name string, body_start_line int, func_indent string")
    want = edits.block_bounds(f, r, ["path"], "content")
    got = eb.block_bounds_blocked(eb.cut_blocks(f, ["path"], "content", size), r, ["path"], size)
    key = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert key(got) == key(want) and any(x[-1] for x in key(want))


def test_no_task_holds_a_file(spark):
    """One file of 60,000 lines in blocks: the plan groups by block, never by file alone."""
    f = spark.createDataFrame([("big", "\n".join(f"line {i}" for i in range(60_000)))], "path string, content string")
    e = spark.createDataFrame([("big", 1 + 10 * i, 4 + 10 * i, f"new {i}\n", i) for i in range(6000)], EDITS)
    blocks = eb.cut_blocks(f, ["path"], "content", 500)
    done = eb.apply_edits_blocked(blocks, e, ["path"], 500)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Aggregate [path#" in plan
    out = done.orderBy("block_no").collect()
    assert len(out) == 120
    text = "\n".join(r.text for r in out if r.text is not None).split("\n")
    want = [x for i in range(6000) for x in (f"new {i}", *[f"line {10 * i + j}" for j in range(4, 10)])]
    assert text == want


def test_only_lines_with_quotes_are_looked_at(spark):
    """Blocks and lines without triple quotes go before lines are stripped, and the bounds stay."""
    text = "def f():\n    \'\'\'a\n    b\n     \'\'\' \n" + "    x()\n" * 40 + 'def g():\n    """c\n    d"""\n'
    f = spark.createDataFrame([("a.py", text)], "path string, content string")
    r = spark.createDataFrame([("a.py", 2, ""), ("a.py", 46, ""), ("a.py", 10, "")],
                              "path string, body_start_line int, func_indent string")
    blocks = eb.cut_blocks(f, ["path"], "content", 4)
    found = eb.block_bounds_blocked(blocks, r, ["path"], 4)
    assert rows(found) == rows(edits.block_bounds(f, r, ["path"], "content"))
    assert {x.body_start_line: x.doc_end for x in found.collect()} == {2: 4, 46: 47, 10: None}
    assert "Contains(text" in found._jdf.queryExecution().optimizedPlan().toString()
