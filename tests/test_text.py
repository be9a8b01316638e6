"""Column text functions (H1-H11) against plain-Python models of the same rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkgraph.functions import text as tx


# Answer -> docstring, worked out by hand.
CLEANED = [
    ('"""Gives the total."""', "Gives the total."),
    ('Sure:\n```python\n"""Joins two parts.\n\nArgs:\n    a: left\n"""\n```', "Joins two parts.\n\nArgs:\n    a: left"),
    ("```PYTHON\nCounts items.\n```", "Counts items."),
    ("'''in single quotes''' and more", "in single quotes"),
    ("   only blanks around   ", "only blanks around"),
    ('""""starts with four', 'starts with four'),
    ('"""never closed', "never closed"),
    ("  a line separator \x1c", "a line separator"),
    ("", ""),
    ("'''first''' then \"\"\"second\"\"\"", "first"),
    ("```\nno language\n```", "no language"),
    ("\"'both'\"", "both"),
    ('"""mixed ends\'\'\'', "mixed ends"),
    ("a ``` b", "a  b"),
    ("\"\"", ""),
    ("keep \"inner\" quotes", "keep \"inner\" quotes"),
]

# Docstring, indent -> block, worked out by hand.
BLOCKS = [
    ("One line.", "", '    """\n    One line.\n    """\n\n'),
    ("One line.", "  ", '      """\n      One line.\n      """\n\n'),
    ("First.\n\n  Deeper.", "", '    """\n    First.\n    \n      Deeper.\n    """\n\n'),
    ("", "", '    """\n    \n    """\n\n'),
    ("end\n \t", "", '    """\n    end\n    \n    """\n\n'),
]


def run_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_response(spark):
    assert run_col(spark, [a for a, _ in CLEANED], tx.clean_response) == [b for _, b in CLEANED]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab\"'` \n\tpythonPY\u3000", max_size=30), min_size=1, max_size=8))
def test_cleaned_text_has_no_fence_and_no_quotes_at_its_ends(spark, values):
    for out in run_col(spark, values, tx.clean_response):
        assert "```" not in out and not out.startswith("'") and not out.endswith("'")


def test_format_block(spark):
    for doc, indent, block in BLOCKS:
        assert run_col(spark, [doc], lambda c: tx.format_block(c, F.lit(indent))) == [block]


def test_indentation_and_strip(spark):
    lines = ["    x = 1", "\t\ty", "none", "", "　 z "]
    assert run_col(spark, lines, tx.indentation) == [re.match(r"^(\s*)", s).group(1) for s in lines]
    assert run_col(spark, lines, tx.py_strip) == [s.strip() for s in lines]


def test_split_keeps_trailing_empty(spark):
    assert run_col(spark, ["a\nb\n"], tx.split_lines) == [["a", "b", ""]]


def test_json_roundtrip(spark):
    df = spark.createDataFrame([(["a", "b.c"],), ([],)], "calls array<string>")
    out = df.select(tx.json_to_calls(tx.calls_to_json("calls")).alias("c")).collect()
    assert [r.c for r in out] == [["a", "b.c"], []]


def test_headers_and_prompt(spark):
    df = spark.createDataFrame([("p.py", "code"), (None, "x")], "path string, content string")
    heads = [r.h for r in df.select(tx.source_header("path", "content").alias("h")).collect()]
    assert heads == ["--- Source: p.py ---\ncode", "--- Source: unknown ---\nx"]
    p = df.select(tx.prompt_text(F.lit("CTX"), F.col("content")).alias("p")).first().p
    assert p == "### Context from Codebase:\nCTX\n\n### Target Code:\ncode"
