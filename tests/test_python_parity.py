"""Whole-table checks at sf0.001 against plain-Python models of the same rules (the Python
regex engine is the one the tool used; the SQL oracles use RE2)."""

from chunkgraph.plans import lines
from tests.conftest import SF_SMALL
from tests.models import block_model, clean_model, indent_model


def test_clean_response_matches_python_on_all_turns(spark):
    raw = lines.wrapped_responses(spark, SF_SMALL)
    got = {(r.conv_id, r.turn): r.docstring
           for r in lines.q_clean_response(spark, SF_SMALL).collect()}
    want = {(r.conv_id, r.turn): clean_model(r.raw) for r in raw.collect()}
    assert len(got) == len(want) > 0 and got == want


def test_format_block_matches_python_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.block for r in lines.q_format_block(spark, SF_SMALL).collect()}
    assert got == {d: block_model(t, " " * (d % 3 * 4)) for d, t in docs.items()}


def test_indentation_matches_the_scan_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = {(d, i): indent_model(" " * (d % 3 * 4) + line) for d, t in docs.items() if t is not None
            for i, line in enumerate(t.replace("\r\n", "\n").replace("\r", "\n").split("\n"), start=1)}
    assert {(r.doc_id, r.ln): r.indent for r in lines.q_line_indent(spark, SF_SMALL).collect()} == want


def _random_texts(seed, alphabet, n, max_len):
    import random
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len))) for _ in range(n)]


def test_cleaning_blocks_indentation_on_random_whitespace(spark):
    from pyspark.sql import functions as F

    from chunkgraph.functions import text as tx
    alphabet = ['"', "'", "`", "a", "P", "y", " ", "\n", "\r", "\t", "\x0b", "\x0c", "\x1c",
                "\x85", "\xa0", " ", "　", "​", "é", "```", '"""', "'''",
                "```python\n", "```Python"]
    vals = _random_texts(7, alphabet, 3000, 25)
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v string")
    rows = (df.select("i", tx.clean_response(F.col("v")).alias("c"),
                      tx.format_block(F.col("v"), F.lit("  ")).alias("b"),
                      tx.indentation(F.col("v")).alias("ind"))
              .orderBy("i").collect())
    for v, r in zip(vals, rows):
        assert r.c == clean_model(v)
        assert r.b == block_model(v, "  ")
        assert r.ind == indent_model(v)
