"""Size splitting (X4) and fixed windows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkgraph.operators import split

def module_text(n):
    """A module of ``n`` functions whose bodies grow."""
    return "".join(f"\ndef step_{i}(x):\n" + "".join(f"    x = combine(x, {i}, {j})\n" for j in range(i % 7 + 1))
                   + "    return x\n" for i in range(n))


def test_every_piece_carries_the_row_and_no_line_is_lost(spark):
    text = module_text(60)
    df = spark.createDataFrame([(7, "steps", text), (8, "none", "")], "id long, tag string, content string")
    pieces = split.split_pieces(df, "content", 300, 0).orderBy("piece_no").collect()
    assert [p.piece_no for p in pieces] == list(range(len(pieces))) and len(pieces) > 10
    assert {(p.id, p.tag) for p in pieces} == {(7, "steps")}
    assert max(len(p.content) for p in pieces) <= 300
    held = [line.strip() for p in pieces for line in p.content.split("\n") if line.strip()]
    assert held == [line.strip() for line in text.split("\n") if line.strip()]


def pieces_of(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in split.split_levels(df, "t", "p", size, overlap).orderBy("i").collect()]


def test_short_blank_and_null_texts(spark):
    got = pieces_of(spark, ["def f():\n    pass\n", "", " \n", None, "word"], 2000, 200)
    assert got == [["def f():\n    pass"], [], [], None, ["word"]]


def test_pieces_respect_size_and_prefer_def_breaks(spark):
    text = "\n".join(f"def f{i}():\n    return {i}" for i in range(50))
    pieces, = pieces_of(spark, [text], 120, 20)
    assert all(len(p) <= 120 and p.startswith("def ") for p in pieces)


def test_pieces_by_hand(spark):
    # cut before each space; the last word of a full piece fits the overlap and opens the next
    assert pieces_of(spark, ["aa bb cc dd ee"], 9, 3) == [["aa bb cc", "cc dd ee"]]
    assert pieces_of(spark, ["aa bb cc dd ee"], 9, 0) == [["aa bb cc", "dd ee"]]
    # blank lines before newlines before characters
    assert pieces_of(spark, ["one\n\ntwo\nthree\n\nabcdefghij"], 8, 2) == [
        ["one", "two", "three", "abcdefg", "fghij"]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tdefclass", max_size=300), min_size=1, max_size=6),
       st.integers(8, 60), st.integers(0, 6))
def test_pieces_fit_follow_each_other_and_cover_the_text(spark, texts, size, overlap):
    for text, pieces in zip(texts, pieces_of(spark, texts, size, overlap)):
        assert all(0 < len(p) <= size and p == p.strip() and p in text for p in pieces)
        # Overlaps only repeat: without white space the text is a subsequence of its pieces.
        rest = iter("".join("".join(pieces).split()))
        assert all(c in rest for c in "".join(text.split()))


def test_fixed_windows_cover_text(spark):
    texts = ["", "x", "a" * 2000, "b" * 2001, "".join(chr(65 + i % 26) for i in range(5000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = split.window_pieces(df, "text", 2000, 200).orderBy("id", "piece_no").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, []).append(r.piece)
    for i, t in enumerate(texts):
        got = by_id.get(i, [])
        if not t:
            assert got == []
            continue
        assert all(len(p) <= 2000 for p in got)
        rebuilt = got[0] + "".join(p[200:] for p in got[1:])
        assert rebuilt == t


def test_fixed_windows_is_native(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    plan = df.select(F.posexplode(split.fixed_windows("text", 10, 2)))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_split_pack_query_properties(spark):
    """split_pack over whole documents: every piece fits, is a stripped substring of its
    document, pieces advance through the text, and every non-space character is covered."""
    from chunkgraph.plans.corpus import q_split_pack
    from chunkgraph.sources.tables import read_table
    from tests.conftest import SF_SMALL
    docs = {r.doc_id: r.text for r in read_table(spark, SF_SMALL, "documents").collect()}
    pieces = {}
    for r in q_split_pack(spark, SF_SMALL).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.piece))
    for doc_id, text in docs.items():
        got = [p for _, p in sorted(pieces.get(doc_id, []))]
        covered = [False] * len(text)
        pos = 0
        for p in got:
            assert 0 < len(p) <= 2000 and p == p.strip()
            at = text.find(p, max(0, pos - 2000))
            assert at >= 0
            for i in range(at, at + len(p)):
                covered[i] = True
            pos = at + len(p)
        assert all(c or text[i].isspace() for i, c in enumerate(covered))


@pytest.mark.parametrize("text", ["x" * 1_000_000, "word " * 200_000, ("y" * 3000 + " ") * 300])
def test_long_texts_take_seconds(spark, text):
    import time
    t0 = time.time()
    pieces, = pieces_of(spark, [text], 2000, 200)
    assert time.time() - t0 < 30
    assert max(map(len, pieces)) <= 2000 and sum(map(len, pieces)) >= len(text.replace(" ", ""))
