import re

import pytest
from pyspark.sql import functions as F

from chunkgraph.llm import quality_rules as qr
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_model(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
EIGHT = "a b c d e f g h"
EDGE = [None, "", " \t\n", "one", EIGHT, EIGHT + " " + EIGHT, EIGHT + " x " + EIGHT + " i " + EIGHT,
        "same " * 40, "line one here\nline one here\n\n\nother\n \n ", "x\r\ny\x0bz\x0cw",
        "ünï cödé # % & | < > * $ " * 9, "a" * 200000, "word " * 50000]


def test_base_counts_match_the_model(spark):
    df = make_docs(spark, EDGE)
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in qr.quality_rules(df).collect()}
    assert got == {i: base_model(t) for i, t in enumerate(EDGE)}


def test_base_counts_match_the_model_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLS)
           for r in qr.op10_quality_rules(spark, SF_SMALL).collect()}
    assert got == {i: base_model(t) for i, t in docs.items()}


PROSE = "The river rose in the night and the bridge was closed by morning."


@pytest.mark.parametrize("line, ok", [
    (PROSE, True), ("", True), ("   ", True), ("Short title", False), ("It ended.", True),
    ("Home | News | Sport | Weather | More", False), ("read more", False),
    ("We use cookies to improve your visit to this site and others.", False),
    ("Released under the MIT License.", False), ("he said no no no no no and left the room", False),
    ("he said no no, no and left the room at once", True), ("CLICK here to read more about the story", False), ("%%% ### $$$ text *** here && now it is.", False),
    ("A long line without any closing mark still counts as running text", True)])
def test_line_rules(spark, line, ok):
    df = spark.createDataFrame([(line,)], "line string")
    bare = F.btrim(df.line, F.lit(qr.WS_CHARS))
    assert df.select(qr.line_passes(bare, F.lower(bare))).first()[0] is ok


def test_documents_losing_too_much_are_rejected(spark):
    prose = [" ".join(f"{w}{i}" for w in PROSE[:-1].split()) + "." for i in range(4)]
    menu = ["Home | News | Sport | Weather | More"] * 12
    rows = make_docs(spark, ["\n".join(prose), "\n".join(prose + menu[:1]), "\n".join(prose + menu)])
    got = [(r.kept, r.n_removed_lines) for r in qr.quality_rules(rows).orderBy("doc_id").collect()]
    assert got == [(True, 0), (True, 1), (False, 12)]


def numbered(n, lo=0):
    """``n`` clean sentences, no two alike."""
    return [" ".join(f"{w}{i}" for w in PROSE[:-1].split()) + "." for i in range(lo, lo + n)]


def test_long_clean_lines_may_mention_phrases(spark):
    phrases = [*qr.BOILERPLATE, "© 2024"]
    one_each = [" ".join(numbered(3, 9 * i) + [f"Then they read {p} on a sign{i}."] + numbered(3, 9 * i + 3))
                for i, p in enumerate(phrases)]
    every = " ".join(one_each)  # a single line with each phrase
    no_marks = every.replace(".", "")
    banner = " ".join(f"We use cookies for purpose {i} and you can read our privacy policy." for i in range(9))
    rows = qr.quality_rules(make_docs(spark, [*one_each, every, no_marks, banner])).orderBy("doc_id").collect()
    n = len(phrases)
    assert all(r.kept and r.n_removed_lines == 0 and r.loss == 0 for r in rows[:n + 2])
    assert rows[n + 2].n_removed_lines == 1 and not rows[n + 2].kept


@pytest.mark.parametrize("line, ok", [
    ("©  2024 by the makers of this fine page", False), ("©\t1887 by the makers of this fine page", False),
    ("©2024 by the makers of this fine page", False), ("The © 20 badge hung over the narrow door.", True)])
def test_year_after_the_sign(spark, line, ok):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(qr.line_passes(df.line, F.lower(df.line))).first()[0] is ok


def test_clashing_columns_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, PROSE, 7, "k"), (1, PROSE, 7, "k")],
                               "doc_id long, text string, n_words int, kept string")
    rows = qr.quality_rules(df).collect()
    assert len(rows) == 2 and rows[0].n_words == 13 and rows[0].kept is False
    assert qr.quality_rules(df.limit(0)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = qr.op10_quality_rules(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_filter_on_the_verdict_stays_above_the_rules(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = qr.quality_rules(docs).where("kept")
    assert kept.count() == qr.quality_rules(docs).groupBy("kept").count().where("kept").first()[1]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 4


CLEAN_MENTION = ("The committee that met in the old town hall on the river asked the council to put the privacy policy "
                 "of the new library on the wall by the door where every visitor who walks in with a child or a dog "
                 "can stop and read the whole of it before going on to the shelves.")
COOKIE_NOTICE = ("We use cookies and similar tools described in our cookie policy, and if you accept cookies you agree to "
                 "the terms of use and the terms of service of this site and of its partners, whose own privacy policy "
                 "you may read if you click here, while those who do not accept cookies can enable javascript or "
                 "subscribe to our newsletter, powered by our friends, all rights reserved, and come back to the "
                 "privacy policy and the cookie policy of this page as often as they wish, since we use cookies "
                 "to remember that choice for a year.")


def test_length_of_a_line_decides_nothing(spark):
    assert len(CLEAN_MENTION) > 250 and len(COOKIE_NOTICE) > 500
    rows = qr.quality_rules(make_docs(spark, [CLEAN_MENTION, COOKIE_NOTICE])).orderBy("doc_id").collect()
    assert [(r.kept, r.n_removed_lines) for r in rows] == [(True, 0), (False, 1)]


def test_sql_agrees_on_generated_lines(spark, tmp_path):
    import random

    import duckdb

    from chunkgraph.llm.oracles import ORACLES
    rnd = random.Random(4)
    bits = [*qr.BOILERPLATE, "© 2024", "©  1999 the", "© 20", "Copyright ©", "home |", "no", "!", "?", "...", "»", "#",
            "ÀÉ", "word.", "(c)", "\t", "\n", "© 2001 Some One Else Co"]
    texts = []
    for _ in range(600):
        parts, size = [], rnd.randint(50, 2000)
        while sum(map(len, parts)) < size:
            parts.append(rnd.choice(bits) if rnd.random() < 0.12 else rnd.choice(
                ["river", "Bridge", "the", "of", "night,", "morning.", "x"]) + str(rnd.randint(0, 99)))
        texts.append(" ".join(parts))
    path = str(tmp_path / "sf")
    make_docs(spark, texts).coalesce(1).write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in qr.op10_quality_rules(spark, path).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT * FROM ({ORACLES['op10_quality_rules']}) x ORDER BY doc_id").fetchall()
    assert got == want
    assert len({r[7] for r in got}) == 2
