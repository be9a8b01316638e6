"""Substring dedup against a dictionary of all windows, and its FM-index against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from chunkgraph.llm import fmindex, substring
from tests.llm.conftest import make_docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def _model(rows, window=50):
    first = {}
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _run(df, **kw):
    out = substring.dedup_passages(df, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest())
                   for r in out), key=str)


def _corpus(seed, n=60, window=50):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "The", "the", "é", "x,"]) + str(rnd.randint(0, 40))
    shared = [[word() for _ in range(rnd.randint(window - 2, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [[word() for _ in range(rnd.randint(0, 40))] for _ in range(rnd.randint(1, 3))]
        for _ in range(rnd.randint(0, 2)):
            p = list(rnd.choice(shared))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "changed"
            if rnd.random() < 0.4:
                p = p[rnd.randint(0, 30):]
            parts.insert(rnd.randint(0, len(parts)), p)
        rows.append((d * 3, rnd.choice([" ", "\n", " \t"]).join(sum(parts, []))))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [4096, 2])
def test_matches_the_model(spark, monkeypatch, limit):
    monkeypatch.setattr(substring, "ANCHOR_PASSAGES", limit)
    monkeypatch.setattr(substring, "SHARD_PASSAGES", 16)
    rows = _corpus(limit)
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, rows[0][1]), (1003, rows[0][1]),
             (1004, "same " * 200), (1005, "same " * 300), (1006, rows[1][1] * 40)]
    assert _run(make_docs(spark, rows).repartition(4)) == _model(rows)


def test_exactly_one_window(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:50])), (2, "x " + " ".join(w[:49]) + " y"), (3, "s " + " ".join(w[:50]) + " y"),
            (4, " ".join(w[5:55])), (5, " ".join(["q"] * 3 + w[5:60]))]
    got = _run(make_docs(spark, rows))
    assert got == _model(rows)
    assert [r[2] for r in got] == [0, 0, 50, 0, 50]


def test_repeated_rows_and_shared_ids(spark):
    w = " ".join(f"w{i}" for i in range(80))
    v = " ".join(f"v{i}" for i in range(80))
    rows = [(1, w), (1, w), (1, v), (2, "z " + v), (2, w), (2, "u " + w)]
    assert _run(make_docs(spark, rows)) == _model(rows)


def test_empty_table_and_clashing_columns(spark):
    assert _run(make_docs(spark, [])) == []
    w = " ".join(f"w{i}" for i in range(80))
    d = spark.createDataFrame([(1, w, 5, "a", "b", "c"), (2, w, 6, "d", "e", "f")],
                              "doc_id long, text string, n_words int, row string, _gone string, at string")
    out = substring.dedup_passages(d)
    assert out.columns == ["doc_id", "text", "row", "_gone", "at", "n_words", "n_removed"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (1, w, "a", "b", "c", 80, 0), (2, "", "d", "e", "f", 80, 80)]


def test_window_length(spark):
    rows = _corpus(5, 30, 20)
    assert _run(make_docs(spark, rows), window=20, k=8) == _model(rows, 20)


def test_wavelet_rank():
    rnd = np.random.default_rng(1)
    seq = rnd.integers(0, 13, 700)
    tree = fmindex.WaveletMatrix(seq, 13)
    c, at = rnd.integers(0, 13, 300), rnd.integers(0, 701, 300)
    assert tree.rank(c, at).tolist() == [int((seq[:a] == x).sum()) for x, a in zip(c, at)]


def test_matching_statistics_of_other_texts():
    rnd = np.random.default_rng(2)
    texts = [rnd.integers(1, 4, rnd.integers(1, 60)) for _ in range(40)]
    index = fmindex.PassageIndex(texts, np.arange(40), 6)
    others = [np.where(rnd.random(len(t)) < 0.1, 0, t)[::-1].copy() for t in texts]
    length, owner = index.stream(others)
    has = [{tuple(t[i:i + n]) for i in range(len(t) - n + 1)} for t in texts for n in [6]]
    runs = {n: {tuple(t[i:i + n]) for t in texts for i in range(len(t) - n + 1)} for n in range(1, 7)}
    for r, t in enumerate(others):
        for i in range(len(t)):
            want = max([n for n in range(1, min(6, len(t) - i) + 1) if tuple(t[i:i + n]) in runs[n]], default=0)
            assert min(length[r, i], 6) == want
            holders = [d for d in range(40) if tuple(t[i:i + 6]) in has[d]]
            assert owner[r, i] == (min(holders) if want == 6 else -1)


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substring.op13_substring_dedup(spark, sf)
                  .select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == _model(rows)
    assert sum(r[2] for r in got) > 0
