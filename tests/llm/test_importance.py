"""Importance resampling against a brute-force model written from the definition."""

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from chunkgraph.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def _features(text):
    w = _words(text)
    return w + [" ".join(w[i:i + 2]) for i in range(len(w) - 1)]


def _model(docs, target, percent=25, min_words=20, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in _features(text):
            s[bucket(f)] += 1
    for text in target:
        for f in _features(text):
            t[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (S + buckets) / ((s[i] + 1) * (T + buckets))))
            for i in range(buckets)]
    rows = []
    for doc, text in docs:
        f = _features(text)
        weight = math.floor(sum(gain[bucket(x)] for x in f) / len(f)) if f else 0
        name = f"{seed}:{'' if doc is None else doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(f), weight, weight + noise, None, len(_words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def _random_docs(n, seed):
    rnd = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "éclair", "Straße", "x1", "42", "don't", "a-b", "ÀB", "日本"]
    text = lambda: rnd.choice([" ", "\n", "\t "]).join(
        rnd.choice(vocab) + rnd.choice(["", ",", ".", " ;"]) for _ in range(rnd.randint(0, 60)))
    return [(i, text()) for i in range(n)]


def test_matches_the_model(spark):
    docs = _random_docs(120, 1) + [(500, None), (501, ""), (502, " .,;\n"), (503, "word " * 5000)]
    target = [t for _, t in _random_docs(10, 2)] + [None]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    assert _rows(importance.importance_scores(d, t)) == _model(docs, target)


def test_clashing_columns_ties_and_repeated_rows(spark):
    docs = _random_docs(30, 3)
    rows = [(i, t, "x", 1, 2.0, "y") for i, t in docs]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, score string, rank int,"
                              " weight double, buckets string")
    t = spark.createDataFrame([("alpha beta",)], "text string")
    out = importance.importance_scores(d, t, percent=100, min_words=0)
    assert sorted(r.rank for r in out.collect()) == list(range(1, 34))
    picked = importance.resample(d, t, min_words=0)
    assert picked.columns == d.columns
    assert {r.weight for r in picked.collect()} == {2.0}


def test_null_ids_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    t = spark.createDataFrame([("alpha beta",)], "text string")
    assert importance.importance_scores(empty, t).count() == 0
    d = spark.createDataFrame([(None, "alpha beta"), (None, None)], "doc_id long, text string")
    assert _rows(importance.importance_scores(d, empty.select("text"), min_words=0, percent=50)) \
        == _model([(None, "alpha beta"), (None, None)], [], percent=50, min_words=0)


def test_spans_are_whole_words():
    line = importance.normalise("Ab,  c\tD-é".encode())
    assert line == "ab c d é".encode()
    assert [m[0] for m in importance.ngram_pattern(2).finditer(line, overlapped=True)] == [
        b"ab c", b"c d", "d é".encode()]
    assert [m[0] for m in importance.ngram_pattern(3).finditer(line, overlapped=True)] == [
        b"ab c d", "c d é".encode()]


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    out = importance.op11_importance_resampling(spark, sf)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert _rows(out) == _model(docs, target)
    assert out.where(F.col("rank").isNotNull()).count() > 0
