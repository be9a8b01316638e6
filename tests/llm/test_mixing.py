import math
import re
from collections import Counter, defaultdict

import pytest

from chunkgraph.llm import mixing
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, sizes, docs_per=30):
    rows, n = [], 0
    for source, tokens in sizes.items():
        for i in range(docs_per):
            rows.append((n, "w " * (tokens // docs_per), "en", source, 0))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def entropy(ws):
    return -sum(w * math.log(w) for w in ws if w)


def test_entropy_target_is_met(spark):
    sizes = {"a": 9000, "b": 900, "c": 300}
    stats = mixing.source_stats(table(spark, sizes), "source", "text")
    a = mixing.exponent(stats, target_entropy=0.9)
    p = [t / 10200 for t in sizes.values()]
    z = sum(x ** a for x in p)
    assert entropy([x ** a / z for x in p]) == pytest.approx(0.9, abs=1e-5)
    assert mixing.exponent(stats, target_entropy=9.0) == 0.0


def test_repetition_limit_is_met(spark):
    sizes = {"a": 9000, "b": 900, "c": 300}
    out = mixing.mix_sources(table(spark, sizes), max_repeat=2.5).collect()
    got = Counter(r.source for r in out)
    assert got["a"] == 30 and 70 <= got["c"] <= 76 and 30 < got["b"] < got["c"]


def passes(rows, source_of):
    """Times each source's tokens are taken."""
    once, taken = Counter(), Counter()
    for doc, n in {r.doc_id: r.n_tokens for r in rows}.items():
        once[source_of[doc]] += n
    for r in rows:
        taken[r.source] += r.n_tokens
    return {s: taken[s] / once[s] for s in once if once[s]}


def test_limit_bounds_exponents_above_one(spark):
    df = table(spark, {"a": 1200, "b": 1050, "c": 900})
    stats = mixing.source_stats(df, "source", "text")
    target = 0.8 * math.log(3)
    free = mixing.exponent(stats, target_entropy=target)
    a = mixing.exponent(stats, target_entropy=target, max_repeat=2.0)
    assert 1 < a < free and (1200 / 900) ** (a - 1) == pytest.approx(2, abs=1e-5)
    assert mixing.exponent(stats, target_entropy=target, max_repeat=50.0) == pytest.approx(free)
    out = mixing.mix_sources(df, target_entropy=target, max_repeat=2.0).collect()
    assert max(Counter(r.doc_id for r in out).values()) == 2


def test_entropy_target_is_met_by_nearly_even_sources(spark):
    sizes = {"a": 1020, "b": 990, "c": 960}
    stats = mixing.source_stats(table(spark, sizes), "source", "text")
    a = mixing.exponent(stats, target_entropy=0.9 * math.log(3))
    z = sum(x ** a for x in sizes.values())
    assert a > 8 and entropy([x ** a / z for x in sizes.values()]) == pytest.approx(0.9 * math.log(3), abs=1e-5)
    equal = mixing.source_stats(table(spark, {"a": 900, "b": 900}), "source", "text")
    assert mixing.exponent(equal, target_entropy=0.5) == 1.0


def test_no_source_exceeds_the_limit_in_the_query(spark, tmp_path):
    rows = mixing.op6_source_mixing(spark, SF_SMALL).collect()
    docs = {d.doc_id: d.source for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert max(passes(rows, docs).values()) <= mixing.MAX_REPEAT
    # Sources so nearly even that the target alone would repeat the largest far more often.
    even = table(spark, {"a": 3000, "b": 2400, "c": 2100, "d": 2100})
    even.write.parquet(str(tmp_path / "documents.parquet"))
    rows = mixing.op6_source_mixing(spark, str(tmp_path)).collect()
    got = passes(rows, {r.doc_id: r.source for r in rows})
    assert 1 < max(got.values()) <= mixing.MAX_REPEAT and min(got.values()) == 1


def test_blocks_positions_and_passes(spark):
    out = mixing.mix_sources(table(spark, {"a": 9000, "b": 900}), target_entropy=0.6).collect()
    for source in "ab":
        rows = sorted((r for r in out if r.source == source), key=lambda r: r.position)
        assert [r.epoch for r in rows] == sorted(r.epoch for r in rows)
        passes = defaultdict(list)
        for r in rows:
            passes[r.epoch].append(r)
        last = max(passes)
        for e, rs in passes.items():
            ids = [r.doc_id for r in rs]
            assert len(set(ids)) == len(ids) and (e == last or len(ids) == 30)
            blocks = [r.block for r in rs]  # a block is taken as a whole
            assert len([i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]]) == len(set(blocks)) - 1
        if last > 1:
            assert [r.doc_id for r in passes[0]] != [r.doc_id for r in passes[1]]
    assert all(0 <= r.position < 1 for r in out)


def test_budget_is_reached_and_not_passed_by_more_than_a_document(spark):
    out = mixing.mix_sources(table(spark, {"a": 9000, "b": 900}), max_repeat=3.0, budget=5000).collect()
    held = Counter()
    for r in out:
        held[r.source] += r.n_tokens
    w = {r.source: r.weight for r in out}
    for s, size in (("a", 300), ("b", 30)):
        assert w[s] * 5000 - 1 <= held[s] < w[s] * 5000 + size + 1


def test_no_document_is_left_out_on_the_table(spark):
    rows = mixing.op6_source_mixing(spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert {r.doc_id for r in rows} == {d.doc_id for d in docs}
    count = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    assert all(r.n_tokens == count[r.doc_id] for r in rows)
    held, total = Counter(), sum(r.n_tokens for r in rows)
    for r in rows:
        held[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1)
    for s, w in weight.items():  # each source stops within one document of its quota
        assert held[s] / total == pytest.approx(w, abs=0.02)
    assert entropy(weight.values()) >= 0.95 * math.log(len(weight)) - 1e-6


def test_nulls_empty_texts_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame(
        [(None, None, "x", 1.0), (1, "", "x", 1.0), (2, "a b c", None, 1.0), (2, "a b c", None, 1.0),
         (3, "d e", "y", 1.0), (4, "long " * 50000, "y", 1.0)],
        "doc_id long, text string, source string, weight double")
    rows = mixing.mix_sources(df, max_repeat=1.0).collect()
    assert Counter(r.doc_id for r in rows) == {None: 1, 1: 1, 2: 2, 3: 1, 4: 1}
    assert sum({r.source: r.weight for r in rows}.values()) == pytest.approx(1)
    assert mixing.mix_sources(df.limit(0), max_repeat=1.0).count() == 0


def test_plan_has_no_python(spark):
    plan = mixing.op6_source_mixing(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
