"""The pipeline stage by stage against the brute-force versions of the operators' tests."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as cp
from chunkgraph.llm import common, quality_rules
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOCS, make_docs
from tests.llm.test_bpe import ORACLE
from tests.llm.test_line_dedup import WS, model as line_model
from tests.llm.test_quality_rules import base_model
from tests.llm.test_simhash import comp_model, fp_model


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after every stage, as collected rows."""
    docs = common.read(spark, SF_SMALL, "documents")
    out = [docs.collect()]
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = common.store(stage(spark, docs, SF_SMALL), f"test-{i}")
        out.append(docs.collect())
        if i < len(cp.STAGES) - 1:
            assert docs.columns == DOCS.names
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_order_of_the_stages():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup",
                                         "source_mixing", "byte_bpe"]


def test_quality_stage(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after.items() <= before.items()
    assert not any(base_model(t)[-1] for t in after.values())
    gone = set(before) - set(after)
    loss = {r.doc_id: r.loss for r in quality_rules.quality_rules(common.read(spark, SF_SMALL, "documents")).collect()}
    assert all(base_model(before[d])[-1] or loss[d] > quality_rules.MAX_LOSS for d in gone)


def test_line_dedup_stage(stages):
    want = {d: t for d, (n, dropped, t) in line_model(texts(stages[1])).items() if not dropped or t.strip(WS)}
    assert texts(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_dedup_stage(stages):
    before = texts(stages[2])
    comp = comp_model({d: fp_model(t) for d, t in before.items()})
    assert texts(stages[3]) == {d: t for d, t in before.items() if comp[d] == d}


def test_mixing_stage(stages):
    before, after = texts(stages[3]), Counter(r.doc_id for r in stages[4])
    assert set(after) == set(before) and max(after.values()) <= 2
    assert texts(stages[4]) == before


def test_encoding_stage(stages):
    text = texts(stages[4])
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        ids = ORACLE.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_planted_copies_junk_and_clean_documents(spark, tmp_path):
    clean = [" ".join(f"{w}{i}" for w in "the river rose in the night and nobody saw how far the water came "
                      "into the old town before the bells rang at last".split()) + "." for i in range(6)]
    rows = clean + [clean[0], clean[1].replace("night1", "dark1"), "$$$ ### " * 40, "word " * 60, None, ""]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert got >= set(range(6)) and not got & {6, 8, 9, 10, 11}


def test_empty_table(spark, tmp_path):
    make_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


ODD = ["row", "_w", "_k", "_twin", "_a", "_ld_id", "loss", "kept", "n_lines", "n_dropped", "weight", "epoch", "block",
       "position", "n_words", "clean_text", "key", "loser", "salt", "id", "none", "at", "fp", "component_id"]


def test_stages_return_columns_of_any_name_unchanged(spark):
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t), *[f"{c}{i}" for c in ODD])
            for i, t in enumerate([" ".join(f"w{j}x{i}" for j in range(30)) + "." for i in range(4)] + [None, ""])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ODD)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in ODD] == [f"{c}{r.doc_id}" for c in ODD], name
    assert cp.encoding_stage(spark, docs, SF_SMALL).count() == 6


def test_stages_with_null_empty_long_and_repeated_rows(spark):
    clean = [" ".join(f"{w}{i}" for w in "the river rose in the night and nobody saw how far the water came "
                      "into the old town before the bells rang at last".split()) + "." for i in range(3)]
    long = "\n".join(" ".join(f"word{i}of{j}" for j in range(20)) + "." for i in range(3000))
    rows = [(0, clean[0]), (1, clean[1]), (1, clean[1]), (2, None), (3, ""), (4, long), (None, clean[2]), (5, clean[0])]
    docs = make_docs(spark, rows)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    q = cp.quality_stage(spark, docs, SF_SMALL)
    assert ids(q) == [0, 1, 1, 4, 5, None]
    d = common.store(cp.line_dedup_stage(spark, docs, SF_SMALL), "t")
    assert ids(d) == [0, 1, 1, 2, 3, 4, None]  # 5 loses its only line
    assert {r.text for r in d.collect() if r.doc_id in (2, 3)} == {""}
    n = cp.near_dedup_stage(spark, docs, SF_SMALL)
    assert ids(n) == [0, 1, 1, 2, 4, None]  # the null and the empty text are one group
    m = cp.mixing_stage(spark, docs, SF_SMALL)
    assert set(ids(m)) == {0, 1, 2, 3, 4, 5, None} and {r.text for r in m.collect() if r.doc_id == 4} == {long}
    e = {r.doc_id: r.n_tokens for r in cp.encoding_stage(spark, docs, SF_SMALL).collect()}
    assert e[2] == e[3] == 0 and e[4] == len(ORACLE.encode_ordinary(long))
