import random

import numpy as np
import pytest
import xxhash

from chunkgraph.llm import components, simhash as sh
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs

WS = " \t\n\x0b\x0c\r"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WS:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def fp_model(text):
    w = words(text)
    if not w:
        return 0
    sh_ = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh_]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def comp_model(fps, bits=4):
    """{id: least id reachable} for {id: fingerprint}, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


EDGE = [None, "", " \n", "one", "One", "two words", "a b c d", "a b c d e", "Ä ä b c d", "ä ä b c d",
        "x " * 70000, "x " * 69999, "a b c d\te"]


def test_fingerprints_and_components(spark):
    got = {r.doc_id: (np.int64(r.fp).view(np.uint64).item(), r.component_id)
           for r in sh.simhash_components(make_docs(spark, EDGE)).collect()}
    fps = {i: fp_model(t) for i, t in enumerate(EDGE)}
    comp = comp_model(fps)
    assert got == {i: (fps[i], comp[i]) for i in fps}


def test_query_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fps = {i: fp_model(t) for i, t in docs.items()}
    comp = comp_model(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in sh.op9_simhash_dedup(spark, SF_SMALL).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def clouds(seed, centres, per, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(per):
            x = c
            for b in rng.sample(range(64), rng.randint(1, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bits, hot", [(1, 50_000), (3, 50_000), (4, 50_000), (4, 5), (6, 50_000)])
def test_links_reach_what_all_pairs_reach(spark, bits, hot):
    values = clouds(bits, 12, 40, 6)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    labels = components.connected_components(sh.hamming_links(df, bits, hot)).collect()
    got = {int(np.int64(r.node).view(np.uint64)): r.label for r in labels}
    want = comp_model(dict(enumerate(values)), bits)
    groups, seen = {}, {}
    for i, v in enumerate(values):
        groups.setdefault(want[i], set()).add(v)
        seen.setdefault(got.get(v, ("own", v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


@pytest.mark.parametrize("n", [100, 10**6, 10**9, 10**12])
def test_plan_keeps_the_pigeonhole_condition(n):
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    design = sh.plan(sample, n)
    assert sum(t + 1 for _, t in design) == 5
    used = [b for p, _ in design for b in p]
    assert len(used) == len(set(used))


def test_plan_uses_fewer_wider_partitions_for_more_rows():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    assert len(sh.plan(sample, 10**9)) < len(sh.plan(sample, 10**4))


def test_group_bits_puts_correlated_bits_together():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (400, 4))
    bits = np.repeat(base, 16, axis=1)[:, rng.permutation(64)].astype(np.uint8)
    for part in sh.group_bits(bits, 4):
        assert len({bits[:, b].tobytes() for b in part}) == 1


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(7, "the same words again and again here"), (3, "the same words again and again here"),
            (None, "the same words again and again here"), (9, "something else entirely, you see")]
    out = sh.simhash_dedup(make_docs(spark, rows))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 3, 9]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_null_ids_repeated_rows_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "alone in the null", 1), (4, "a b", 2), (4, "a b", 2)],
                               "doc_id long, text string, fp int")
    rows = sorted((r.doc_id or 0, r.component_id) for r in sh.simhash_components(df).collect())
    assert rows == [(0, None), (4, 4), (4, 4)]
    assert sh.simhash_components(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 500)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long")
    got = {r.node: r.label for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(500)}}


def test_a_cloud_of_near_fingerprints_is_shared_out(spark):
    """All within a few bits of each other, far over the size of a group: every task stays small."""
    import numpy as np
    rng = np.random.default_rng(3)
    fps = np.unique(np.bitwise_xor.reduce(
        np.uint64(1) << rng.integers(0, 64, (30_000, 3)).astype(np.uint64), axis=1)).view(np.int64)
    far = np.int64(0x5555555555555555)
    classes = spark.createDataFrame([(int(x),) for x in [*fps, far]], "fp long").repartition(8)
    links = sh.hamming_links(classes, 4, hot_rows=4000)
    labels = components.connected_components(links)
    rows = labels.collect()
    assert {r.node for r in rows} == {int(x) for x in fps}
    assert {r.label for r in rows} == {min(int(x) for x in fps)}


def test_a_hub_is_not_one_task(spark):
    edges = spark.range(1, 20_001).selectExpr("id AS u", "0L AS v").unionByName(
        spark.range(1, 100).selectExpr("id + 30000 AS u", "id + 29999 AS v"))
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(20_001)}, **{30_000 + i: 30_000 for i in range(100)}}
