import hashlib
import random
import re

import numpy as np
import pytest

from chunkgraph.llm import oph, wordhash
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def model(docs):
    """{doc_id: (n_chars, sha of edit, edit, next)} for unique ids."""
    ids = sorted(docs)
    out = {}
    for i, d in enumerate(ids):
        text, nxt = docs[d] or "", docs[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, nxt)
    return out


def check(rows, docs):
    want = model(docs)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, sha, edited, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(jaccard(docs[r.doc_id], edited), abs=0.13)
        assert r.near_next == pytest.approx(jaccard(docs[r.doc_id], nxt), abs=0.13)


def test_query_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = oph.op1_oph_fingerprints(spark, SF_SMALL).collect()
    check(rows, docs)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint


EDGE = [None, "", " \n\t", "one", "One", "one two three", "a b c d e f", "a\nb c\td e F", "ünï " * 30,
        "long " * 40000, " ".join(map(str, range(30000))), "", "x"]


def test_edge_texts(spark):
    docs = {3 * i: t for i, t in enumerate(EDGE)}
    rows = oph.successive_likeness(make_docs(spark, list(docs.items()))).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    want = model(docs)
    for r in rows:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    fp = {r.doc_id // 3: r.fingerprint for r in rows}
    assert fp[0] == fp[1] == fp[2] == "" and fp[3] == fp[4] and fp[6] == fp[7] != fp[5]
    assert {r.doc_id // 3: r.near_next for r in rows}[0] == 1.0


def test_one_row_nulls_repeats_clashes_and_empty_table(spark):
    row = oph.successive_likeness(make_docs(spark, ["a b c d e f g h"])).first()
    assert row.near_next == 1.0
    df = spark.createDataFrame([(None, "some text of no id", "x"), (2, "w " * 9, "x"), (2, "w " * 9, "x")],
                               "doc_id long, text string, fingerprint string")
    rows = oph.successive_likeness(df).collect()
    assert sorted((r.doc_id or 0, r.near_next) for r in rows) == [(0, 0.0), (2, 1.0), (2, 1.0)]
    assert [r for r in rows if r.doc_id is None][0].edited_sha256 == hashlib.sha256(b"some text").hexdigest()
    assert oph.successive_likeness(df.limit(0)).count() == 0
    assert oph.fingerprint(df).count() == 3


@pytest.mark.parametrize("shared", [0.0, 0.3, 0.6, 0.9, 1.0])
def test_estimate_is_close_and_unbiased(shared):
    rng = random.Random(int(shared * 10))
    est, true = [], []
    for _ in range(40):
        n = rng.choice([30, 200, 2000])
        a = [str(rng.random()) for _ in range(n)]
        b = a[:int(shared * n)] + [str(rng.random()) for _ in range(n - int(shared * n))]
        x, y = " ".join(a), " ".join(b)
        v, f = oph.sketches([x.encode(), y.encode()])
        est.append(float(oph.likeness(v[0], f[0], v[1], f[1])))
        true.append(jaccard(x, y))
    assert abs(np.mean(est) - np.mean(true)) < 0.03
    assert max(abs(a - b) for a, b in zip(est, true)) < 0.2


def test_pack_round_trip_and_densify_is_consistent():
    v, f = oph.sketches([b"a b c d e f g h", b"a b c d e f g h", b""])
    fp = oph.pack(v, f)
    assert fp[0] == fp[1] and len(fp[0]) == oph.BINS * oph.BITS // 4 and fp[2] == ""
    assert (oph.unpack(fp[0]) == v[0]).all()


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    words = [b"alpha", b"b", "ä".encode(), b"longword" * 900]
    h1, counts, _ = wordhash.words([b" ".join(words)])
    h2, _, _ = wordhash.words([b"x" * 777 + b"\t" + b"\n".join(words[::-1])])
    assert counts.tolist() == [4] and h1.tolist() == h2[1:][::-1].tolist()
    h3, c3, _ = wordhash.words([b"pad " * ((1 << 22) - 1) + b"al" + b"pha zz", b"", b"alpha"])
    assert h3[(1 << 22) - 1] == h1[0] == h3[-1] and c3.tolist() == [(1 << 22) + 1, 0, 1]
