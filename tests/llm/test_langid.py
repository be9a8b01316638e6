import zlib

import numpy as np

from chunkgraph.llm import langid as li
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs


def test_held_out_accuracy_on_the_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = li.op4_language_id(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def small_model(spark):
    rows = [("the cat and the dog run over the hill with the ball", "en"),
            ("der hund und die katze laufen über den berg", "de"),
            ("le chien et le chat courent sur la colline", "fr")] * 3
    return li.train(spark.createDataFrame(rows, "text string, lang string"))


def test_edge_texts(spark):
    model = small_model(spark)
    texts = [None, "", "123 ... !", "the dog and the cat", "der hund und", "LE CHAT ET LE CHIEN", "東京都", "x",
             "der hund " * 20000]
    rows = {r.doc_id: r for r in li.predict(make_docs(spark, texts), model).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "fr"]
    assert rows[6].lang_pred in model.langs and rows[6].score == 0 and rows[8].lang_pred == "de"
    assert all(rows[i].score == 0 for i in range(3))


def test_filter_returns_every_member_and_few_others(spark, monkeypatch):
    model = small_model(spark)
    codes, _ = li.grams(["the cat and the dog"])
    hit = model.table[0][li.slots_of(codes, model.table.shape[1])[0]]
    for s in li.slots_of(codes, model.table.shape[1])[1:]:
        hit = hit & model.table[0][s]
    en = np.uint64(1 << model.langs.index("en"))
    assert (hit & en != 0).mean() > 0.9
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 1 << 40, 20000, dtype=np.uint64)
    hit = model.table[0][li.slots_of(noise, model.table.shape[1])[0]]
    for s in li.slots_of(noise, model.table.shape[1])[1:]:
        hit = hit & model.table[0][s]
    assert (hit != 0).mean() < 0.01


def test_more_than_64_languages(spark):
    rows = [(f"{chr(97 + i // 26)}{chr(97 + i % 26)}qx " * 12, f"l{i:03d}") for i in range(70)]
    model = li.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.table) == 2
    pred = li.predict(make_docs(spark, [t for t, _ in rows]), model).collect()
    assert {r.doc_id: r.lang_pred for r in pred} == {i: f"l{i:03d}" for i in range(70)}


def test_null_langs_repeats_clashes_and_empty_tables(spark):
    none = spark.createDataFrame([("some text", None)], "text string, lang string")
    model = li.train(none)
    assert li.predict(make_docs(spark, ["some text"]), model).first().lang_pred == "und"
    model = small_model(spark)
    df = spark.createDataFrame([(None, "the dog", "q"), (3, "the dog", "q"), (3, "the dog", "q")],
                               "doc_id long, text string, score string")
    assert [r.lang_pred for r in li.predict(df, model).collect()] == ["en"] * 3
    assert li.predict(df.limit(0), model).count() == 0
    assert li.train(none.limit(0)).langs == []


def _model_by_hand(rows, tests, factor=1.5, least=2):
    """Corrected popcounts from dictionaries and Python integers, one gram at a time."""
    M = (1 << 64) - 1

    def clean(t):
        out = [" "]
        for b in t.lower().encode():
            c = b if 97 <= b <= 122 or b >= 128 else 32
            if not (c == 32 and out[-1] in (32, " ")):
                out.append(c)
        return [32, *out[1:]] + ([] if out[-1] in (32, " ") else [32])

    def grams(t):
        raw = clean(t or "")
        for n in (3, 4):
            for i in range(len(raw) - n + 1):
                code = n
                for x in raw[i:i + n]:
                    code = code << 8 | x
                yield n, code

    langs = sorted({x for _, x in rows})
    count, total = {}, {}
    for t, lang in rows:
        for n, g in grams(t):
            count[n, g, lang] = count.get((n, g, lang), 0) + 1
            total[n, lang] = total.get((n, lang), 0) + 1
    rate = {k: c / total[k[0], k[2]] for k, c in count.items()}
    whole = {}
    for (n, g, _), r in rate.items():
        whole[n, g] = whole.get((n, g), 0) + r
    members = {lang: {g for (n, g, x), c in count.items() if x == lang and c >= least
                      and rate[n, g, x] >= min(factor / len(langs), 1.0) * whole[n, g]} for lang in langs}
    size = 1 << 16
    while size < 24 * max(map(len, members.values())):
        size *= 2

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & M
        return x ^ x >> 29

    def places(g):
        a = mix(g * 0x9E3779B97F4A7C15 & M)
        b = mix(a ^ 0xD1342543DE82EF95) | 1
        return [(a + j * b & M) % size for j in range(3)]

    filled = {lang: {p for g in members[lang] for p in places(g)} for lang in langs}
    out = []
    for t in tests:
        mine = [g for _, g in grams(t)]
        row = []
        for lang in langs:
            fp = (len(filled[lang]) / size) ** 3
            hits = sum(all(p in filled[lang] for p in places(g)) for g in mine)
            row.append(max((hits - len(mine) * fp) / (1 - fp), 0))
        out.append(row)
    return langs, out


def test_scores_equal_a_count_by_hand(spark):
    docs = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect() if r.lang and r.text][:40]
    rows = [(r.text[:1500], r.lang) for r in docs]
    tests = [None, "", "Été à la plage", "the dog", *[r.text[:300] for r in docs[:10]]]
    model = li.train(spark.createDataFrame(rows, "text string, lang string"))
    langs, want = _model_by_hand(rows, tests)
    assert model.langs == langs
    assert np.allclose(li.scores(tests, model), want, rtol=1e-9, atol=1e-9)


def test_the_filter_grows_with_its_members(spark, monkeypatch):
    assert li.slots_for(10) == 1 << 16 and li.slots_for(100_000) == 1 << 22
    assert li.slots_for(10 ** 9) == li.MAX_SLOTS
    monkeypatch.setattr(li, "MIN_SLOTS", 256)
    monkeypatch.setattr(li, "MAX_SLOTS", 256)
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()[:60]]
    model = li.train(spark.createDataFrame(rows, "text string, lang string"))
    fill = model.false_positive ** (1 / li.HASHES)
    assert model.table.shape == (1, 256) and fill.max() <= li.MAX_FILL + 0.01  # a crowded filter keeps its bound
