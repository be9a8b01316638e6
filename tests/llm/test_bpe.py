import base64
import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from chunkgraph.llm import bpe
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs

PATH = public_tokenizers.path(bpe.VOCABULARY)
DATA = open(PATH, "rb").read()
CODEC = bpe.codec(DATA, public_tokenizers.PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                           mergeable_ranks=bpe.parse_ranks(DATA))


def same(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == ORACLE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", [
    "", " ", "a", " a", "a ", "a b", "a  b", "a\nb", "a\n\nb", "a \n b", "\n", "\n\n", "x\ty", "x\t\ty",
    "don't we'll I'VE '", "12 345,678.9", "#*$%&|<> ...", "naïve Ärger 東京 🙂🙂 ﷺ", "a\x1cb \x1c c",
    "a\x85b", "a b", "a　 b", "tab\r\nnew", "  lead", "trail  ", "é ​ x", "<|endoftext|>"])
def test_against_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sré \n\t\r  .!1٣東🙂\x1c"), max_size=40))
def test_against_the_library_on_random_texts(text):
    same(text)


def test_every_assigned_character():
    chars = [c for c in map(chr, range(sys.maxunicode + 1))
             if unicodedata.category(c) not in ("Cs", "Cn")]
    same("".join(f"a{c}{c}b {c} " for c in chars[::7]))


def test_long_pre_tokens():
    rng = random.Random(3)
    same("".join(rng.choice("abcdefgh") for _ in range(30000)))
    same("z" * 20000)
    same("ab" * 5000 + " " * 5000 + "." * 5000)


def test_rank_queue_orders_by_rank_then_position():
    q, rng, held = bpe.RankQueue(50256), random.Random(1), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            assert q.pop() == min(held)
            held.remove(min(held))
        else:
            e = (rng.choice([0, 63, 64, 4095, 4096, 50255, rng.randrange(50256)]), rng.randrange(99))
            q.push(*e)
            held.append(e)
    assert [q.pop() for _ in range(len(held))] == sorted(held) and q.pop() is None


def test_cache_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SEGMENTS", 3)
    c = bpe.Codec(CODEC.ranks, public_tokenizers.PATTERN)
    for _ in range(3):
        text = "one two three four five six one two seven\none two"
        assert c.encode(text).tolist() == ORACLE.encode_ordinary(text)


def test_query_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in bpe.op2_byte_bpe(spark, SF_SMALL).collect():
        ids = ORACLE.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_operator_nulls_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "hello world", 6), (2, "", 7), (2, "", 7)],
                               "doc_id long, text string, ids int")
    out = bpe.bpe_encode(df, decode=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = sorted(((r.doc_id or 0, r.n_tokens, r.ids, bytes(r.decoded)) for r in out.collect()))
    assert rows == [(0, 2, ORACLE.encode_ordinary("hello world"), b"hello world"), (1, 0, [], b""),
                    (2, 0, [], b""), (2, 0, [], b"")]
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    back = bpe.bpe_decode(out.select("doc_id", "ids"))
    assert {bytes(r.decoded) for r in back.collect()} == {b"", b"hello world"}
    assert make_docs(spark, ["x"]).transform(bpe.bpe_encode).columns[-1] == "ids"
