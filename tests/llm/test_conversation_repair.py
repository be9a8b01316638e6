"""Conversation repair against a search over all edit lists, written from the definition."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from chunkgraph.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for c, t, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _best(rows, faults):
    """(cost, letters, repaired) by exhaustive recursion over rows and the role pattern."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def go(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        need = "assistant" if state == "u" else "user"
        if inserts < 2:
            c, a, r = go(i, need[0], inserts + 1)
            ways.append((c + 3, "I" + a, ((need, ""),) + r))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, r = go(i + 1, state, 0)
            ways.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                nxt = step.get((state, role[:1]))
                if nxt:
                    c, a, r = go(i + 1, nxt, 0)
                    ways.append((c + extra, "K" + a, ((role, text),) + r))
                c, a, r = go(i + 1, need[0], 0)
                ways.append((c + extra + 3, "R" + a, ((need, text),) + r))
        return min(ways, default=(10 ** 9, "", ()))

    return go(0, "", 0)


def _model(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = _damaged([r for r in rows if r[0] == c])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        f = _faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        ini = [r[2][:1] for r in mine]
        cost, audit, fixed = _best(tuple(mine), tuple(f))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"),
                  f.count("duplicate"), f.count("truncated"),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, sha)
    return out


def _op(spark, rows, tmp_path, name="t", parts=3):
    path = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{path}/conversations.parquet")
    got = cr.op12_conversation_repair(spark, path).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        r.repaired_sha256) for r in got}


def _random_rows(n_conv, seed, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(n_conv):
        for t in range(rnd.randint(1, longest)):
            if rnd.random() < 0.9:
                rows.append((c, t, rnd.choice(["user", "assistant", "system", "tool", None]),
                             rnd.choice(["Yes.", "No", "Why?", "", " \n", None, "Ünd! ", "x" * 50 + "."])))
    return rows


@pytest.mark.parametrize("segment,fanin", [(512, 64), (2, 2), (4, 3)])
def test_matches_the_search(spark, tmp_path, monkeypatch, segment, fanin):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    monkeypatch.setattr(cr, "FANIN", fanin)
    rows = _random_rows(60, segment)
    assert _op(spark, rows, tmp_path) == _model(rows)


def test_null_ids_turns_and_lost_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."),
            (5, None, "system", "S."), (5, 3, "user", "U?"), (5, 4, "assistant", "A" * 100_000)]
    want = _model(rows)
    assert _op(spark, rows, tmp_path) == want
    assert want[gone][5:] == (0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark, tmp_path):
    assert _op(spark, [], tmp_path) == {}


def test_every_short_segment():
    """All segments of up to three rows: the matrix product equals the matrix of the whole."""
    codes = [cr._code(i, f) for i in "suax" for f in (0, 1, 2)]
    for a, b, c in itertools.product(codes[:9], codes[1:11:3], codes[::4]):
        whole = cr.segment_matrix(a + b + c)
        parts = cr.multiply(cr.multiply(cr.segment_matrix(a), cr.segment_matrix(b)), cr.segment_matrix(c))
        assert list(whole) == parts


def test_repaired_rows_and_clashing_columns(spark):
    rows = [(c, t, r, x, "seg", 1, "z") for c, t, r, x in _random_rows(20, 9)]
    d = spark.createDataFrame(rows, SCHEMA + ", audit string, pos int, header string")
    report, fixed = cr.repair(d)
    want = {
        c: _best(tuple(m), tuple(_faults(m))) for c in {r[0] for r in rows}
        for m in [[(a, b, " " if e is None else e, " " if f is None else f) for a, b, e, f, *_ in rows if a == c]]}
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {c: w[:2] for c, w in want.items()}
    got = {}
    for r in fixed.orderBy("conv_id", "seq").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: list(w[2]) for c, w in want.items() if w[2]}
    roles = {c: "".join(a[0] for a, _ in v) for c, v in got.items()}
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())


def test_long_conversation_spans_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 16)
    monkeypatch.setattr(cr, "FANIN", 4)
    sys.setrecursionlimit(20_000)
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"Text {t}.") for t in range(600)]
    assert _op(spark, rows, tmp_path) == _model(rows)


def test_query_covers_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in cr.op12_conversation_repair(spark, sf).collect()}
    assert got == _model(rows)
