"""Conversation structure repair: the cheapest edits that give role order ``(s?(ua)+)?``.

Per conversation, rows in order of turn (nulls first; ties by role, then by a hash of role and
text). A row's first fault counts: *blank*, *duplicate* (role and text seen earlier),
*truncated* (last character other than white space is no sentence mark). Each row is kept (0),
given the role the order needs (Rerole, 3) or deleted (4, the only choice for blank and
duplicate rows); an empty user or assistant row may be inserted anywhere (3); a truncated row
that stays adds 3. Of the cheapest edit lists the one whose letters are least wins.

Cost and letters are one integer: the high digits carry the cost, then one octal digit per
letter at its position, zeros after the last. Letters therefore compare as text does, and a
plain ``min`` over the acyclic graph of (row, role state, insertion) decides everything.

A conversation is cut into segments of at most ``SEGMENT`` rows. A segment becomes a 4 x 4
matrix (cheapest edits from each role state to each other one), matrices multiply in (min, +),
and they do so in a tree of ``FANIN`` at a time: a conversation that holds a third of all rows
is solved in many tasks, and its edits have the size of its output. Texts take no part in this;
they move once, to meet the edits of their conversation, and are then streamed in order.
The digest of a repaired conversation is a SHA-256 over its rows in order and so is made by one
task, in memory for one row and the edit letters.

Defined results: null fields are one space; a null turn comes first; rows without a
conversation id are one conversation; a conversation without rows gives zeros, no letters and
the digest of the empty text; rows that repeat are duplicates; very long texts and
conversations are no special case; an empty table gives an empty table. Only ``conv_id``,
``turn``, ``role`` and ``text`` are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.llm.common import WS_CHARS, read, release, store
from chunkgraph.session import ship_package

SEGMENT = 512
FANIN = 64
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
SENTENCE_MARKS = ".!?"

#: Role states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)
#: The speaker that Insert and Rerole give in each state, and the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Kept rows: (state, initial) -> state.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
        (ASSISTANT, "u"): USER}
SPEAKER = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

#: A row as one letter: its initial (s, u, a, other) and what its fault asks of it.
INITIALS, FREE, TRUNCATED, DELETE = "suax", 0, 1, 2

_OCTAL = str.maketrans("DIKR", "1234")
_LETTER = str.maketrans("1234", "DIKR")


# ----------------------------------------------------------------- the integer DP

def _code(initial: str, fault: int) -> str:
    return chr(97 + 3 * INITIALS.index(initial) + fault)


def _relax(values: dict, state: int, value: tuple[int, int]) -> None:
    if state not in values or value[0] < values[state][0]:
        values[state] = value


def _with_inserts(values: dict, shift: int) -> dict:
    """Up to two rows inserted here; longer insertions come back to a state at a cost."""
    for _ in range(2):
        out = dict(values)
        for q, (v, p) in values.items():
            _relax(out, NEXT[q], (v + (COST["I"] << shift) + (2 << (shift - 3 * (p + 1))), p + 1))
        values = out
    return values


def _decode(value: tuple[int, int], shift: int) -> tuple[int, str]:
    v, p = value
    digits = f"{v & ((1 << shift) - 1):o}".zfill(shift // 3)[:p]
    return v >> shift, digits.translate(_LETTER)


@lru_cache(maxsize=4096)
def segment_matrix(codes: str) -> tuple:
    """16 entries ``(cost, letters)`` or None: cheapest edits from state i // 4 to i % 4."""
    shift = 3 * (3 * len(codes) + 2)
    rows = [(INITIALS[(ord(c) - 97) // 3], (ord(c) - 97) % 3) for c in codes]
    out: list = []
    for start in range(4):
        values = _with_inserts({start: (0, 0)}, shift)
        for initial, fault in rows:
            stay = TRUNCATED_COST << shift if fault == TRUNCATED else 0
            after: dict = {}
            for q, (v, p) in values.items():
                at = shift - 3 * (p + 1)
                _relax(after, q, (v + (COST["D"] << shift) + (1 << at), p + 1))
                if fault == DELETE:
                    continue
                if (q, initial) in KEEP:
                    _relax(after, KEEP[q, initial], (v + stay + (3 << at), p + 1))
                _relax(after, NEXT[q], (v + stay + (COST["R"] << shift) + (4 << at), p + 1))
            values = _with_inserts(after, shift)
        out += [_decode(values[q], shift) if q in values else None for q in range(4)]
    return tuple(out)


def _scalar(cost: int, letters: str, width: int) -> int:
    digits = letters.translate(_OCTAL).ljust(width, "0")
    return (cost << 3 * width) | (int(digits, 8) if width else 0)


def multiply(a, b) -> list:
    """Edits of two neighbouring segments as one."""
    width = max((len(x[1]) for x in a if x), default=0) + max((len(x[1]) for x in b if x), default=0)
    out: list = []
    for i in range(4):
        for j in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for k in range(4)
                    if (x := a[4 * i + k]) and (y := b[4 * k + j])]
            out.append(min(ways, key=lambda w: _scalar(*w, width)) if ways else None)
    return out


def best(matrix) -> tuple[int, str]:
    """Cheapest edits of a whole conversation."""
    ways = [w for q in ACCEPT if (w := matrix[4 * START + q])]
    width = max(len(w[1]) for w in ways)
    return min(ways, key=lambda w: _scalar(*w, width))


# ----------------------------------------------------------------- rows and their faults

def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by a hash of ``conv_id:turn``: dropped rows, empty texts, lost sentence
    marks, repeated rows, users in place of other speakers."""
    name = F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))
    kind = F.crc32(name.cast("binary")) % 20
    d = conversations.select("conv_id", "turn", kind.alias("kind"), _or_space(F.col("role")).alias("role"),
                             _or_space(F.col("text")).alias("text")).where("kind <> 0")
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(
        "text", SENTENCE_MARKS, "")).otherwise(F.col("text")))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(
        F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    ).drop("_copy")


def _rows(conversations: DataFrame) -> DataFrame:
    """The four columns with their keys: two hashes of (role, text)."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text")
    ).select("*", F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", "role").alias("k2"))


ORDER = ("conv_id", "turn", "role", "k1", "k2")


def row_faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn, initial, fault)`` of :func:`_rows`, stored in order of ``pos``."""
    bare = F.rtrim("text", F.lit(WS_CHARS))
    last = F.substring(bare, -1, 1)
    initial = F.substring("role", 1, 1)
    facts = rows.select(
        *ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (bare == "").alias("blank"), (~last.isin(*SENTENCE_MARKS)).alias("truncated"))
    ordered = (facts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
                    .withColumn("pos", F.monotonically_increasing_id()).drop("role"))
    ordered = store(ordered, "conversation-rows")
    repeated = (ordered.groupBy("conv_id", "k1", "k2")
                       .agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
                       .where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("k1").alias("_k1"),
                                               F.col("k2").alias("_k2"), "_first"))
    cond = (ordered["conv_id"].eqNullSafe(repeated["_c"]) & (ordered["k1"] == repeated["_k1"])
            & (ordered["k2"] == repeated["_k2"]))
    fault = (F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("_first"), "duplicate")
             .when(F.col("truncated"), "truncated"))
    return ordered.join(repeated, cond, "left").select("conv_id", "pos", "turn", "initial",
                                                       fault.alias("fault"))


# ----------------------------------------------------------------- segments and their tree

_SEGMENT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("seg", T.LongType()),
    T.StructField("ends", T.StringType()),               # first and last initial
    T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),  # turns
    T.StructField("turns", T.LongType()), T.StructField("blank", T.LongType()),
    T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()),
    T.StructField("illegal", T.LongType()),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("letters", T.ArrayType(T.StringType()))])
_ARROW = pa.schema([(f.name, {"conv_id": pa.int64(), "ends": pa.string(), "costs": pa.list_(pa.int64()),
                              "letters": pa.list_(pa.string())}.get(f.name, pa.int64())) for f in _SEGMENT])
_SUMS = ("turns", "blank", "duplicate", "truncated", "illegal")


def _matrix_columns(matrix) -> dict:
    return {"costs": [x and x[0] for x in matrix], "letters": [x and x[1] for x in matrix]}


def _matrix_of(row: dict) -> list:
    return [None if t is None else (c, t) for c, t in zip(row["costs"], row["letters"])]


def _solve_segments(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            initials = [INITIALS[(ord(c) - 97) // 3] for c in r["codes"]]
            r["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            r["ends"] = initials[0] + initials[-1]
            r |= _matrix_columns(segment_matrix(r.pop("codes")))
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    segment_matrix.cache_clear()
    release()


def _merge_two(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in _SUMS}
    out["illegal"] += a["ends"][1] + b["ends"][0] not in LEGAL
    # A turn on both sides of the cut is one turn; null turns come first and are not counted.
    out["turns"] -= a["hi"] is not None and a["hi"] == b["lo"]
    out["lo"] = b["lo"] if a["lo"] is None else a["lo"]
    out["hi"] = a["hi"] if b["hi"] is None else b["hi"]
    out["ends"] = a["ends"][0] + b["ends"][1]
    out["matrix"] = multiply(a["matrix"], b["matrix"])
    return out


def _merge_segments(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = [p | {"matrix": _matrix_of(p)} for p in r["parts"]]
            while len(parts) > 1:
                parts = [_merge_two(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i]
                         for i in range(0, len(parts), 2)]
            top = parts[0]
            out.append({k: top.get(k) for k in _ARROW.names}
                       | {"conv_id": r["conv_id"], "seg": r["seg"]} | _matrix_columns(top["matrix"]))
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    release()


def segments(faults: DataFrame) -> DataFrame:
    """One row per segment: its counts and its matrix. ``seg`` numbers a conversation's
    segments from 0; a group holds at most ``SEGMENT`` rows."""
    fault = (F.when(F.col("fault").isin("blank", "duplicate"), DELETE)
             .when(F.col("fault") == "truncated", TRUNCATED).otherwise(FREE))
    at = F.expr(f"instr('{INITIALS}', initial)")
    code = F.chr((F.lit(97) + 3 * (at - 1) + fault).cast("long"))
    rows = faults.select("conv_id", F.shiftright("pos", SEGMENT.bit_length() - 1).alias("seg"), "pos", "turn",
                         "fault", code.alias("code"))
    held = F.array_sort(F.collect_list(F.struct("pos", "code")))
    grouped = rows.groupBy("conv_id", "seg").agg(
        F.array_join(F.transform(held, lambda x: x["code"]), "").alias("codes"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        F.size(F.collect_set("turn")).cast("long").alias("turns"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")])
    order = Window.partitionBy("conv_id").orderBy("seg")
    grouped = grouped.withColumn("seg", (F.row_number().over(order) - 1).cast("long"))
    return grouped.mapInArrow(_solve_segments, _SEGMENT)


def solve(faults: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per conversation."""
    level = store(segments(faults), "conversation-segments")
    most = (level.agg(F.max("seg").alias("m")).first().m or 0) + 1
    while most > 1:
        parts = [f.name for f in _SEGMENT if f.name not in ("conv_id", "seg")]
        grouped = level.groupBy("conv_id", F.floor(F.col("seg") / FANIN).alias("seg")).agg(
            F.array_sort(F.collect_list(F.struct("seg", *parts))).alias("parts"))
        level, most = grouped.mapInArrow(_merge_segments, _SEGMENT), -(-most // FANIN)
    return level.mapInArrow(_finish, "conv_id long, gaps long, blank long, duplicate long, "
                            "truncated long, illegal long, cost long, audit string")


def _finish(batches):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit = best(_matrix_of(r))
            gaps = 0 if r["lo"] is None else r["hi"] - r["lo"] + 1 - r["turns"]
            out.append({k: r.get(k) for k in names} | {"gaps": gaps, "cost": cost, "audit": audit})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# ----------------------------------------------------------------- applying the edits

class _Replay:
    """Walks a conversation's letters along its rows; gives the repaired (role, text) rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield SPEAKER[self.state], ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield SPEAKER[self.state], text


def _stream(batches):
    """(conv_id, rows) as (header or row) records in order; a header opens a conversation."""
    for batch in batches:
        cols = [batch.column(i) for i in range(5)]
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in cols]


def _repair_stream(batches):
    out, held, replay, conv, n = [], 0, None, None, 0
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()),
                        ("text", pa.string())])

    def put(found):
        nonlocal n, held
        for role, text in found:
            out.append({"conv_id": conv, "seq": n, "role": role, "text": text})
            held += len(text) + 64
            n += 1

    for c, header, audit, role, text in _stream(batches):
        if header:
            if replay:
                put(replay.inserted())
            conv, replay, n = c, _Replay(audit or ""), 0
        else:
            put(replay.row(role, text))
        if held >= 1 << 22:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if replay:
        put(replay.inserted())
    yield pa.RecordBatch.from_pylist(out, schema=schema)
    release()


def _digest_stream(batches):
    out, replay, sha, conv, some = [], None, None, None, False
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def feed(found):
        nonlocal some
        for role, text in found:
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True

    def close():
        feed(replay.inserted())
        out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})

    for c, header, audit, role, text in _stream(batches):
        if header:
            if replay:
                close()
            conv, replay, sha, some = c, _Replay(audit or ""), hashlib.sha256(), False
        else:
            feed(replay.row(role, text))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if replay:
        close()
    yield pa.RecordBatch.from_pylist(out, schema=schema)
    release()


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation after a header row with its letters."""
    head = audits.select("conv_id", F.lit(True).alias("header"), "audit",
                         *[F.lit(None).cast(t).alias(c) for c, t in
                           (("role", "string"), ("text", "string"), ("turn", "long"), ("k1", "long"), ("k2", "long"))])
    body = rows.select("conv_id", F.lit(False).alias("header"), F.lit(None).cast("string").alias("audit"),
                       "role", "text", "turn", "k1", "k2")
    both = head.unionByName(body).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("header").desc(), "turn", "role", "k1", "k2")
    return both.select("conv_id", "header", "audit", "role", "text")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, repaired)``: counts, cost and edit letters of every conversation, and the
    repaired rows ``(conv_id, seq, role, text)``."""
    ship_package(conversations.sparkSession)
    rows = _rows(conversations)
    report = solve(row_faults(rows))
    return report, _in_order(rows, report).mapInArrow(
        _repair_stream, "conv_id long, seq long, role string, text string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage planted in every conversation, found and repaired; one row per conversation."""
    ship_package(spark)
    conversations = read(spark, sf_dir, "conversations")
    rows = _rows(damage(conversations))
    solved = solve(row_faults(rows)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = store(every.join(solved, every["conv_id"].eqNullSafe(solved["_conv"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit")), "conversation-report")
    digests = _in_order(rows, report).mapInArrow(_digest_stream, "_conv long, repaired_sha256 string")
    return report.join(digests, report["conv_id"].eqNullSafe(digests["_conv"])).drop("_conv")
