"""Mixing sources to target weights, with DataFrame functions only.

Token shares p of the sources are raised to an exponent a and normalised: w ~ p^a. The
exponent is found by repeated section: the largest a whose entropy is still at least the
target, or the smallest a at which no source is repeated more often than the limit. An a
above 1 is wanted where the shares are more even than the target: it makes them less even,
and the larger sources are then the repeated ones. The limit bounds a on both sides of 1 and
prevails over the target. Where no exponent brings the entropy down to the target (equal
sources), the plain shares stay. The
weights are then realised as budgeted block permutations: a source gets ``w * budget``
tokens, that is some full passes over its documents and the start of one more. Every pass
takes the blocks of the source (about sqrt(n) blocks of sqrt(n) documents, fixed by hash) in
a new order, and the documents of a block in a new order. ``position`` in [0, 1) is how much
of its source's budget comes before a document; sorting by it mixes the sources evenly.

Without a budget the smallest one is taken that leaves no document out. With a budget, the
last pass of a source ends with the document that reaches it.

Defined results: a null source is a source of its own; null and empty texts have no tokens
and come with each full pass; a source without any tokens costs nothing and comes once;
repeated rows are rows of their own; very long texts count like any other; equal positions fall
where a source begins a pass; an empty table gives an empty table. Columns of the
input that bear the name of an output column are replaced; no other name matters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkgraph.llm.common import WS_RUN, packed, read, store, unpacked

#: Exponents tried per round and rounds: the interval shrinks by 32 each time.
SECTIONS, ROUNDS = 32, 5
#: Exponents above 1 are bracketed by powers of two; shares that differ by less than a part in
#: the largest of them count as equal.
POWERS = [float(1 << i) for i in range(32)]
#: A per-source table of at most this many rows may be broadcast.
BROADCAST_SOURCES = 10_000
ENTROPY_SHARE = 0.95
MAX_REPEAT = 4.0
ADDED = ("n_tokens", "weight", "epoch", "block", "position")


def token_count(text) -> F.Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WS_RUN.replace("[", "[^"))), F.lit(0)).cast("long")


def source_stats(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """``(source, n_docs, tokens, p)``, stored: one row per source."""
    return _stats(docs.select(F.col(source_col).alias("source"),
                              token_count(F.col(text_col)).alias("n_tokens")))


def _stats(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum("n_tokens").alias("tokens"))
    per = store(per, "mix-sources")
    total = per.agg(F.sum("tokens").alias("t")).first().t or 0
    return per.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))


def _measures(stats: DataFrame, exponents: list[float], budget: float | None) -> list:
    """Entropy and largest repetition at each exponent; one row per exponent comes back."""
    exponents = sorted(set(exponents))  # an exponent given twice would count each source twice
    t = stats.where("tokens > 0").withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    t = t.withColumn("l", F.col("a") * F.col("log_p"))
    # repetition of a source: w * budget / tokens, with w = p^a / z; as a logarithm
    t = t.withColumn("r", F.col("l") - F.log("tokens"))
    g = t.groupBy("a").agg(F.sum(F.exp("l")).alias("z"), F.sum(F.exp("l") * F.col("l")).alias("s"),
                           F.max("r").alias("hi"), F.min("r").alias("lo"))
    repeat = (F.exp(F.least(F.col("hi") - F.col("lo"), F.lit(700.0))) if budget is None
              else F.exp("hi") / F.col("z") * budget)
    return g.select("a", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"),
                    repeat.alias("repeat")).orderBy("a").collect()


def _section(stats, budget, lo: float, hi: float, holds_below: bool, ok) -> float:
    """The end of the exponents in [lo, hi] for which ``ok(row)`` holds, to within the last
    section; they are those below it (``holds_below``) or above it."""
    for _ in range(ROUNDS):
        rows = _measures(stats, [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS)] + [hi], budget)
        good = [r.a for r in rows if ok(r)]
        if not good:
            return lo if holds_below else hi
        step = (hi - lo) / SECTIONS
        lo, hi = ((good[-1], min(hi, good[-1] + step)) if holds_below
                  else (max(lo, good[0] - step), good[0]))
        if lo == hi:
            break
    return lo if holds_below else hi


def exponent(stats: DataFrame, target_entropy: float | None = None,
             max_repeat: float | None = None, budget: float | None = None) -> float:
    """The exponent that meets the target entropy (nats), or the repetition limit, or both
    (then the limit prevails); 1.0, the plain shares, without either."""
    slack = 1e-9
    a = 1.0
    # Relative to the largest share, so that no power of it is lost to underflow.
    top = stats.agg(F.max("p").alias("p")).first().p
    if not top:
        return a
    stats = stats.withColumn("log_p", F.when(F.col("tokens") > 0, F.log(F.col("p") / F.lit(top))))
    if target_entropy is not None:
        def even(r):
            return r.entropy >= target_entropy - slack

        first = next((r.a for r in _measures(stats, POWERS, budget) if not even(r)), None)
        if first is not None:
            a = _section(stats, budget, first / 2 if first > 1 else 0.0, first, True, even)
    if max_repeat is not None:
        def within(r):
            return r.repeat <= max_repeat

        # Repetition is least at 1 and grows to both sides of it.
        if target_entropy is not None and a > 1:
            a = _section(stats, budget, 1.0, a, True, within)
        else:
            least = _section(stats, budget, 0.0, 1.0, False, within)
            a = max(a, least) if target_entropy is not None else least
    return a


def source_plan(stats: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """``(source, n_blocks, tokens, weight, quota, full, rest)`` per source."""
    t = stats.withColumn("u", F.when(F.col("tokens") > 0, F.pow("p", F.lit(a))).otherwise(F.lit(0.0)))
    row = t.agg(F.sum("u").alias("z"), F.max(F.when(F.col("u") > 0, F.col("tokens") / F.col("u")))
                .alias("b")).first()
    z = row.z or 1.0
    tokens_in_all = budget if budget is not None else (row.b or 0.0) * z
    t = t.withColumn("weight", F.col("u") / z)
    t = t.withColumn("quota", F.round(F.col("weight") * tokens_in_all).cast("long"))
    has = F.col("tokens") > 0
    return t.select(
        "source", F.ceil(F.sqrt("n_docs")).cast("long").alias("n_blocks"), "tokens", "weight", "quota",
        F.when(has, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).alias("full"),
        F.when(has, F.col("quota") % F.col("tokens")).otherwise(F.lit(0)).alias("rest"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", target_entropy: float | None = None,
                entropy_share: float | None = None, max_repeat: float | None = None,
                budget: float | None = None, seed: int = 42) -> DataFrame:
    """``docs`` repeated or cut to the target weights, plus ``n_tokens``, ``weight`` (of the
    source), ``epoch`` (pass number), ``block`` and ``position``.

    ``entropy_share`` gives the target as a share of the largest possible entropy.
    """
    # Rows are known by a hash of all their values, equal rows also by a number; the schedule
    # is made on that key alone and meets the rows, with their texts, in one join.
    kept = [c for c in docs.columns if c not in ADDED]
    twin = F.row_number().over(Window.partitionBy("_k").orderBy("_k"))
    keyed = packed(docs, _k=F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kept]))
    lean = store(docs.select(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kept]).alias("_k"),
                             F.col(source_col).alias("source"),
                             token_count(F.col(text_col)).alias("n_tokens")), "mix-rows")
    stats = _stats(lean)
    if entropy_share is not None:
        target_entropy = entropy_share * math.log(max(1, stats.where("tokens > 0").count()))
    plan = source_plan(stats, exponent(stats, target_entropy, max_repeat, budget), budget)
    schedule = _schedule(lean.withColumn("_twin", twin), plan, stats.count(), seed)
    return unpacked(keyed.withColumn("_twin", twin).join(schedule, ["_k", "_twin"]), docs.columns, ADDED)


def _schedule(rows: DataFrame, plan: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """``(_k, _twin)`` with the columns :data:`ADDED`: one row for each time a row is taken."""
    by_source = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    d = rows.join(by_source.withColumnRenamed("source", "of"),
                  F.col("source").eqNullSafe(F.col("of"))).drop("of")
    d = d.withColumn("block", F.pmod("_k", "n_blocks"))
    # Blocks are the same in every pass, only their order changes: their sums are taken once.
    blocks = d.groupBy("source", "block").agg(
        F.sum("n_tokens").alias("held"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    passes = F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1))
    some = (F.col("full") > 0) | (F.col("rest") > 0)
    order = Window.partitionBy("source", "epoch").orderBy(
        F.xxhash64(F.lit(seed), "source", "epoch", "block"), "block")
    offsets = (blocks.where(some).withColumn("epoch", F.explode(passes))
               .select("source", "epoch", "block",
                       (F.sum("held").over(order) - F.col("held")).alias("before")))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(
        F.xxhash64(F.lit(seed), "epoch", "_k"), "_k", "_twin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    d = d.where(some).withColumn("epoch", F.explode(passes))
    d = d.withColumn("at", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    o = offsets.select(F.col("source").alias("s2"), F.col("epoch").alias("e2"),
                       F.col("block").alias("b2"), "before")
    d = d.join(o, F.col("source").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2"))
               & (F.col("block") == F.col("b2")))
    start = F.col("before") + F.col("at")
    d = d.where((F.col("epoch") < F.col("full")) | (start < F.col("rest")))
    position = F.when(F.col("quota") > 0, (F.col("epoch") * F.col("tokens") + start)
                      / F.col("quota")).otherwise(F.lit(0.0))
    return d.select("_k", "_twin", "n_tokens", "weight", "epoch", "block", position.alias("position"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of the whole table at 95 % of the largest entropy, at most four passes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix_sources(docs, entropy_share=ENTROPY_SHARE, max_repeat=MAX_REPEAT)
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")
