"""Split long chunk text into overlapping pieces; metadata is copied to each piece.

X4 is the structure-aware splitter: the separators are tried in order (class header, def
header, tab-indented def, blank line, newline, space, any character). At each level the
texts that are still too long are cut before every occurrence of the separator; runs of
short cuts are packed greedily into pieces of at most ``size`` characters that overlap by
at most ``overlap``, and cuts that are still too long go on to the next level. It is one
column expression per level over an array of texts; no row leaves the JVM.

X4a is the terminal case on its own: fixed windows of ``size`` characters stepping by
``size - overlap`` (``sequence`` + ``substring`` + ``posexplode``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkgraph.fixed import CHUNK_OVERLAP, CHUNK_SIZE, PYTHON_SEPARATORS
from chunkgraph.functions import text as tx

_ITEMS = "array<struct<text: string, open: boolean>>"
_SPANS = "array<struct<lo: int, hi: int, open: boolean>>"


def _cuts(text: Column, sep: str) -> Column:
    """Cuts of ``text``, each starting with the separator it was cut before."""
    if sep == "":
        parts = F.split(text, "")
    else:
        parts = F.transform(F.split(text, re.escape(sep), -1), lambda p, i: F.when(i == 0, p)
                            .otherwise(F.concat(F.lit(sep), p)))
    return F.filter(parts, lambda p: p != "")


def _span(lo: Column, hi: Column, is_open: bool) -> Column:
    return F.array(F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(is_open).alias("open")))


def _tail(held: Column, room: Column) -> Column:
    """``(n, sum)`` of the longest end of the held cuts of at most ``room`` characters."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("go"))

    def step(s, c):
        fits = s["go"] & (s["sum"] + F.length(c) <= room)
        return F.struct(F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"),
                        F.when(fits, s["sum"] + F.length(c)).otherwise(s["sum"]).alias("sum"),
                        fits.alias("go"))
    return F.aggregate(F.reverse(held), start, step)


def _spans(cuts: Column, size: int, overlap: int) -> Column:
    """Index ranges of ``cuts``: runs of short cuts packed greedily, long cuts on their own.

    The state is the finished ranges, the first cut held, the characters held and the
    number of the next cut.
    """
    def closed(s):
        return F.when(s["lo"] < s["i"], F.concat(s["out"], _span(s["lo"], s["i"], False))).otherwise(s["out"])

    def state(out, lo, total, i):
        return F.struct(out.alias("out"), lo.alias("lo"), total.alias("total"), i.alias("i"))

    def step(s, cut):
        n, after = F.length(cut), s["i"] + 1
        held = F.slice(cuts, s["lo"] + 1, s["i"] - s["lo"])
        full = tx.let(_tail(held, F.least(F.lit(overlap), F.lit(size) - n)), lambda t: state(
            closed(s), s["i"] - t["n"], t["sum"] + n, after))
        return (F.when(n >= size, state(F.concat(closed(s), _span(s["i"], after, True)), after, F.lit(0), after))
                 .when((s["lo"] < s["i"]) & (s["total"] + n > size), full)
                 .otherwise(state(s["out"], s["lo"], s["total"] + n, after)))

    start = state(F.array().cast(_SPANS), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(cuts, start, step, closed)


def _pack(cuts: Column, size: int, overlap: int) -> Column:
    """The pieces of packed short cuts (stripped, blank ones dropped) and the long cuts."""
    texts = F.transform(_spans(cuts, size, overlap), lambda r: F.struct(
        F.when(r["open"], F.get(cuts, r["lo"])).otherwise(tx.py_strip(F.array_join(
            F.slice(cuts, r["lo"] + 1, r["hi"] - r["lo"]), ""))).alias("text"), r["open"].alias("open")))
    return F.filter(texts, lambda x: x["text"] != "")


def _char_windows(text: Column, size: int, overlap: int) -> Column:
    """The last level, any character, in closed form: greedy packing of single characters gives
    windows of ``size`` that share as much as the overlap and one new character allow."""
    step = size - min(overlap, size - 1)
    more = F.ceil(F.when(F.length(text) > size, F.length(text) - size).when(text.isNotNull(), 0) / step)
    starts = F.sequence(F.lit(0), (more * step).cast("int"), F.lit(step))
    pieces = F.transform(starts, lambda s: F.struct(
        tx.py_strip(F.substring(text, s + 1, size)).alias("text"), F.lit(False).alias("open")))
    return F.filter(pieces, lambda x: x["text"] != "")


def split_levels(df: DataFrame, content_col: str, out_col: str, size: int = CHUNK_SIZE,
                 overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = PYTHON_SEPARATORS) -> DataFrame:
    """``df`` with the pieces of ``content_col`` as the array ``out_col`` (null text: null)."""
    if overlap > size:
        raise ValueError("overlap must not exceed size")
    c = F.col(content_col)
    bare = tx.py_strip(c)
    item = lambda t, o: F.array(F.struct(t.alias("text"), F.lit(o).alias("open")))
    whole = F.when(bare == "", F.array().cast(_ITEMS)).otherwise(item(bare, False))
    d = df.withColumn(out_col, F.when(F.length(c) < size, whole).otherwise(item(c, True)))
    for sep in separators:
        def cut(item, sep=sep):
            if sep == "" and size > 1:
                return F.when(item["open"], _char_windows(item["text"], size, overlap)).otherwise(F.array(item))
            return F.when(item["open"] & (F.lit(True) if sep == "" else item["text"].contains(sep)),
                          tx.let(_cuts(item["text"], sep), lambda cuts: _pack(cuts, size, overlap))
                          ).otherwise(F.array(item))
        some = F.exists(out_col, lambda item: item["open"])
        level = F.flatten(F.transform(out_col, lambda item: cut(item)))
        d = d.withColumn(out_col, F.when(some, level).otherwise(F.col(out_col)))
    return d.withColumn(out_col, tx.pinned(F.transform(out_col, lambda item: item["text"])))


def split_pieces(df: DataFrame, content_col: str = "content", size: int = CHUNK_SIZE,
                 overlap: int = CHUNK_OVERLAP, piece_col: str = "piece_no") -> DataFrame:
    """One row per piece; every other column is copied. Empty text yields no piece."""
    others = [c for c in df.columns if c != content_col]
    d = split_levels(df, content_col, "_pieces", size, overlap)
    return d.select(*others, F.posexplode("_pieces").alias(piece_col, content_col)).select(
        *df.columns, piece_col)


def fixed_windows(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, consecutive windows sharing ``overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    t = F.col(text) if isinstance(text, str) else text
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - F.lit(overlap + 1), F.lit(0)),
                        F.lit(step))
    return F.transform(starts, lambda s: F.substring(t, s + 1, size))


def window_pieces(df: DataFrame, text_col: str, size: int = CHUNK_SIZE,
                  overlap: int = CHUNK_OVERLAP, piece_col: str = "piece_no",
                  out_col: str = "piece") -> DataFrame:
    """X4a as rows: ``(..., piece_no, piece)``; empty text yields no piece."""
    others = [c for c in df.columns if c != text_col]
    return (df.select(*others, F.posexplode(fixed_windows(text_col, size, overlap))
                      .alias(piece_col, out_col))
              .where(F.length(out_col) > 0))
