"""Line-range edits for files larger than a row (J8, L4, A8, L1 over line blocks).

A file is rows ``(keys, block_no, text)`` of ``size`` lines each (the last one may be shorter),
newlines normalised. Edits meet the blocks by an equi-join on the block numbers that their line
range covers; inside a block, one sweep over its edits in order finds the lines that an earlier
edit covers. The search for a docstring's end is a sweep over the lines that end with quotes and
the requests of a file, from the bottom up. No task holds a file: a block, its edits, or one
sorted stream of closing lines is all it sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkgraph.fixed import DOCSTRING_INDENT, QUOTES
from chunkgraph.functions import text as tx

BLOCK_LINES = 4096


def cut_blocks(files: DataFrame, keys: Sequence[str], text_col: str, size: int = BLOCK_LINES) -> DataFrame:
    """``(keys, block_no, text)`` of files that are one row each; null texts give no block."""
    lines = tx.split_lines(tx.normalize_newlines(text_col))
    parts = tx.let(lines, lambda a: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")),
        lambda i: F.array_join(F.slice(a, i * size + 1, size), "\n")))
    return files.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode(parts).alias("block_no", "text"))


def join_blocks(blocks: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Whole files again (they must fit a row then); blocks without a line are null."""
    pair = F.struct(F.col("block_no").alias("k"), F.col("text").alias("v"))
    return blocks.where("text IS NOT NULL").groupBy(*keys).agg(
        tx.ordered_join(F.collect_list(pair), "\n").alias(text_col))


def _block_of(line: Column, size: int) -> Column:
    return F.floor((line - 1) / size).cast("int")


def _quotes_at(c: Column, end: bool) -> Column:
    test = c.endswith if end else c.startswith
    return F.when(test(QUOTES[0]), F.lit(QUOTES[0])).when(test(QUOTES[1]), F.lit(QUOTES[1]))


def block_bounds_blocked(blocks: DataFrame, requests: DataFrame, keys: Sequence[str], size: int = BLOCK_LINES,
                         start_col: str = "body_start_line", indent_col: str = "func_indent") -> DataFrame:
    """L1 + A8, as :func:`chunkgraph.operators.edits.block_bounds`: the requests (any number per
    file) with ``doc_start`` and ``doc_end``. Requests need not be distinct."""
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in requests.columns])
    asked = requests.select(*keys, payload.alias("_r"), F.col(start_col).cast("int").alias("_start"),
                            F.concat(F.col(indent_col), F.lit(DOCSTRING_INDENT)).alias("_exp"))
    asked = asked.withColumn("block_no", _block_of(F.col("_start"), size))
    # The line each request looks at, without the rest of its block.
    line = F.get(tx.split_lines("text"), (F.col("_start") - 1) % size)
    opened = asked.join(blocks, [*keys, "block_no"], "left").select(*keys, "_r", "_start", "_exp", line.alias("_l"))
    q = F.when(F.col("_l").startswith(F.col("_exp")), _quotes_at(F.ltrim(F.col("_l"), F.lit(tx.PY_WS_CHARS)), False))
    opened = opened.withColumn("_q", q)
    count = F.floor((F.length("_l") - F.length(F.replace(F.col("_l"), F.col("_q"), F.lit("")))) / 3)
    same = F.coalesce((count >= 2) & F.col("_q").isNotNull(), F.lit(False))
    # Closing lines, once for every indent they satisfy (the prefixes of their own white space).
    closing = blocks.where(tx.has_quotes("text")).select(
        *keys, "block_no", F.posexplode(tx.split_lines("text")).alias("_i", "_l")).where(tx.has_quotes("_l"))
    closing = closing.withColumn("_q", _quotes_at(tx.py_strip(F.col("_l")), True)).where("_q IS NOT NULL")
    margin = tx.indentation("_l")
    closing = closing.select(
        *keys, "_q", (F.col("block_no") * size + F.col("_i") + 1).cast("int").alias("_ln"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length(margin)), lambda n: F.substring(margin, 1, n))).alias("_exp"))
    none = F.lit(None)
    events = opened.where(F.col("_q").isNotNull() & ~same).select(
        *keys, "_q", "_exp", F.col("_start").alias("_ln"), F.lit(0).alias("_kind"), "_r").unionByName(
        closing.select(*keys, "_q", "_exp", "_ln", F.lit(1).alias("_kind"),
                       none.cast(requests.select(payload.alias("_r")).schema["_r"].dataType).alias("_r")))
    # From the bottom up, the nearest closing line below a request is the least one seen so far.
    below = Window.partitionBy(*keys, "_q", "_exp").orderBy(F.col("_ln").desc(), "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("_end", F.min(F.when(F.col("_kind") == 1, F.col("_ln"))).over(below)).where("_kind = 0")
    direct = opened.where(F.col("_q").isNull() | same).select("_r", F.when(same, F.col("_start")).alias("_end"))
    found = direct.unionByName(swept.select("_r", "_end"))
    return found.select(*[F.col("_r")[c].alias(c) for c in requests.columns],
                        F.when(F.col("_end").isNotNull(), F.col("_r")[start_col].cast("int")).alias("doc_start"),
                        F.col("_end").cast("int").alias("doc_end"))


def apply_edits_blocked(blocks: DataFrame, edits: DataFrame, keys: Sequence[str], size: int = BLOCK_LINES,
                        seq_col: str = "seq") -> DataFrame:
    """L4 + J8, as :func:`chunkgraph.operators.edits.apply_edits`: the blocks with every edit
    applied; ``text`` is null where no line is left. Blocks no edit touches pass as they are."""
    keys = list(keys)
    last = blocks.groupBy(*keys).agg(F.max("block_no").alias("_last"))
    e = edits.select(*keys, F.col("lo").cast("int").alias("lo"), (-F.col(seq_col).cast("long")).alias("o"),
                     F.regexp_replace("block", "\n\\z", "").alias("block"),
                     (F.coalesce(F.col("hi"), F.col("lo") - 1) + 1).cast("int").alias("next")).join(last, keys)
    home = F.least(_block_of(F.col("lo"), size), F.col("_last"))
    # An edit goes to the block it inserts into and to those whose lines it covers.
    reach = F.least(F.greatest(_block_of(F.col("next") - 1, size), home), F.col("_last"))
    e = e.withColumn("_home", home).withColumn("block_no", F.explode(F.sequence(F.col("_home"), reach)))
    text = F.when(F.col("block_no") == F.col("_home"), F.col("block"))
    held = e.groupBy(*keys, "block_no").agg(F.sort_array(F.collect_list(F.struct(
        "lo", "o", text.alias("block"), "next"))).alias("_eds"))
    d = blocks.join(held, [*keys, "block_no"], "left")
    first = F.col("block_no") * size + 1
    d = d.withColumn("_lines", F.when(F.col("_eds").isNotNull(), tx.split_lines("text")))
    # The first line of the block that no earlier edit covers, before each edit and after the last.
    free = F.aggregate("_eds", F.array(first), lambda a, x: F.concat(
        a, F.array(F.greatest(F.element_at(a, -1), x["next"]))))
    d = d.withColumn("_free", free)

    def lines(lo: Column, hi: Column) -> Column:
        """Lines ``lo`` to ``hi - 1`` of the file, as far as they are in the block."""
        return F.slice("_lines", lo - first + 1, F.greatest(hi - lo, F.lit(0)))

    body = F.flatten(F.transform("_eds", lambda x, i: F.concat(
        lines(F.get("_free", i), x["lo"]), F.when(x["block"].isNotNull(), F.array(x["block"]))
        .otherwise(F.array().cast("array<string>")))))
    end = F.get("_free", F.size("_eds"))
    left = F.concat(body, lines(end, F.greatest(end, first + F.size("_lines"))))
    done = F.when(F.size(left) > 0, F.array_join(left, "\n"))
    return d.select(*keys, "block_no", F.when(F.col("_eds").isNull(), F.col("text")).otherwise(done).alias("text"))
