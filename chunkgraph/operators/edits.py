"""Line tables and line-range edits over whole corpora.

An edit is ``(key, lo, hi, block, seq)``: delete lines ``lo..hi`` (``hi`` null = delete
nothing) and put ``block`` before line ``lo`` (lines count from 1). Searches and edits run
over the line array of a file inside its row; texts move once, to meet their edits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkgraph.fixed import DOCSTRING_INDENT, QUOTES
from chunkgraph.functions import text as tx


def line_table(df: DataFrame, keys: Sequence[str], text_col: str, normalize: bool = True,
               ln_col: str = "ln", line_col: str = "line") -> DataFrame:
    """H5: one row per line. A trailing empty element after a final newline is kept, so
    ``array_join(lines, '\\n')`` gives the text back exactly."""
    t = tx.normalize_newlines(text_col) if normalize else F.col(text_col)
    return (df.select(*keys, F.posexplode(tx.split_lines(t)).alias("_pos", line_col))
              .select(*keys, (F.col("_pos") + 1).cast("int").alias(ln_col), line_col))


def _lstrip(c):
    return F.ltrim(c, F.lit(tx.PY_WS_CHARS))


def block_bounds(files: DataFrame, requests: DataFrame, keys: Sequence[str], text_col: str,
                 start_col: str = "body_start_line", indent_col: str = "func_indent",
                 normalize: bool = True) -> DataFrame:
    """L1 + A8: bounds of an existing docstring block at ``start_col`` of each request.

    The block starts there if that line, left-stripped, begins with triple quotes and the
    line begins with the function indent plus four spaces. It ends on the same line if
    the quote occurs twice there, else on the first later line that ends (stripped) with
    the same quote and starts with that indent. Output: the request columns plus
    ``doc_start``/``doc_end`` (both null unless both exist).

    The requests of a file (bounded by its definitions) meet the file's text in one join;
    the search runs over arrays in that row, against the lines that end with quotes only.
    A request without a file keeps null bounds.
    """
    keys = list(keys)
    payload = list(requests.columns)
    text = tx.normalize_newlines(text_col) if normalize else F.col(text_col)
    src = files.select(*keys, tx.split_lines(text).alias("_lines"))
    grouped = requests.groupBy(*keys).agg(
        F.collect_list(F.struct(*[F.col(c) for c in payload])).alias("_reqs"))

    def quote_at(c, where):
        test = (lambda q: c.startswith(q)) if where == "start" else (lambda q: c.endswith(q))
        return F.when(test(QUOTES[0]), F.lit(QUOTES[0])).when(test(QUOTES[1]), F.lit(QUOTES[1]))

    def closers(lines):
        return F.filter(F.transform(lines, lambda x, i: F.struct(
            (i + 1).cast("int").alias("ln"), x.alias("line"),
            F.when(tx.has_quotes(x), quote_at(tx.py_strip(x), "end")).alias("q"))),
            lambda c: c["q"].isNotNull())

    def bounds(r, lines, close):
        start = r[start_col].cast("int")
        line, exp = F.get(lines, start - 1), F.concat(r[indent_col], F.lit(DOCSTRING_INDENT))
        q = F.when(line.startswith(exp), quote_at(_lstrip(line), "start"))
        first = F.get(F.filter(close, lambda c: (c["ln"] > start) & (c["q"] == q) & c["line"].startswith(exp)),
                      F.lit(0))["ln"]
        n_quotes = F.floor((F.length(line) - F.length(F.replace(line, q, F.lit("")))) / 3)
        return F.struct(r.alias("r"), F.when(q.isNotNull(), F.when(n_quotes >= 2, start).otherwise(first)).alias("end"))

    # All of it inside the row of the file: only the requests with their bounds leave it.
    found = tx.let(F.col("_lines"), lambda lines: tx.let(closers(lines), lambda close: F.transform(
        "_reqs", lambda r: bounds(r, lines, close))))
    d = grouped.join(src, keys, "left").select(F.explode(tx.pinned(found)).alias("_f"))
    end = F.col("_f.end")
    return d.select(*[F.col("_f.r")[c].alias(c) for c in payload],
                    F.when(end.isNotNull(), F.col("_f.r")[start_col].cast("int")).alias("doc_start"),
                    end.cast("int").alias("doc_end"))


def edit_rows(bounded: DataFrame, doc_col: str, indent_col: str = "func_indent",
              start_col: str = "body_start_line", def_col: str = "line_number") -> DataFrame:
    """L2: insert at the old block's start if there is one, else at the body's first line;
    the old block (if any) is removed; the new block is H4 of the new docstring.

    ``warn_one_line`` marks definitions whose body starts on the ``def`` line itself
    (``def f(): pass``): the block is placed by the same arithmetic, which puts it above the
    definition, so such rows are worth a look before the files are written.
    """
    out = (bounded.withColumn("lo", F.coalesce("doc_start", start_col).cast("int"))
                  .withColumn("hi", F.col("doc_end").cast("int"))
                  .withColumn("block", tx.format_block(F.col(doc_col), F.col(indent_col))))
    if def_col in bounded.columns:
        out = out.withColumn("warn_one_line", F.col(start_col) <= F.col(def_col))
    return out


def edits_per_key(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edits grouped per file, in line order (bounded by the definitions in a file)."""
    return (edits.groupBy(*keys)
                 .agg(F.count(F.lit(1)).cast("long").alias("n_edits"),
                      F.sort_array(F.collect_list(F.struct("lo", "hi", "block"))).alias("edits")))


def apply_edits(files: DataFrame, edits: DataFrame, keys: Sequence[str], text_col: str,
                seq_col: str = "seq", normalize: bool = True) -> DataFrame:
    """L4 + J8: a new ``(keys, text)`` table with every edit applied in one pass.

    Edits are grouped per file (bounded by the definitions in one file) and left-joined to
    the files - the only shuffle of the texts. An edited text is put together inside its
    row: the edits in line order, each after the lines that no earlier edit has covered. A
    line is dropped when an edit's ``lo..hi`` covers it. Blocks on the same line are stacked
    with the later ``seq`` on top, as repeated insertion at one index does. Files without
    edits, and null texts, pass through untouched.
    """
    keys = list(keys)
    # A block element is the block text without its last newline: joining adds it back.
    blk = F.regexp_replace("block", "\n\\z", "")
    grouped = (edits.groupBy(*keys)
                    .agg(F.sort_array(F.collect_list(F.struct(
                        F.col("lo").cast("int").alias("lo"), (-F.col(seq_col).cast("long")).alias("o"),
                        blk.alias("block"),
                        (F.coalesce(F.col("hi"), F.col("lo") - 1) + 1).cast("int").alias("next"))))
                         .alias("_eds")))
    text = tx.normalize_newlines(text_col) if normalize else F.col(text_col)
    d = files.select(*keys, text_col).join(grouped, keys, "left")
    d = d.withColumn("_lines", F.when(F.col("_eds").isNotNull(), tx.split_lines(text)))
    # The first line that no earlier edit covers, before each edit and after the last one.
    free = F.aggregate("_eds", F.array(F.lit(1)), lambda held, e: F.concat(
        held, F.array(F.greatest(F.element_at(held, -1), F.coalesce(e["next"], F.lit(1))))))
    d = d.withColumn("_free", free)
    at = lambda i: F.get(F.col("_free"), i)
    body = F.flatten(F.transform("_eds", lambda e, i: F.concat(
        F.slice("_lines", at(i), F.greatest(e["lo"] - at(i), F.lit(0))), F.array(e["block"]))))
    end = at(F.size("_eds"))
    tail = F.slice("_lines", end, F.greatest(F.size("_lines") - end + 1, F.lit(0)))
    done = F.array_join(F.concat(body, tail), "\n")
    return d.select(*keys, F.when(F.col("_lines").isNull(), F.col(text_col)).otherwise(done)
                    .alias(text_col))
