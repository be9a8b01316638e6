"""Line tables, text functions and line-range edits bound to the driver's tables.

* ``documents`` -> line tables, slices, formatted docstring blocks;
* ``conversations`` -> free-text answers wrapped the ways a model wraps them, cleaned;
* the synthetic corpus (see :mod:`chunkgraph.plans.corpus`) -> docstring block bounds,
  edit rows, and every file rewritten with a new docstring for every definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.functions import text as tx
from chunkgraph.operators import edit_blocks, edits, extract, rank
from chunkgraph.plans.corpus import sc_files
from chunkgraph.plans.index_build import build_index
from chunkgraph.plans.rewrite import rewrite_corpus
from chunkgraph.session import store
from chunkgraph.sources.tables import read_table


def q_line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return edits.line_table(docs, ["doc_id"], "text")


def q_line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: every document without its first and last line."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    arr = tx.split_lines(tx.normalize_newlines("text"))
    n = F.size(arr)
    return docs.select("doc_id", F.size(arr).cast("long").alias("n_lines"),
                       tx.slice_join(arr, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("body"))


def q_line_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 over every line of every document, set in by 0, 4 or 8 more spaces."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = edits.line_table(docs, ["doc_id"], "text")
    ind = tx.indentation(F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3 * 4).cast("int")), "line"))
    return lines.select("doc_id", "ln", ind.alias("indent")).select(
        "*", F.length("indent").cast("long").alias("indent_len"))


def q_format_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: every document formatted as a docstring block at indent 0, 4 or 8."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    indent = F.repeat(F.lit(" "), (F.col("doc_id") % 3 * 4).cast("int"))
    return docs.select("doc_id", tx.format_block(F.col("text"), indent).alias("block"))


def wrapped_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns wrapped as model answers tend to be: in triple double quotes, in
    a python code fence, in triple single quotes with chatter around, or padded."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = F.col("text")
    style = (F.col("conv_id") + F.col("turn")) % 4
    raw = (F.when(style == 0, F.concat(F.lit('"""'), t, F.lit('"""')))
           .when(style == 1, F.concat(F.lit("```python\n"), t, F.lit("\n```")))
           .when(style == 2, F.concat(F.lit("Here it is: '''"), t, F.lit("''' done")))
           .otherwise(F.concat(F.lit("  "), t, F.lit(" \n"))))
    return conv.select("conv_id", "turn", raw.alias("raw"))


def q_clean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 over every conversation turn."""
    r = wrapped_responses(spark, sf_dir)
    return r.select("conv_id", "turn", tx.clean_response("raw").alias("docstring"))


def sc_edit_requests(spark: SparkSession, sf_dir: str, broken: bool = False):
    """(files, requests): one request per extracted definition, with its def-line
    indentation and the new docstring text to write."""
    files = sc_files(spark, sf_dir, broken)
    good = extract.good_chunks(store(extract.extract_chunks(files), "raw-chunks"))
    new_doc = F.concat(F.lit("Summary of "), F.col("name"), F.lit(".\n\nCalls: "),
                       F.array_join("calls", ", "))
    req = good.select("path", "name", "line_number", "body_start_line", "func_indent",
                      new_doc.alias("new_doc"))
    return files, req


def q_block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + A8: existing docstring block of every definition."""
    files, req = sc_edit_requests(spark, sf_dir)
    return (edits.block_bounds(files, req, ["path"], "content")
                 .select("path", "name", "doc_start", "doc_end"))


def _sc_edits(spark, sf_dir, broken=False):
    files, req = sc_edit_requests(spark, sf_dir, broken)
    bounded = edits.block_bounds(files, req, ["path"], "content")
    return files, edits.edit_rows(bounded, "new_doc").withColumn("seq", F.col("line_number"))


def q_edits_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + A6: edit rows grouped per file."""
    _, e = _sc_edits(spark, sf_dir)
    g = edits.edits_per_key(e, ["path"])
    spans = F.transform("edits", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"),
                                                    F.coalesce(x["hi"].cast("string"), F.lit(""))))
    return g.select("path", "n_edits", F.array_join(spans, ",").alias("spans"))


def q_apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 + J8 + S9: the corpus rewritten with a new docstring block for every definition
    (old blocks replaced); files that failed to parse are passed through unchanged."""
    files, e = _sc_edits(spark, sf_dir, broken=True)  # spoilt copies pass through
    return edits.apply_edits(files, e, ["path"], "content")


#: Lines of a block in ``apply_edits_blocked``: small, so that files are cut and blocks overlap edits.
SMALL_BLOCK = 16


def q_apply_edits_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + A8 + L4 + J8 over line blocks: the same corpus, no file held in one piece."""
    files, req = sc_edit_requests(spark, sf_dir, broken=True)
    blocks = store(edit_blocks.cut_blocks(files, ["path"], "content", SMALL_BLOCK), "line-blocks")
    bounded = edit_blocks.block_bounds_blocked(blocks, req, ["path"], SMALL_BLOCK)
    rows = edits.edit_rows(bounded, "new_doc").withColumn("seq", F.col("line_number"))
    done = edit_blocks.apply_edits_blocked(blocks, rows, ["path"], SMALL_BLOCK)
    return edit_blocks.join_blocks(done, ["path"], "content")


def _rewritten(spark: SparkSession, sf_dir: str):
    """The whole run over the corpus: index, one model-style answer per undocumented target
    (fenced and quoted, so it must be cleaned), among answers that must not be applied:
    null ones, later ones for the same target, ones for documented chunks and unknown ids."""
    files = sc_files(spark, sf_dir, broken=True)  # spoilt copies pass through
    idx = build_index(files)
    idx.chunks = store(idx.chunks, "chunks")  # answers, bounds and marks all read it
    targets = rank.undocumented_targets(idx.chunks)
    raw = F.concat(F.lit('```python\n"""Summary of '), F.col("name"), F.lit(".\n\nCalls: "),
                   F.array_join("calls", ", "), F.lit('"""\n```'))
    tid = F.col("id").alias("target_id")
    answers = (targets.select(tid, raw.alias("raw"))
               .unionByName(targets.select(tid, F.concat(raw, F.lit(" or not")).alias("raw")))
               .unionByName(targets.select(tid, F.lit(None).cast("string").alias("raw")))
               .unionByName(idx.chunks.where("docstring IS NOT NULL").select(tid, F.lit("x").alias("raw")))
               .unionByName(targets.select((F.col("id") + 10 ** 12).alias("target_id"), F.lit("x").alias("raw"))))
    return rewrite_corpus(files, answers, idx)


def q_rewrite_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten files. Documented definitions stay as they are; a name defined in
    several files is indexed - and so documented - only where it is defined first."""
    return _rewritten(spark, sf_dir).files


def q_rewrite_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the chunk table after the run; only the targets carry the marker."""
    return _rewritten(spark, sf_dir).chunks.select("id", "name", "docstring")


def q_rewrite_unapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that were not applied, counted by reason."""
    out = _rewritten(spark, sf_dir).unapplied
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "line_table": q_line_table,
    "line_slice": q_line_slice,
    "line_indent": q_line_indent,
    "format_block": q_format_block,
    "clean_response": q_clean_response,
    "block_bounds": q_block_bounds,
    "edits_per_file": q_edits_per_file,
    "apply_edits": q_apply_edits,
    "apply_edits_blocked": q_apply_edits_blocked,
    "rewrite_targets": q_rewrite_targets,
    "rewrite_chunks": q_rewrite_chunks,
    "rewrite_unapplied": q_rewrite_unapplied,
}
