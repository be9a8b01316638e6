"""The tool's whole run as two batch plans, with the model call as a table in between.

1. :func:`prompts_for_corpus` - index the corpus and produce one prompt per undocumented
   definition (``target_id, name, path, prompt``). The model step runs outside Spark and
   returns ``(target_id, raw)`` answers.
2. :func:`rewrite_corpus` - clean the answers, find each target's insertion point (or the
   block to replace), write every block into a new ``files`` table in one pass, and return
   the chunk table with the finished targets marked done.

``files`` is read several times (index, line table, rewrite); pass a stored table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkgraph.functions import text as tx
from chunkgraph.operators import edits, index, rank
from chunkgraph.plans.index_build import Index, build_index


def prompts_for_corpus(files: DataFrame, idx: Index | None = None, top_n: int = 10,
                       dependency_ratio: float = 0.6) -> DataFrame:
    idx = idx or build_index(files)
    ranked = rank.rank_context(idx.chunks, idx.edges, top_n=top_n,
                               dependency_ratio=dependency_ratio)
    contexts = rank.context_strings(rank.context_rows(ranked, idx.chunks))
    return rank.prompts(rank.undocumented_targets(idx.chunks), contexts)


@dataclass
class Rewrite:
    files: DataFrame      # new (path, content) for every input file
    chunks: DataFrame     # chunk table with finished targets marked done
    edits: DataFrame      # the edit rows, incl. warn_one_line
    unapplied: DataFrame  # (id, reason) of the answers that were not used


def rewrite_corpus(files: DataFrame, answers: DataFrame, idx: Index | None = None,
                   answer_col: str = "raw", order_col: str | None = None) -> Rewrite:
    """Apply ``answers(target_id, raw)``.

    Of several answers for one target the first in ``order_col`` (default: the smallest
    text) is used. Null answers, answers for documented chunks and for unknown ids are not
    applied, and only targets that got an edit are marked done; the others are listed in
    ``unapplied``.
    """
    idx = idx or build_index(files)
    order = F.col(order_col) if order_col else F.col(answer_col)
    given = answers.select(F.col("target_id").alias("id"), F.col(answer_col).alias("_raw"), order.alias("_o"))
    per_id = given.groupBy("id").agg(
        F.min_by("_raw", F.when(F.col("_raw").isNotNull(), F.struct("_o", "_raw"))).alias("_raw"),
        F.count("_raw").alias("_n"), F.count(F.lit(1)).alias("_all"))
    c = idx.chunks.select(F.col("id").alias("_cid"), F.col("docstring").isNull().alias("_open"),
                          "path", "name", "line_number", "body_start_line", "func_indent")
    judged = per_id.join(c, F.col("id") == F.col("_cid"), "left").withColumn(
        "_why", F.when(F.col("_cid").isNull(), "no such chunk").when(~F.col("_open"), "already documented")
        .when(F.col("_n") == 0, "null answer"))
    requests = judged.where(F.col("_why").isNull()).select(
        "path", "id", "name", "line_number", "body_start_line", "func_indent",
        tx.clean_response(F.col("_raw")).alias("new_doc"))
    unapplied = judged.select("id", F.explode(F.array_compact(F.array(
        F.col("_why"), F.when(F.col("_why").isNull() & (F.col("_n") > 1), "other answers"),
        F.when(F.col("_why").isNull() & (F.col("_all") > F.col("_n")), "null answer")))).alias("reason"))
    rows = edits.edit_rows(edits.block_bounds(files, requests, ["path"], "content"), "new_doc")
    rows = rows.withColumn("seq", F.col("id"))
    new_files = edits.apply_edits(files, rows, ["path"], "content")
    done = index.mark_done(idx.chunks, rows.select("id"))
    return Rewrite(files=new_files, chunks=done, edits=rows, unapplied=unapplied)
