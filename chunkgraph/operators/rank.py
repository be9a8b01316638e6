"""Two-bucket ranked context (T1/W1/J6/J7), context text (A5) and prompts (H3).

Ranking contract, for every target chunk:

* callee bucket (``dep = 1``) sorted by (has docstring, same file, name), callers bucket
  (``dep = 0``) sorted by (path contains "test", different file, name), **all keys
  descending** (so names run Z to A);
* keep ``int(top_n * dependency_ratio)`` callees and ``top_n`` minus that many callers;
  a short bucket is not back-filled from the other one;
* output order: callers first, then callees (``pos``).

``doc_state="sequential"`` reproduces one full documenting pass in target-id order: every
earlier target has been documented by the time a later one is ranked, so a candidate counts
as documented when ``docstring IS NOT NULL OR cand_id < target_id``. ``"snapshot"`` uses the
stored docstrings only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkgraph.fixed import CONTEXT_SEPARATOR, DEPENDENCY_RATIO, DONE_MARKER, TOP_N
from chunkgraph.functions import text as tx
from chunkgraph.operators.graph import context_candidates, dependencies, dependents
from chunkgraph.operators.index import dense_ids, mark_done


#: What the model is told before the prompt; the answers may come fenced or quoted anyway
#: and are cleaned.
SYSTEM_TEXT = ("Write a docstring for the Python definition under 'Target Code', in Google style. "
               "The definitions under 'Context from Codebase' show what it calls and what calls it. "
               "Answer with the text between the triple quotes and nothing else.")


def bucket_sizes(top_n: int = TOP_N, dependency_ratio: float = DEPENDENCY_RATIO) -> tuple[int, int]:
    """(callee slots, caller slots); truncation as Python's ``int`` does it."""
    k_dep = int(top_n * dependency_ratio)
    return k_dep, top_n - k_dep


def documented(doc_state: str = "sequential") -> F.Column:
    has = F.col("cand_has_doc")
    if doc_state == "sequential":
        return has | (F.col("cand_id") < F.col("target_id"))
    if doc_state == "snapshot":
        return has
    raise ValueError(f"unknown doc_state {doc_state!r}")


def rank_candidates(cands: DataFrame, top_n: int = TOP_N, dependency_ratio: float = DEPENDENCY_RATIO,
                    doc_state: str = "sequential") -> DataFrame:
    """T1 over the output of :func:`context_candidates`.

    The filter carries the literal bound ``rn <= max(k_dep, k_use)`` next to the per-bucket
    ``CASE``: with it the optimizer plans a partial ``WindowGroupLimit`` *before* the shuffle
    on ``(target_id, dep)``, so a target with millions of callers ships at most ``k`` rows per
    map partition instead of all of them.
    """
    k_dep, k_use = bucket_sizes(top_n, dependency_ratio)
    is_dep = F.col("dep") == 1
    key1 = F.when(is_dep, documented(doc_state)).otherwise(
        F.lower("cand_path").contains("test"))
    key2 = F.when(is_dep, F.col("cand_path") == F.col("target_path")).otherwise(
        F.col("cand_path") != F.col("target_path"))
    w = Window.partitionBy("target_id", "dep").orderBy(key1.desc(), key2.desc(),
                                                        F.col("cand_name").desc(), F.col("cand_id"))
    ranked = cands.withColumn("rn", F.row_number().over(w))
    bound = max(k_dep, k_use)
    ranked = ranked.where((F.col("rn") <= F.lit(bound))
                          & (F.col("rn") <= F.when(is_dep, F.lit(k_dep)).otherwise(F.lit(k_use))))
    done = (~F.col("cand_has_doc") & (F.col("cand_id") < F.col("target_id"))
            if doc_state == "sequential" else F.lit(False))
    return ranked.select(
        "target_id", "cand_id", "cand_name", "cand_path",
        F.col("dep").cast("int").alias("dep"),
        F.col("rn").cast("long").alias("rn"),
        (F.col("dep") * F.lit(k_use) + F.col("rn")).cast("long").alias("pos"),
        done.alias("cand_done"))


def rank_context(chunks: DataFrame, edges: DataFrame, targets: DataFrame | None = None,
                 top_n: int = TOP_N, dependency_ratio: float = DEPENDENCY_RATIO,
                 doc_state: str = "sequential") -> DataFrame:
    """Ranked context rows for every target (default: every undocumented chunk)."""
    cands = context_candidates(chunks, edges, targets)
    return rank_candidates(cands, top_n, dependency_ratio, doc_state)


def refresh_context(ranked: DataFrame, chunks: DataFrame, edges: DataFrame, done: DataFrame,
                    top_n: int = TOP_N, dependency_ratio: float = DEPENDENCY_RATIO) -> DataFrame:
    """T1 + J7 after a partial pass: the ranking once the chunks ``done(id)`` are documented.

    ``ranked`` is the snapshot ranking of all undocumented chunks before the pass. A document
    moves only callees, so what can change are the targets that call a chunk the pass
    documented: those are found through the reverse adjacency and ranked again, the done
    targets go, and every other target keeps its rows. Equal to a full ranking of the marked
    chunks.
    """
    newly = done.select("id").distinct().join(
        undocumented_targets(chunks).select("id", "name"), "id").select("id", "name")
    callers = edges.join(newly.select(F.col("name").alias("callee")), "callee").select(
        F.col("caller_id").alias("id")).distinct()
    moved = callers.join(undocumented_targets(chunks).select("id"), "id", "left_semi").join(
        newly.select("id"), "id", "left_anti")
    again = rank_context(mark_done(chunks, newly.select("id")), edges, moved, top_n, dependency_ratio, "snapshot")
    stale = moved.select(F.col("id").alias("target_id")).unionByName(newly.select(F.col("id").alias("target_id")))
    return ranked.join(stale, "target_id", "left_anti").select(again.columns).unionByName(again)


def retrieve_by_name(chunks: DataFrame, edges: DataFrame, requests: DataFrame,
                     top_n: int = TOP_N, dependency_ratio: float = DEPENDENCY_RATIO) -> DataFrame:
    """J3/J4/J7 for targets given as ``(name, path)``: one row per related chunk.

    ``role`` is ``callee`` (J3), ``caller`` (J4) or ``context`` (J7, with its prompt
    position); a request that names no chunk gets no row. The stored docstrings decide the
    ranking (``snapshot``), as requests need not follow the order of a full pass.
    Output: ``name, path, role, rel_id, rel_name, rel_path, pos``.
    """
    asked = requests.select("name", "path").distinct()
    targets = chunks.join(asked, ["name", "path"], "left_semi")
    key = targets.select(F.col("id").alias("t"), "name", "path")

    def rows(df, t, prefix, role, pos):
        return df.join(key, df[t] == key["t"]).select(
            "name", "path", F.lit(role).alias("role"), F.col(f"{prefix}_id").alias("rel_id"),
            F.col(f"{prefix}_name").alias("rel_name"), F.col(f"{prefix}_path").alias("rel_path"),
            pos.alias("pos"))

    none = F.lit(None).cast("long")
    ranked = rank_context(chunks, edges, targets, top_n, dependency_ratio, "snapshot")
    return (rows(dependencies(chunks, edges, targets), "chunk_id", "dep", "callee", none)
            .unionByName(rows(dependents(chunks, edges, targets), "chunk_id", "user", "caller", none))
            .unionByName(rows(ranked, "target_id", "cand", "context", F.col("pos"))))


def undocumented_targets(chunks: DataFrame, doc_col: str = "docstring") -> DataFrame:
    """The chunks to document (``docstring IS NULL``; an empty string is documented)."""
    return chunks.where(F.col(doc_col).isNull())


def target_queue(chunks: DataFrame) -> DataFrame:
    """P5: the work queue: undocumented ids with their place (from 0) in ascending order."""
    ids = undocumented_targets(chunks).select("id")
    return dense_ids(ids, ["id"], "place", start=0)


def context_rows(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """P4 + U2: result documents of each target in prompt order.

    Content and docstring are attached after the top-k cut, so no wide column travels
    through the candidate joins, the dedup or the window.
    """
    c = chunks.select(F.col("id").alias("cand_id"), "path", "name", "type", "parent_class",
                      "line_number", "docstring", "content")
    doc = F.coalesce("docstring", F.when(F.col("cand_done"), F.lit(DONE_MARKER)))
    return (ranked.select("target_id", "cand_id", "pos", "cand_done")
                  .join(c, "cand_id")
                  .select("target_id", "pos", "path", "name", "type", "parent_class",
                          "line_number", doc.alias("docstring"), "content"))


def context_strings(rows: DataFrame, sep: str = CONTEXT_SEPARATOR) -> DataFrame:
    """A5 + H10: one context text per target, pieces in ``pos`` order.

    Each group holds at most ``top_n`` rows (the cut happened before), so the ordered
    collect is bounded.
    """
    piece = tx.source_header(F.col("path"), F.col("content"))
    return (rows.groupBy("target_id")
                .agg(tx.ordered_join(F.collect_list(F.struct(F.col("pos").alias("k"),
                                                             piece.alias("v"))), sep)
                     .alias("context")))


def prompts(targets: DataFrame, contexts: DataFrame, system: str = SYSTEM_TEXT) -> DataFrame:
    """H3: system text and user prompt of every target; a target without context gets an
    empty context."""
    t = targets.select(F.col("id").alias("target_id"), "name", "path", "content")
    return (t.join(contexts, "target_id", "left")
             .select("target_id", "name", "path", F.lit(system).alias("system"),
                     tx.prompt_text(F.coalesce("context", F.lit("")), F.col("content"))
                     .alias("prompt")))
