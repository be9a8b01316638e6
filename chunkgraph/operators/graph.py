"""Call-graph operators: edge build, callees, callers, candidate union.

All of them are batch joins over the whole chunk and edge tables: one plan answers the
question for every chunk at once, instead of one lookup per chunk.

Skew: a "hub" name called by a large share of all chunks puts many edge rows on one join
key. Both joins below keep the hub on the big (edge) side against a single chunk row on the
other side, which is the shape adaptive execution splits (``skewJoin``) - the small side is
replicated to each split, no task sees the whole hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_edges(chunks: DataFrame, id_col: str = "id", calls_col: str = "calls") -> DataFrame:
    """X3 + A2: explode call lists into distinct ``(caller_id, callee)`` pairs.

    ``distinct`` plans as a partial + final hash aggregate, so duplicate pairs inside a
    partition are dropped before the shuffle.
    """
    return (chunks.select(F.col(id_col).alias("caller_id"), F.explode(calls_col).alias("callee"))
                  .where(F.col("callee").isNotNull())
                  .distinct())


def dependencies(chunks: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """For each chunk of ``of`` (default: all chunks), the chunks it calls.

    Exact name match: the callee text of an edge must equal a chunk name.
    Output: ``chunk_id, dep_id, dep_name, dep_path, dep_type``.
    """
    src = (of if of is not None else chunks).select(F.col("id").alias("chunk_id"))
    e = edges.select("caller_id", "callee")
    c = chunks.select(F.col("id").alias("dep_id"), F.col("name").alias("dep_name"),
                      F.col("path").alias("dep_path"), F.col("type").alias("dep_type"))
    return (src.join(e, src.chunk_id == e.caller_id)
               .join(c, e.callee == c.dep_name)
               .select("chunk_id", "dep_id", "dep_name", "dep_path", "dep_type"))


def dependents(chunks: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """For each chunk of ``of`` (default: all chunks), the chunks that call it.

    Output: ``chunk_id, user_id, user_name, user_path, user_type``.
    """
    src = (of if of is not None else chunks).select(
        F.col("id").alias("chunk_id"), F.col("name").alias("chunk_name"))
    e = edges.select("caller_id", "callee")
    c = chunks.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"),
                      F.col("path").alias("user_path"), F.col("type").alias("user_type"))
    return (src.join(e, src.chunk_name == e.callee)
               .join(c, e.caller_id == c.user_id)
               .select("chunk_id", "user_id", "user_name", "user_path", "user_type"))


def out_degree(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing edges per chunk, chunks without edges kept with 0.

    ``n_calls`` counts distinct callee texts, ``n_resolved`` those naming a chunk.
    """
    names = chunks.select(F.col("name").alias("r_name")).distinct()
    per_caller = (edges.join(names, edges.callee == names.r_name, "left")
                       .groupBy("caller_id")
                       .agg(F.count("*").alias("n_calls"),
                            F.count("r_name").alias("n_resolved")))
    return (chunks.select("id", "name")
                  .join(per_caller, chunks.id == per_caller.caller_id, "left")
                  .select("id", "name",
                          F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
                          F.coalesce("n_resolved", F.lit(0)).cast("long").alias("n_resolved")))


def resolved_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose callee names a chunk, with both endpoints' ``id, name, path`` and whether
    they are documented (texts stay out of the joins).

    Two joins: edges by callee name against chunks by name (a hub name is one chunk row
    against many edge rows - the skew-split shape), then by caller id against chunks by id.
    """
    def side(prefix):
        return chunks.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"),
                             F.col("path").alias(f"{prefix}_path"),
                             F.col("docstring").isNotNull().alias(f"{prefix}_has_doc"))
    callee, caller = side("callee"), side("caller")
    e = edges.select(F.col("caller_id").alias("_caller"), F.col("callee").alias("_callee"))
    return (e.join(callee, e["_callee"] == callee["callee_name"])
             .join(caller, e["_caller"] == caller["caller_id"])
             .drop("_caller", "_callee"))


def context_candidates(chunks: DataFrame, edges: DataFrame,
                       targets: DataFrame | None = None) -> DataFrame:
    """J7 before ranking: U1 + A3 + J6 for every target in one plan.

    Candidates of a target are its callees (J1) and its callers (J2); a chunk that is
    both appears once, in the callee bucket (``dep = 1``), because bucket membership is
    "candidate name is in the target's call list" and every callee edge comes from that
    list.

    Each resolved edge is read once and emits two rows - (caller as target, callee as
    candidate, dep 1) and (callee as target, caller as candidate, dep 0) - so neither side
    of the graph is joined twice. Dedup is a partial + final aggregate on the
    ``(target, candidate)`` pair, which hashes evenly even when one target has a huge
    number of callers.

    ``targets``: ``None`` = every undocumented chunk (filtered in place, no join); otherwise
    a frame with an ``id`` column (semi-joined). Output: ``target_id, target_path, cand_id,
    cand_name, cand_path, cand_has_doc, dep``.
    """
    r = resolved_edges(chunks, edges)

    def row(t, c, dep):
        return F.struct(F.col(f"{t}_id").alias("target_id"), F.col(f"{t}_path").alias("target_path"),
                        F.col(f"{t}_has_doc").alias("target_has_doc"), F.col(f"{c}_id").alias("cand_id"),
                        F.col(f"{c}_name").alias("cand_name"), F.col(f"{c}_path").alias("cand_path"),
                        F.col(f"{c}_has_doc").alias("cand_has_doc"), F.lit(dep).alias("dep"))

    both = r.select(F.explode(F.array(row("caller", "callee", 1), row("callee", "caller", 0)))
                    .alias("x")).select("x.*")
    if targets is None:
        both = both.where(~F.col("target_has_doc"))
    else:
        both = both.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    # Candidate attributes depend on cand_id alone; keeping them as grouping keys avoids a
    # join back to the chunk table after the dedup.
    return (both.groupBy("target_id", "target_path", "cand_id", "cand_name", "cand_path",
                         "cand_has_doc")
                .agg(F.max("dep").alias("dep"))
                .select("target_id", "target_path", "cand_id", "cand_name", "cand_path",
                        "cand_has_doc", "dep"))
