"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkgraph.llm.common import scratch_path, remove_path


#: A node with over 1/HUB_SHARE of all edges is a hub; there are at most 2 * HUB_SHARE.
HUB_SHARE = 256


class _Step:
    """Stored tables of one contraction; each is read by the next step only."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, schema: str) -> DataFrame:
        path = scratch_path(self.spark, "edges")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def keep(self, last: int) -> None:
        """Delete all but the last tables."""
        while len(self.paths) > last:
            remove_path(self.spark, self.paths.pop(0))


def _with_least(edges: DataFrame, n: int, step: _Step) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least of u and its neighbours.

    Minima are combined within each task first and stored, a row per node. The edges of a hub
    stay where they are: the minima of the hubs, a bounded number of rows, are broadcast, and all
    others are joined.
    """
    least = step.put(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "u", F.least("u", "m").alias("m"), "n"), "u long, m long, n long")
    floor = max(64, n // HUB_SHARE)
    hubs = least.where(F.col("n") > floor).select("u", "m")
    if hubs.isEmpty():
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(
        least.where(F.col("n") <= floor).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _large_star(edges: DataFrame, n: int, step: _Step) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_least(both, n, step).where("v > u")
                .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, n: int, step: _Step) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    d = _with_least(down, n, step)
    moved = d.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(d.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; the label is the least node reached.

    Every step rewrites the edges so that they point to smaller nodes and is stored in the
    shared folder, so plans stay as small as one step; it ends when a round changes nothing. Hub
    nodes meet their minimum by a broadcast of bounded size; no adjacency list is built.
    """
    schema, step = "u long, v long", _Step(edges.sparkSession)

    def put(df: DataFrame) -> tuple[DataFrame, tuple]:
        back = step.put(df.where("u <> v").distinct(), schema)
        row = back.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                       .alias("h")).first()
        return back, (row.n, row.h)

    current, mark = put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while mark[0]:
        large, middle = put(_large_star(current, mark[0], step))
        small, new_mark = put(_small_star(large, max(1, middle[0]), step))
        step.keep(1)
        done, current, mark = new_mark == mark, small, new_mark
        if done:
            break
    # Now every node points straight at its root; the roots point at themselves.
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
