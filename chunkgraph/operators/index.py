"""Index operators: first-wins key dedup, dense ids, lookups, counts, done marking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkgraph.fixed import DONE_MARKER
from chunkgraph.session import ensure_checkpoint_dir


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A1: keep one row per key - the first in ``order`` - and never update it.

    ``min_by`` over a struct is a declarative aggregate with a partial (map-side) phase,
    so a key that holds a third of all rows is collapsed to one row per map partition
    before anything is shuffled. ``dropDuplicates`` is not used: it does not say which
    row stays.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:  # the key is the whole row: one row per distinct key
        return df.select(*keys).distinct()
    order_key = F.struct(*[F.col(c) for c in order])
    out = (df.groupBy(_key_hash(keys), *keys)
             .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order_key).alias("_row")))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _key_hash(keys: Sequence[str]):
    """A 64-bit hash of the key, grouped/joined on *before* the key itself: the sort-based
    aggregate and the sort-merge join then compare longs almost always instead of long
    texts. Equality is still decided by the key columns, so collisions cannot merge keys."""
    return F.xxhash64(*[F.col(k) for k in keys]).alias("_kh")


def first_wins_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                     flag: str = "is_new") -> DataFrame:
    """Every input row with ``flag`` = "this row created the key" (get-or-create's bool).

    The first order value per key comes from a pre-aggregated table (one row per key), so
    the join back puts a hot key's many rows against a single row - the shape adaptive
    skew-join handling splits - instead of sorting the whole hot group in one task.
    """
    keys = list(keys)
    order_key = F.struct(*[F.col(c) for c in order])
    rows = df.withColumn("_kh", _key_hash(keys))
    firsts = (rows.groupBy("_kh", *keys).agg(F.min(order_key).alias("_first"))
                  .select(F.col("_kh").alias("_k_kh"),
                          *[F.col(k).alias(f"_k_{k}") for k in keys], "_first"))
    # Null-safe: a null key is one group, as in the aggregate.
    cond = rows["_kh"] == firsts["_k_kh"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(firsts[f"_k_{k}"])
    return (rows.join(firsts, cond)
                .withColumn(flag, F.struct(*[F.col(c) for c in order]) == F.col("_first"))
                .drop("_kh", "_k_kh", "_first", *[f"_k_{k}" for k in keys]))


def dense_ids(df: DataFrame, order: Sequence[str], out_col: str = "id", start: int = 1,
              num_partitions: int | None = None) -> DataFrame:
    """Dense surrogate ids ``start, start+1, ...`` in ``order``, without a global window.

    Range-partition and sort, pin the result with a reliable checkpoint (so a lost executor
    cannot reshuffle rows between the two passes), count rows per partition, and add each
    partition's offset to the row's index inside its partition. The offset table has one
    row per partition - bounded by the partition count, not by the data - so it is safe to
    broadcast.

    ``order`` should identify rows uniquely (e.g. ``path, chunk_no``): then a retried task
    rebuilds its partition in the same order and the ids do not depend on task timing.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    staged = (df.repartitionByRange(n, *cols)
                .sortWithinPartitions(*cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (staged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out_col, (F.col("_off") + local + F.lit(start)).cast("long"))
                  .drop("_pid", "_mid", "_off"))


def lookup_by_id(chunks: DataFrame, keys: DataFrame, key_col: str,
                 missing: str = "raise") -> DataFrame:
    """Resolve many ids at once (equi-join). An id without a chunk fails the query, or
    is dropped with ``missing="drop"``."""
    if missing == "drop":
        return keys.join(chunks, keys[key_col] == chunks["id"]).drop(chunks["id"])
    if missing != "raise":
        raise ValueError(f"unknown missing {missing!r}")
    c = chunks.withColumnRenamed("id", "_found")
    out = keys.join(c, keys[key_col] == c["_found"], "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(
        F.lit("no chunk with id "), F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    )).cast("long")).otherwise(F.col("_found"))
    return out.where(checked.isNotNull()).drop("_found")


def lookup_by_name_path(chunks: DataFrame, requests: DataFrame, name_col: str,
                        path_col: str) -> DataFrame:
    """Conjunctive (name, path) lookup for many requests; misses keep a null ``id``."""
    c = chunks.select("id", F.col("name").alias("_n"), F.col("path").alias("_p"))
    cond = (requests[name_col] == c["_n"]) & (requests[path_col] == c["_p"])
    return requests.join(c, cond, "left").drop("_n", "_p")


def missing_lookups(chunks: DataFrame, requests: DataFrame, name_col: str,
                    path_col: str) -> DataFrame:
    """The requests the single-row lookup would raise on."""
    c = chunks.select(F.col("name").alias("_n"), F.col("path").alias("_p"))
    cond = (requests[name_col] == c["_n"]) & (requests[path_col] == c["_p"])
    return requests.join(c, cond, "left_anti")


def value_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return (df.where(F.col(col).isNotNull())
              .groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
              .orderBy(F.col(count_col).desc(), F.col(col)))


def index_stats(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """The counts the tool reports, as ``(stat, value)`` rows."""
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"),
                   F.count_if(F.col("docstring").isNull()).alias("undocumented"),
                   F.count_distinct("path").alias("paths"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    rows = c.select(F.explode(F.array(
        F.struct(F.lit("chunks").alias("stat"), F.col("chunks").cast("long").alias("value")),
        F.struct(F.lit("undocumented").alias("stat"), F.col("undocumented").cast("long").alias("value")),
        F.struct(F.lit("paths").alias("stat"), F.col("paths").cast("long").alias("value")))).alias("s"))
    return (rows.select("s.stat", "s.value")
                .unionByName(e.select(F.lit("edges").alias("stat"),
                                      F.col("edges").cast("long").alias("value"))))


def mark_done(chunks: DataFrame, finished: DataFrame, marker: str = DONE_MARKER) -> DataFrame:
    """L3: a new version of the chunk table where finished ids carry ``marker``."""
    done = finished.select(F.col("id").alias("_done_id")).distinct()
    return (chunks.join(done, chunks["id"] == done["_done_id"], "left")
                  .withColumn("docstring", F.when(F.col("_done_id").isNotNull(), F.lit(marker))
                              .otherwise(F.col("docstring")))
                  .drop("_done_id"))
