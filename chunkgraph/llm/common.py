"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.functions.text import pinned  # noqa: F401
from chunkgraph.session import ensure_checkpoint_dir, remember

#: The six ASCII white-space characters that separate words, and runs of them.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Python workers handle a batch in slices of about this many bytes of text, so that their
#: numpy buffers stay small however many rows Arrow puts into a batch.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the files."""
    spark = df.sparkSession
    path = remember(spark, scratch_path(spark, name))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named (superseded intermediate data)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def packed(df: DataFrame, *without: str, **named: Column) -> DataFrame:
    """All columns of ``df`` but ``without`` in one struct ``row``, out of the way of any name,
    beside ``named``."""
    held = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return df.select(F.struct(*held or [F.lit(0).alias("none")]).alias("row"),
                     *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, columns: list[str], added: Sequence[str] = (), **replaced: Column) -> DataFrame:
    """``columns`` out of the struct ``row``, those in ``replaced`` with a new value; then the
    columns ``added``, which replace input columns of that name."""
    kept = [replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c)
            for c in columns if c not in added]
    return df.select(*kept, *added)


def words(text: Column) -> Column:
    """Runs of characters other than the six white-space ones; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_RUN), lambda w: w != "")


def release() -> None:
    """Give freed memory back to the system; Python workers stay alive between tasks and
    share the executor's limit with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def ranges(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of rows of the given sizes, of about ``limit`` in all each."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= limit:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(values: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``values`` (bytes or strings, None allowed) of about ``limit`` each."""
    return ranges([len(v) if v else 0 for v in values], limit)


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` ascending cut values that split ``column`` into ranges of about
    equal row counts (``parts`` bounds what reaches the driver). Nulls are not counted."""
    if parts < 2:
        return []
    qs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(column, F.array(*map(F.lit, qs)),
                                     F.lit(max(10000, 20 * parts))).alias("q")).first()
    return sorted(set(row.q)) if row and row.q else []
