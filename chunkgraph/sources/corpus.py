"""Corpus sources: a source tree on a shared filesystem, or a ``files`` table.

The table form ``files(path, content)`` is the primary input. The directory form is a data
source of its own (:mod:`chunkgraph.sources.tree`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.fixed import PRUNED_DIR, SOURCE_SUFFIX
from chunkgraph.session import ship_package
from chunkgraph.sources.tree import FORMAT, LIST_LIMIT, PARTITION_BYTES, SourceTree

_HIDDEN_OR_VENV_DIR = rf"(^|/)(\.[^/]*|{PRUNED_DIR})/"
_HIDDEN_FILE = r"(^|/)\.[^/]*$"


def is_python_source(path) -> Column:
    """P6 on a path relative to the corpus root: a ``.py`` file that is not hidden and
    does not sit below a hidden folder or a folder named ``venv``."""
    p = F.col(path) if isinstance(path, str) else path
    return p.endswith(SOURCE_SUFFIX) & ~p.rlike(_HIDDEN_OR_VENV_DIR) & ~p.rlike(_HIDDEN_FILE)


def scan_directory(spark: SparkSession, root: str, partition_bytes: int = PARTITION_BYTES,
                   list_limit: int = LIST_LIMIT) -> DataFrame:
    """``files(path, content)`` for every Python file under ``root`` (relative paths), read
    by :mod:`chunkgraph.sources.tree`. Unreadable or non-UTF-8 files get a null ``content`` and
    become rejects in the extraction job."""
    ship_package(spark)
    spark.dataSource.register(SourceTree)
    return (spark.read.format(FORMAT).option("partitionBytes", partition_bytes)
                 .option("listLimit", list_limit).load(root))


def filter_sources(files: DataFrame, path_col: str = "path") -> DataFrame:
    """P6 applied to a ``files`` table (paths relative to the corpus root)."""
    return files.where(is_python_source(path_col))


def corpus_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and column names of a frame, as one row."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.lit(",".join(df.columns)).alias("columns"))


def write_directory(files: DataFrame, root: str, path_col: str = "path",
                    content_col: str = "content") -> None:
    """S9 as a sink: every row of ``files`` becomes ``root/<path>``; ``root`` is a new tree that
    appears when the whole job is done (:mod:`chunkgraph.sources.tree`)."""
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(SourceTree)
    (files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
          .write.format(FORMAT).mode("append").save(root))
