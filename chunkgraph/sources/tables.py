"""Parquet table sources (the primary input form)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Inferring a Parquet schema runs a small job per read; the result only depends on the
# file, so it is kept per (path, size, mtime) and passed back to later reads.
_SCHEMAS: dict[tuple, StructType] = {}


def _file_key(path: str) -> tuple:
    try:
        if not os.path.isfile(path):  # datasets (folders) and remote paths: infer every time
            return ()
        st = os.stat(path)
        return (path, st.st_size, st.st_mtime_ns)
    except OSError:
        return ()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    key = _file_key(path)
    schema = _SCHEMAS.get(key) if key else None
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    if key:
        _SCHEMAS[key] = df.schema
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; column pruning and filters reach the scan."""
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_files_table(spark: SparkSession, path: str) -> DataFrame:
    """A corpus stored as a table ``files(path STRING, content STRING)``."""
    return read_parquet(spark, path).select("path", "content")
