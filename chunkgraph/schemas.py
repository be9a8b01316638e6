"""Fixed schemas of the data model (files, chunks, edges, edits, evaluation rows)."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
])

# One row per extracted chunk, before splitting and key dedup.
RAW_CHUNKS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("chunk_no", T.IntegerType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("parent_class", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("body_start_line", T.IntegerType(), True),
    T.StructField("docstring", T.StringType(), True),
    T.StructField("calls", T.ArrayType(T.StringType()), True),
    T.StructField("func_indent", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

CHUNKS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("parent_class", T.StringType(), True),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("body_start_line", T.IntegerType(), True),
    T.StructField("docstring", T.StringType(), True),
    T.StructField("calls", T.ArrayType(T.StringType()), True),
    T.StructField("func_indent", T.StringType(), True),
])

EDGES = T.StructType([
    T.StructField("caller_id", T.LongType(), False),
    T.StructField("callee", T.StringType(), False),
])
