"""Evaluation-set operators: load (S3/T3/E1), sample and write (S5/T4/P10), pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkgraph.fixed import SAMPLE_SIZE
from chunkgraph.sources import json_array


def load_eval_set(spark: SparkSession, path: str, num_samples: int | None = None,
                  schema: str | None = None) -> DataFrame:
    """S3 + T3: read evaluation samples from JSON array file(s); first ``num_samples`` in
    file order (``None`` = all). A missing path fails the read."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    df = reader.json(path)
    ordered = (df.withColumn("_file", F.input_file_name())
                 .withColumn("_pos", F.monotonically_increasing_id()))
    if num_samples is not None:
        ordered = ordered.orderBy("_file", "_pos").limit(num_samples)
    return ordered.drop("_file", "_pos")


def read_array(spark: SparkSession, path: str, schema: str, range_bytes: int = json_array.RANGE_BYTES) -> DataFrame:
    """S3 for an array of any size: byte ranges of one file (or of a folder of parts) are read
    side by side. A record that does not parse has null fields."""
    records = json_array.read_records(spark, path, range_bytes)
    return records.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_array(samples: DataFrame, path: str, fields: Sequence[str], order: Sequence[str]) -> None:
    """S5 for a set of any size: one JSON array in ``order``, as a folder of parts whose texts
    follow one another; nothing is gathered. Null fields are written as nulls."""
    ordered = samples.repartitionByRange(*order).sortWithinPartitions(*order)
    json_array.write_parts(ordered.select(F.to_json(
        F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")), path)


def first_n(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in an explicit order (``limit`` alone has none).
    Planned as a top-k (``TakeOrderedAndProject``): each partition keeps ``n`` rows."""
    if n is None:
        return df
    return df.orderBy(*order).limit(n)


def required_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """P10: keep rows that have every field, projected to those fields."""
    cond = None
    for f in fields:
        term = F.col(f).isNotNull()
        cond = term if cond is None else cond & term
    return df.where(cond).select(*fields)


def sample_eval_set(corpus: DataFrame, order: Sequence[str], code_col: str = "source_code",
                    doc_col: str = "docstring", sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """S5 before the write: take ``sample_size`` rows, then keep those with both fields."""
    taken = first_n(corpus, order, sample_size)
    return required_fields(taken, [*order, code_col, doc_col])


def write_eval_set(samples: DataFrame, path: str, fields: Sequence[str] = ("source_code",
                                                                            "docstring"),
                   order: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Write the samples as one JSON array (the shape the loader reads).

    The sample is bounded by its ``sample_size`` (the caller took that many rows), so
    gathering it into the single output row is bounded too.
    """
    items = F.struct(*[F.col(f) for f in fields])
    key = F.struct(*[F.col(c) for c in (order or fields)])
    arr = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), items.alias("v")))),
                      lambda x: x["v"])
    (samples.agg(F.to_json(arr).alias("value"))
            .coalesce(1).write.mode(mode).text(path))


def write_eval_lines(samples: DataFrame, path: str, fields: Sequence[str] = ("source_code",
                                                                             "docstring"),
                     mode: str = "overwrite") -> None:
    """S5 for large sets: JSON lines, one file per partition."""
    samples.select(*fields).write.mode(mode).json(path)


def eval_rows(samples: DataFrame, predictions: DataFrame, key: str,
              question_col: str = "source_code", truth_col: str = "docstring",
              answer_col: str = "answer", contexts_col: str = "contexts") -> DataFrame:
    """J9 + E2: ``(question, answer, contexts, ground_truth)`` per sample; samples without a
    prediction keep a null answer and an empty context list."""
    p = predictions.select(key, answer_col, contexts_col)
    return (samples.join(p, key, "left")
                   .select(key, F.col(question_col).alias("question"),
                           F.col(answer_col).alias("answer"),
                           F.coalesce(F.col(contexts_col), F.array().cast("array<string>"))
                            .alias("contexts"),
                           F.col(truth_col).alias("ground_truth")))


def top_contexts(turns: DataFrame, key: str, order_col: str, text_col: str,
                 top_n: int | None = None) -> DataFrame:
    """Per key, the texts of its rows in ``order_col`` order, as a list; with ``top_n`` only
    the first that many (cut by a partial window-group limit before the shuffle)."""
    if top_n is None:
        pair = F.struct(F.col(order_col).alias("k"), F.col(text_col).alias("v"))
        return (turns.groupBy(key)
                     .agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"])
                          .alias("contexts")))
    w = Window.partitionBy(key).orderBy(order_col)
    cut = turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(top_n))
    return (cut.groupBy(key)
               .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("k"),
                                                                     F.col(text_col).alias("v")))),
                                lambda x: x["v"]).alias("contexts")))
