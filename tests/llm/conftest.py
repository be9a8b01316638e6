import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def make_docs(spark, rows, start=0):
    """Rows of ``documents``: texts, or (doc_id, text) pairs."""
    out = []
    for i, r in enumerate(rows):
        doc, text = r if isinstance(r, tuple) else (start + i, r)
        out.append((doc, text, "en", "src0", None if text is None else len(text)))
    return spark.createDataFrame(out, DOCS)


@pytest.fixture
def store_docs(spark, tmp_path):
    """Write texts as a documents table and return its folder, as the queries read it."""
    def put(rows):
        path = str(tmp_path / f"sf-{len(list(tmp_path.iterdir()))}")
        make_docs(spark, rows).write.parquet(f"{path}/documents.parquet")
        return path
    return put
