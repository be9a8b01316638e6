"""The corpus pipeline: documents in, token ids out.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm import bpe, common, line_dedup, mixing, quality_rules, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules reject go; the others stay as they are.

    Null and empty texts go (they have no words); a text of any length is judged whole; rows that
    repeat are judged each on its own, so there are no ties; an empty table stays empty; columns
    of any name come back unchanged.
    """
    rows = common.packed(docs, "text", text=F.col("text"))
    kept = quality_rules.quality_rules(rows).where("kept")
    return common.unpacked(kept, docs.columns, text=F.col("text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines an earlier document holds go; a document that loses all its lines goes with them.

    Null texts become empty ones; texts of any length are rebuilt whole; of equal lines the one in
    the smallest id stays, rows that share an id are one document, rows without an id keep all
    their lines; an empty table stays empty; columns of any name come back unchanged, but for
    ``text`` and ``n_chars``, which follows it.
    """
    rows = common.packed(docs, "text", doc_id=F.col("doc_id"), text=F.col("text"))
    out = line_dedup.dedup_lines(rows)
    out = out.where((F.col("n_dropped") == 0)
                    | (F.btrim("text", F.lit(common.WS_CHARS)) != ""))
    return common.unpacked(out, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (4-word shingles, 4 bits) the smallest id stays.

    The stage comes after the line dedup, which has taken the shared lines out of copies already:
    what is near here is near in what is left. Null, empty and blank texts are one group; a text
    of any length has one fingerprint; rows that repeat the smallest id all stay, rows without an
    id stay; an empty table stays empty; columns of any name come back unchanged.
    """
    return simhash.simhash_dedup(docs, shingle_words=4, max_bits=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened as far as ``MIX_REPEAT`` allows, in training order.

    No document goes; those of smaller sources come again in later passes. A null source is a
    source; null and empty texts have no tokens and come with each full pass; texts of any length
    count their words; rows that repeat are rows of their own; equal positions follow the pass
    and the id; an empty table stays empty; columns of any name come back unchanged.
    """
    rows = common.packed(docs, "text", doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    out = mixing.mix_sources(rows, max_repeat=MIX_REPEAT).orderBy("position", "epoch", "doc_id")
    return common.unpacked(out, docs.columns, text=F.col("text"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of a full round trip.

    Null texts have no tokens, as empty ones; a text of any length is encoded whole; rows that
    repeat come each; merges of equal rank go from left to right; an empty table stays empty;
    only ``doc_id``, ``source`` and ``text`` are read.
    """
    out = bpe.bpe_encode(docs.select("doc_id", "source", "text"), decode=True, keep_text=False)
    return out.select(
        "doc_id", "source", "n_tokens", "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


#: No source is repeated more often than this in the mix.
MIX_REPEAT = 1.25

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is stored before the next."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.store(docs, f"stage-{name}")
    return docs
