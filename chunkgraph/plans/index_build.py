"""Build the chunk and edge tables from a corpus, and store them.

files -> extraction job (X1) -> first-wins by name (A1) -> dense ids (W2) -> edges (X3 + A2)
and pieces (X4). Chunks keep their whole text; the size split is a table of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkgraph.operators import extract, graph, index, split
from chunkgraph.plans.index_store import IndexStore
from chunkgraph.session import store

CHUNK_COLUMNS = ["id", "path", "name", "type", "content", "parent_class", "line_number",
                 "body_start_line", "docstring", "calls", "func_indent"]


@dataclass
class Index:
    chunks: DataFrame
    edges: DataFrame
    rejects: DataFrame
    pieces: DataFrame


def build_index(files: DataFrame, size: int = split.CHUNK_SIZE,
                overlap: int = split.CHUNK_OVERLAP, key: tuple[str, ...] = ("name",),
                spread: int | None = None) -> Index:
    """Index a corpus. The first chunk per ``key`` in (path, chunk_no) order wins, so a name
    defined in two files keeps the definition from the first path. ``pieces(chunk_id,
    piece_no, content)`` holds every piece of every kept chunk."""
    raw = store(extract.extract_chunks(files, spread=spread), "raw-chunks")
    good = extract.good_chunks(raw)
    # Which chunks stay, and their ids, is decided on the key columns; the texts join last.
    narrow = good.select(*dict.fromkeys([*key, "path", "chunk_no"]))
    kept = index.first_wins(narrow, list(key), ["path", "chunk_no"])
    ids = index.dense_ids(kept.select("path", "chunk_no"), ["path", "chunk_no"], "id")
    chunks = good.join(ids, ["path", "chunk_no"]).select(*CHUNK_COLUMNS)
    pieces = split.split_pieces(chunks.select(F.col("id").alias("chunk_id"), "content"),
                                "content", size, overlap).select("chunk_id", "piece_no", "content")
    return Index(chunks=chunks, edges=graph.build_edges(chunks), rejects=extract.rejects(raw),
                 pieces=pieces)


def save_index(idx: Index, base: str, mode: str = "ignore") -> None:
    """Publish a built index as a version of ``base``. ``mode="ignore"`` keeps an index
    that has chunks, ``"overwrite"`` puts a new version in its place; readers see the version
    before until the new one is committed. :meth:`IndexStore.build_once` decides before the
    index is built, which is what a job that may find one should call."""
    target = IndexStore(idx.chunks.sparkSession, base)
    have = target.manifest()
    if mode == "ignore" and have and have.rows:
        return
    target.publish(idx.chunks, idx.edges)


def load_index(spark, base: str) -> tuple[DataFrame, DataFrame]:
    """Full scans of the stored chunk and edge tables."""
    stored = IndexStore(spark, base)
    return stored.chunks(), stored.edges()
