"""SC - a synthetic Python corpus derived from the code-graph view, and its queries.

One file per (CG path, ``id div 100``), so no file holds more than 100 definitions however
large the tables grow. Each file starts with an aliased import and a ``setup`` helper (the
same name in every file, so first-wins has collisions to resolve), then one function per
chunk in id order:

    def part_<id>():
        [docstring: one line if line_number is even, three lines if odd]
        part_<b>()            one line per callee, sorted; ``pass`` if there is none
        [osp.join("a")        if line_number % 4 = 1  -> resolves to os.path.join]
        [print(len("a"))      if line_number % 4 = 2  -> builtins, dropped]

A chunk of type ``method`` becomes a method of its own class instead, with the same body
one level deeper; when ``line_number % 10 = 0`` the class first gets an ``__init__`` (which
is folded into the class chunk, so the class calls ``setup``):

    class K<id>:
        [def __init__(self):
            setup()]
        def part_<id>(self):
            ...

Where a query asks for it, the files whose ``id div 100`` ends in 9 come a second time, named
``..._spoilt.py`` and with a broken last line, and must be rejected.
Extraction over this corpus must give back the CG edges exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.operators import extract, graph, index, split
from chunkgraph.plans import views
from chunkgraph.plans.index_build import build_index
from chunkgraph.session import ensure_checkpoint_dir, initial_partitions
from chunkgraph.sources import corpus
from chunkgraph.sources.tables import read_table

FILE_HEADER = ["import os.path as osp", "def setup():", "    pass"]
BROKEN_TAIL = "def broken(:"
IND = "    "


def _file_no():
    return F.floor(F.col("id") / 100).cast("long")


def _sc_path():
    return F.concat(F.regexp_replace("path", r"\.py$", ""), F.lit("_"), _file_no().cast("string"), F.lit(".py"))


def sc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per generated function: ``id, name, sc_path, file_no, lines``."""
    c = views.cg_chunks(spark, sf_dir, with_calls=True)
    file_no, sc_path = _file_no(), _sc_path()
    doc = F.col("docstring")
    doc_lines = (F.when(doc.isNull(), F.array().cast("array<string>"))
                 .when(F.col("line_number") % 2 == 0,
                       F.array(F.concat(F.lit(IND + '"""'), doc, F.lit('"""'))))
                 .otherwise(F.array(F.lit(IND + '"""'), F.concat(F.lit(IND), doc),
                                    F.lit(IND + '"""'))))
    call_lines = F.when(F.size("calls") == 0, F.array(F.lit(IND + "pass"))).otherwise(
        F.transform("calls", lambda x: F.concat(F.lit(IND), x, F.lit("()"))))
    extra = (F.when(F.col("line_number") % 4 == 1, F.array(F.lit(IND + 'osp.join("a")')))
             .when(F.col("line_number") % 4 == 2, F.array(F.lit(IND + 'print(len("a"))')))
             .otherwise(F.array().cast("array<string>")))
    inner = F.concat(doc_lines, call_lines, extra)
    fn_lines = F.concat(F.array(F.concat(F.lit("def "), F.col("name"), F.lit("():"))), inner)
    has_init = F.col("line_number") % 10 == 0
    init_lines = F.when(has_init, F.array(F.lit(IND + "def __init__(self):"),
                                          F.lit(IND + IND + "setup()"))
                        ).otherwise(F.array().cast("array<string>"))
    method_lines = F.concat(
        F.array(F.concat(F.lit("class K"), F.col("id").cast("string"), F.lit(":"))), init_lines,
        F.array(F.concat(F.lit(IND + "def "), F.col("name"), F.lit("(self):"))),
        F.transform(inner, lambda x: F.concat(F.lit(IND), x)))
    lines = F.when(F.col("type") == "method", method_lines).otherwise(fn_lines)
    return c.select("id", "name", sc_path.alias("sc_path"), file_no.alias("file_no"),
                    "docstring", "line_number", "calls", lines.alias("lines"))


def sc_files(spark: SparkSession, sf_dir: str, broken: bool = False,
             materialize: bool = True) -> DataFrame:
    """``files(path, content)``; each group holds at most 100 blocks.

    The corpus is stored once (reliable checkpoint in the session's checkpoint folder), as
    a source table would be, in ``2 x`` the default parallelism partitions, or as many as shuffles
    begin with where that is more: it is small in bytes, so adaptive coalescing would otherwise
    hand the CPU-heavy extraction of every file to a few tasks.
    """
    b = sc_blocks(spark, sf_dir).select(
        "sc_path", "file_no", F.col("id").alias("k"), F.array_join("lines", "\n").alias("v"))
    if materialize:
        # One shuffle: a user-numbered hash partitioning by file is kept as it is by adaptive
        # execution, and it already satisfies the grouping below.
        b = b.repartition(max(spark.sparkContext.defaultParallelism * 2, initial_partitions(spark)), "sc_path")
    grouped = (b.groupBy("sc_path", "file_no")
                .agg(F.collect_list(F.struct("k", "v")).alias("blocks")))
    body = F.array_join(F.concat(F.array(*[F.lit(x) for x in FILE_HEADER]),
                                 F.transform(F.sort_array("blocks"), lambda x: x["v"])), "\n")
    content = F.concat(body, F.lit("\n"))
    files = grouped.select(F.col("sc_path").alias("path"), "file_no", content.alias("content"))
    if broken:
        spoilt = F.struct(F.regexp_replace("path", r"\.py$", "_spoilt.py").alias("path"),
                          F.concat("content", F.lit(BROKEN_TAIL + "\n")).alias("content"))
        whole = F.struct("path", "content")
        files = files.select(F.explode(F.when(F.col("file_no") % 10 == 9, F.array(whole, spoilt))
                                       .otherwise(F.array(whole))).alias("f")).select("f.path", "f.content")
    files = files.select("path", "content")
    if not materialize:
        return files
    ensure_checkpoint_dir(spark)
    return files.checkpoint(eager=True)


def _raw(spark, sf_dir, broken=False):
    return extract.extract_chunks(sc_files(spark, sf_dir, broken))


def q_extract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2c + S2 over the whole synthetic corpus."""
    good = extract.good_chunks(_raw(spark, sf_dir))
    return good.select("path", F.col("chunk_no").cast("long").alias("chunk_no"), "name", "type",
                       "parent_class", "line_number", "body_start_line", "docstring", "content")


def q_call_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 + P7 + H11: resolved, builtin-free, deduplicated call lists."""
    good = extract.good_chunks(_raw(spark, sf_dir))
    return good.select("path", "name", F.size("calls").cast("long").alias("n_calls"),
                       F.array_join("calls", ",").alias("calls_text"))


def q_rejects_per_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that failed to parse, counted per top-level directory."""
    rej = extract.find_rejects(sc_files(spark, sf_dir, broken=True))
    return (rej.groupBy(F.substring_index("path", "/", 1).alias("dir"))
               .agg(F.count(F.lit(1)).cast("long").alias("n_rejects")))


def q_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 chunk table: extraction, first-wins by name, dense ids."""
    idx = build_index(sc_files(spark, sf_dir))
    return idx.chunks.select("id", "name", "path", "type", "line_number")


def q_index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 edge table with the ids of the built index."""
    idx = build_index(sc_files(spark, sf_dir))
    return idx.edges


def q_index_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 over the built index: all pieces of every chunk (120/30, so that most are cut)."""
    idx = build_index(sc_files(spark, sf_dir, broken=False), size=120, overlap=30)
    return idx.pieces.select("chunk_id", F.col("piece_no").cast("long").alias("piece_no"), "content")


def _path_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = views.cg_chunks(spark, sf_dir).select(_sc_path().alias("path")).distinct()
    p = F.col("path")
    variants = F.array(
        p, F.concat(F.lit(".git/"), p), F.concat(F.lit("venv/"), p),
        F.concat(F.lit("lib/venv/"), p), F.concat(F.lit("lib/.cache/"), p),
        F.regexp_replace(p, "([^/]+)$", ".$1"), F.regexp_replace(p, r"\.py$", ".pyc"),
        F.concat(F.lit("venv2/"), p), F.concat(F.lit("_build/"), p),
        F.regexp_replace(p, "([^/]+)$", "__$1"))
    return paths.select(F.explode(variants).alias("path"))


def q_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate paths the corpus scan keeps."""
    return corpus.filter_sources(_path_variants(spark, sf_dir))


def q_corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + S1: the corpus written as a source tree, among files that a scan must not see, and
    scanned back."""
    files = sc_files(spark, sf_dir)
    p, unseen = F.col("path"), F.array(
        F.lit(".git/"), F.lit("venv/"), F.lit("lib/venv/"), F.lit("lib/.cache/"))
    planted = files.select(F.explode(F.concat(
        F.transform(unseen, lambda d: F.concat(d, p)),
        F.array(F.regexp_replace(p, "([^/]+)$", ".$1"), F.concat(p, F.lit(".txt"))))).alias("path"), "content")
    root = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex[:12]}"
    corpus.write_directory(files.unionByName(planted), root)
    return corpus.scan_directory(spark, root)


def q_corpus_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of a corpus frame."""
    return corpus.corpus_shape(read_table(spark, sf_dir, "documents"))


def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of documents by source."""
    return index.value_counts(read_table(spark, sf_dir, "documents"), "source")


def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: documents keyed by text; the lowest doc_id wins."""
    docs = read_table(spark, sf_dir, "documents")
    return index.first_wins(docs, ["text"], ["doc_id"])


def q_first_wins_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Was this document the one that created its key?"""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (index.first_wins_flags(docs, ["text"], ["doc_id"])
                 .select("doc_id", F.col("is_new").cast("int").alias("is_new")))


def q_split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed 2000/200 windows over every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (split.window_pieces(docs, "text")
                 .select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), "piece"))


def q_split_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-aware 2000/200 split of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return (split.split_pieces(docs, "content")
                 .select("doc_id", F.col("piece_no").cast("long").alias("piece_no"),
                         F.col("content").alias("piece")))


def q_sc_edges_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction then X3 over the corpus: must equal the CG edges (plus resolved imports)."""
    good = extract.good_chunks(_raw(spark, sf_dir)).where(F.col("name").startswith("part_"))
    ids = good.select(F.regexp_extract("name", r"^part_(\d+)$", 1).cast("long").alias("id"),
                      "calls")
    return graph.build_edges(ids)


QUERIES = {
    "extract_chunks": q_extract_chunks,
    "call_lists": q_call_lists,
    "rejects_per_dir": q_rejects_per_dir,
    "index_chunks": q_index_chunks,
    "index_edges": q_index_edges,
    "index_pieces": q_index_pieces,
    "sc_edges_roundtrip": q_sc_edges_roundtrip,
    "corpus_scan": q_corpus_scan,
    "corpus_roundtrip": q_corpus_roundtrip,
    "corpus_shape": q_corpus_shape,
    "value_counts": q_value_counts,
    "first_wins": q_first_wins,
    "first_wins_flags": q_first_wins_flags,
    "split_windows": q_split_windows,
    "split_pack": q_split_pack,
}
