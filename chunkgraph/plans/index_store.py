"""The stored index: versions, get-or-create, lookups of few chunks, stored adjacency.

An index folder holds *parts* and *manifests*::

    parts/<part>/chunks      whole chunk rows, range-partitioned and sorted by name, with Parquet
                             Bloom filters on name and id
    parts/<part>/zones       one row per chunk file: least and greatest name, rows
    parts/<part>/heads       (id, name, path, type) bucketed and sorted by name
    parts/<part>/ids         the same bucketed and sorted by id
    parts/<part>/by_caller   edges bucketed and sorted by caller_id
    parts/<part>/by_callee   edges bucketed and sorted by callee, with the caller's columns
    manifest/<version>.json  the parts of a version; written last, whole or not at all

A version is what its manifest names. A build that dies leaves folders that no manifest names:
the version before stays whole and readable, until :meth:`IndexStore.vacuum` removes what the
last versions do not name. Two writers cannot both commit a version; the second one fails.

Rows are only ever appended: a name that is stored keeps its row and its id, whatever comes
later (get-or-create), so an added batch is one more part. Parts are merged once there are
more than ``MAX_PARTS``. Bucketed folders are read as bucketed tables, so joins on the bucket
key move only the other side, and a few literal keys read only their buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.operators import extract, graph, index
from chunkgraph.schemas import CHUNKS, EDGES
from chunkgraph.session import store
from chunkgraph.sources import shared_fs

MAX_PARTS = 4
#: Lookups of up to so many distinct names read the files and buckets of those names; more are
#: joined with whole tables.
FEW = 1000

HEADS = T.StructType([CHUNKS[c] for c in ("id", "name", "path", "type")])
CALLERS = T.StructType([EDGES["callee"], EDGES["caller_id"], T.StructField("caller_name", T.StringType()),
                        T.StructField("caller_path", T.StringType()),
                        T.StructField("caller_type", T.StringType())])
#: Bucketed folders: columns and key.
_BUCKETED = {"heads": (HEADS, "name"), "ids": (HEADS, "id"), "by_caller": (EDGES, "caller_id"), "by_callee": (CALLERS, "callee")}


class VersionConflict(RuntimeError):
    """Another writer committed the version this one was to be."""


@dataclass
class Part:
    name: str
    rows: int


@dataclass
class Manifest:
    version: int
    buckets: int
    last_id: int = 0
    parts: list[Part] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to exactly the columns and types of ``schema``; a nullable
    column that ``df`` lacks is null."""
    return df.select(*[(F.lit(None) if f.nullable and f.name not in df.columns else F.col(f.name))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class IndexStore:
    """An index folder in a session."""

    def __init__(self, spark: SparkSession, base: str, buckets: int | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        have = self.manifest()
        self.buckets = have.buckets if have else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # ------------------------------------------------------------- versions

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest version's manifest (or the given one's), None where nothing is committed."""
        found = [n for n in shared_fs.names(self.spark, f"{self.base}/manifest") if n.endswith(".json")]
        if version is not None:
            found = [n for n in found if int(n[:-5]) == version]
        if not found:
            return None
        raw = json.loads(shared_fs.read_text(self.spark, f"{self.base}/manifest/{found[-1]}"))
        return Manifest(raw["version"], raw["buckets"], raw["last_id"], [Part(**p) for p in raw["parts"]])

    def _commit(self, m: Manifest) -> Manifest:
        path = f"{self.base}/manifest/{m.version:08d}.json"
        if not shared_fs.write_new(self.spark, path, json.dumps(asdict(m), indent=1)):
            raise VersionConflict(f"version {m.version} of {self.base} was committed by another writer")
        return m

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` versions, and folders of builds that did not commit.
        Returns the parts deleted. Not to be run while another writer builds."""
        manifests = [n for n in shared_fs.names(self.spark, f"{self.base}/manifest") if n.endswith(".json")]
        for n in manifests[:-keep]:
            shared_fs.delete(self.spark, f"{self.base}/manifest/{n}")
        kept = {p.name for n in manifests[-keep:] for p in self.manifest(int(n[:-5])).parts}
        gone = [p for p in shared_fs.names(self.spark, f"{self.base}/parts") if p not in kept]
        for p in gone:
            shared_fs.delete(self.spark, f"{self.base}/parts/{p}")
        return gone

    # ------------------------------------------------------------- writing

    def _write_bucketed(self, df: DataFrame, part: str, what: str) -> None:
        schema, key = _BUCKETED[what]
        table = f"cg_write_{uuid.uuid4().hex}"
        # One task per bucket: the shuffle deals rows as the buckets do, so each is one file.
        (conform(df, schema).repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key)
            .option("path", f"{self.base}/parts/{part}/{what}").saveAsTable(table))
        self.spark.sql(f"DROP TABLE {table}")  # external: the files stay

    def _write_part(self, chunks: DataFrame, edges: DataFrame | None = None) -> Part:
        part = uuid.uuid4().hex[:16]
        folder = f"{self.base}/parts/{part}"
        writer = conform(chunks, CHUNKS).repartitionByRange("name").sortWithinPartitions("name").write
        for c in ("name", "id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{folder}/chunks")
        stored = self.spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
        zones = stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(
            F.min("name").alias("lo"), F.max("name").alias("hi"), F.count(F.lit(1)).alias("n"))
        zones.coalesce(1).write.parquet(f"{folder}/zones")  # one row per file
        self._write_bucketed(stored, part, "heads")
        self._write_bucketed(stored, part, "ids")
        self._write_bucketed(graph.build_edges(stored) if edges is None else edges, part, "by_caller")
        rows = self.spark.read.parquet(f"{folder}/zones").agg(F.sum("n").alias("n")).first().n or 0
        self._write_bucketed(self._with_callers(Part(part, rows)), part, "by_callee")
        return Part(part, rows)

    def _with_callers(self, part: Part) -> DataFrame:
        """The edges of a part with their callers. Both folders lie in buckets of the caller's id:
        they meet where they are."""
        caller = self._bucketed("ids", part).select(
            F.col("id").alias("caller_id"), F.col("name").alias("caller_name"),
            F.col("path").alias("caller_path"), F.col("type").alias("caller_type"))
        return self._bucketed("by_caller", part).join(caller.hint("merge"), "caller_id")

    def publish(self, chunks: DataFrame, edges: DataFrame | None = None) -> Manifest:
        """A new version with these chunks (``CHUNKS``, ids given) and nothing else."""
        last = self.manifest()
        part = self._write_part(chunks, edges)
        top = self._read("chunks", CHUNKS, [part]).agg(F.max("id").alias("m")).first().m or 0
        return self._commit(Manifest(last.version + 1 if last else 1, self.buckets, top, [part]))

    def build_once(self, files: DataFrame | Callable[[], DataFrame]) -> Manifest:
        """Index ``files`` unless the stored index has chunks. The manifest alone decides,
        before anything is extracted; a callable is not even called."""
        have = self.manifest()
        if have and have.rows:
            return have
        return self.upsert(files() if callable(files) else files)[0]

    def upsert(self, files: DataFrame, spread: int | None = None) -> tuple[Manifest, DataFrame]:
        """A1 + W2 + S10, get-or-create: add the definitions of ``files`` whose names are new.

        Of several definitions of a new name the first in (path, chunk_no) order is stored; ids
        go on from the greatest stored one in that order. Returns the new version and
        ``(path, chunk_no, name, id, created)`` of every definition in ``files``: the id its
        name stands for, and whether this definition made it.
        """
        have = self.manifest() or Manifest(0, self.buckets)
        raw = store(extract.extract_chunks(files, spread=spread), "raw-chunks")
        good = extract.good_chunks(raw)
        firsts = index.first_wins(good.select("name", "path", "chunk_no"), ["name"], ["path", "chunk_no"])
        for part in have.parts:
            stored = self._bucketed("heads", part).select(F.col("name").alias("_n"))
            firsts = firsts.join(stored, F.col("name") == F.col("_n"), "left_anti")
        ids = index.dense_ids(firsts.select("path", "chunk_no"), ["path", "chunk_no"], "id",
                              start=have.last_id + 1)
        fresh = good.join(ids, ["path", "chunk_no"])
        part = self._write_part(fresh)
        m = Manifest(have.version + 1, self.buckets, have.last_id + part.rows,
                     [*have.parts, part] if part.rows else have.parts)
        if len(m.parts) > MAX_PARTS:
            m.parts = [self._write_part(self._read("chunks", CHUNKS, m.parts))]
        self._commit(m)
        rows = good.select("path", "chunk_no", "name")
        known = _union([rows.join(self._bucketed("heads", p).select("name", "id"), "name") for p in m.parts]
                       or [rows.withColumn("id", F.lit(None).cast("long")).limit(0)])
        created = ids.select(F.col("id").alias("_new"), F.col("path").alias("_p"), F.col("chunk_no").alias("_c"))
        outcome = known.join(
            created, (F.col("id") == F.col("_new")) & (F.col("path") == F.col("_p"))
            & (F.col("chunk_no") == F.col("_c")), "left")
        return m, outcome.select("path", "chunk_no", "name", "id", F.col("_new").isNotNull().alias("created"))

    # ------------------------------------------------------------- reading

    def _current(self, m: Manifest | None) -> Manifest:
        m = m or self.manifest()
        if m is None:
            raise FileNotFoundError(f"no index in {self.base}")
        return m

    def _read(self, what: str, schema: T.StructType, parts: list[Part]) -> DataFrame:
        paths = [f"{self.base}/parts/{p.name}/{what}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucketed(self, what: str, part: Part) -> DataFrame:
        """A bucketed folder as a table of this session's catalog."""
        schema, key = _BUCKETED[what]
        table = f"cg_{what}_{part.name}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key})"
                           f" INTO {self.buckets} BUCKETS LOCATION '{self.base}/parts/{part.name}/{what}'")
        return self.spark.table(table)

    def chunks(self, m: Manifest | None = None) -> DataFrame:
        """All chunk rows of a version."""
        return self._read("chunks", CHUNKS, self._current(m).parts)

    def edges(self, m: Manifest | None = None) -> DataFrame:
        """All edges of a version."""
        return self._read("by_caller", EDGES, self._current(m).parts)

    def heads(self, m: Manifest | None = None) -> DataFrame:
        return self._read("heads", HEADS, self._current(m).parts)

    # ------------------------------------------------------------- few chunks

    def chunks_named(self, names: list[str], m: Manifest | None = None) -> DataFrame:
        """Rows of these names: the zones name the files that can hold them, the sorted row
        groups and Bloom filters do the rest."""
        m = self._current(m)
        wanted = sorted(set(names))
        if not wanted or not m.parts:
            return self.spark.createDataFrame([], CHUNKS)
        zone = "file string, lo string, hi string, n long"
        paths = []
        for p in m.parts:
            zones = self.spark.read.schema(zone).parquet(f"{self.base}/parts/{p.name}/zones")
            inside = F.exists(F.array(*map(F.lit, wanted)), lambda w: (w >= F.col("lo")) & (w <= F.col("hi")))
            paths += [f"{self.base}/parts/{p.name}/chunks/{r.file}" for r in zones.where(inside).select("file").collect()]
        if not paths:
            return self.spark.createDataFrame([], CHUNKS)
        return self.spark.read.schema(CHUNKS).parquet(*paths).where(F.col("name").isin(wanted))

    def chunks_with_ids(self, ids: list[int], m: Manifest | None = None) -> DataFrame:
        """Rows of these ids, by way of their names; an id without a chunk fails the lookup."""
        m = self._current(m)
        wanted = sorted(set(ids))
        got = {r.id: r.name for r in self._matching("ids", "id", wanted, m).collect()} if m.parts else {}
        lost = [i for i in wanted if i not in got]
        if lost:
            raise KeyError(f"no chunk with id {lost[0]}")
        return self.chunks_named(list(got.values()), m)

    def _matching(self, what: str, key: str, values: list, m: Manifest) -> DataFrame:
        """Rows of a bucketed folder with these keys: only their buckets are read."""
        return _union([self._bucketed(what, p).where(F.col(key).isin(values)) for p in m.parts])

    def context_candidates(self, targets: list[str], m: Manifest | None = None) -> DataFrame:
        """J3/J4/U1 for a few target names, in the form :func:`graph.context_candidates` has,
        read from the buckets and files of those names and of their neighbours."""
        m = self._current(m)
        if len(targets) > FEW:
            raise ValueError(f"at most {FEW} targets; use graph.context_candidates for more")
        spec = ("target_id long, target_path string, cand_id long, cand_name string, cand_path string,"
                " cand_has_doc boolean, dep int")
        found = self.chunks_named(targets, m).select("id", "name", "path").collect()
        if not found:
            return self.spark.createDataFrame([], spec)
        t = self.spark.createDataFrame([(r.id, r.name, r.path) for r in found],
                                       "target_id long, target_name string, target_path string")
        down = self._matching("by_caller", "caller_id", [r.id for r in found], m).select(
            F.col("caller_id").alias("target_id"), F.col("callee").alias("cand_name"), F.lit(1).alias("dep"))
        up = self._matching("by_callee", "callee", [r.name for r in found], m).select(
            F.col("callee").alias("target_name"), F.col("caller_name").alias("cand_name"), F.lit(0).alias("dep"))
        pairs = t.join(down, "target_id").select("target_id", "target_path", "cand_name", "dep").unionByName(
            t.join(up, "target_name").select("target_id", "target_path", "cand_name", "dep"))
        pairs = store(pairs.groupBy("target_id", "target_path", "cand_name").agg(F.max("dep").alias("dep")),
                      "few-candidates")
        near = [r.cand_name for r in pairs.select("cand_name").distinct().limit(FEW + 1).collect()]
        rows = self.chunks_named(near, m) if len(near) <= FEW else self.chunks(m)
        c = rows.select(F.col("name").alias("cand_name"), F.col("id").alias("cand_id"),
                        F.col("path").alias("cand_path"), F.col("docstring").isNotNull().alias("cand_has_doc"))
        return pairs.join(c, "cand_name").select(*[f.split()[0] for f in spec.split(", ")])

    # ------------------------------------------------------------- adjacency

    def _resolved(self, m: Manifest | None) -> DataFrame:
        """Every edge with both ends: folders bucketed alike, merged without moving a row."""
        m = self._current(m)
        out = []
        for e in m.parts:
            for h in m.parts:
                edges, heads = self._bucketed("by_callee", e), self._bucketed("heads", h)
                out.append(edges.join(heads.hint("merge"), edges["callee"] == heads["name"]))
        return _union(out)

    def dependencies(self, m: Manifest | None = None) -> DataFrame:
        """J1 of every chunk: ``chunk_id, dep_id, dep_name, dep_path, dep_type``."""
        return self._resolved(m).select(F.col("caller_id").alias("chunk_id"), F.col("id").alias("dep_id"),
                                        F.col("name").alias("dep_name"), F.col("path").alias("dep_path"),
                                        F.col("type").alias("dep_type"))

    def dependents(self, m: Manifest | None = None) -> DataFrame:
        """J2 of every chunk: ``chunk_id, user_id, user_name, user_path, user_type``."""
        return self._resolved(m).select(F.col("id").alias("chunk_id"), F.col("caller_id").alias("user_id"),
                                        F.col("caller_name").alias("user_name"),
                                        F.col("caller_path").alias("user_path"),
                                        F.col("caller_type").alias("user_type"))
