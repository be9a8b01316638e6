"""One JSON array of any size, read and written in parallel.

Reading cuts the file into byte ranges. Where a range begins - inside a string, after a
backslash, how deep - follows from everything before it, so the first job lets every range
report, for each state it could begin in, the state it ends in and how the depth changes; the
driver chains those few numbers; the second job then knows its start exactly, and each range
returns the records that begin in it, reading past its end to finish the last one. Any layout
of the array will do, and no task reads much more than its range.

Written arrays are a folder of parts whose texts, one after another, are one array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.session import ship_package, store

RANGE_BYTES = 32 << 20
_READ = 4 << 20

#: States between two bytes.
CODE, STRING, ESCAPE = 0, 1, 2
_TOKEN = {CODE: re.compile(rb'["{}\[\]]'), STRING: re.compile(rb'["\\]')}


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pafs.LocalFileSystem(), path)
    return system, inner


def _walk(data: bytes, state: int, depth: int) -> Iterator[tuple[int, int, int]]:
    """``(place, token, depth after it)`` of structural tokens; the last item is
    ``(len(data), state at the end, depth)``."""
    at, n = 0, len(data)
    while at < n:
        if state == ESCAPE:
            state, at = STRING, at + 1
            continue
        m = _TOKEN[state].search(data, at)
        if m is None:
            break
        c, at = data[m.start()], m.end()
        if state == STRING:
            state = CODE if c == 0x22 else ESCAPE
        elif c == 0x22:
            state = STRING
        else:
            depth += 1 if c in b"{[" else -1
            yield m.start(), c, depth
    yield n, state, depth


def _summaries(batches):
    """For each range and start state: the end state and the change of depth."""
    names = ["path", "lo", "start", "stop", "delta"]
    for batch in batches:
        out = []
        for path, lo, hi in zip(*(c.to_pylist() for c in batch.columns[:3])):
            system, inner = _open(path)
            ends = {s: (s, 0) for s in (CODE, STRING, ESCAPE)}
            with system.open_input_file(inner) as fh:
                for at in range(lo, hi, _READ):
                    data = fh.read_at(min(_READ, hi - at), at)
                    for s, (state, depth) in ends.items():
                        *_, (_, state, depth) = _walk(data, state, depth)
                        ends[s] = (state, depth)
            out += [(path, lo, s, *ends[s]) for s in ends]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else
                                         [pa.array([], pa.string()), *[pa.array([], pa.int64())] * 4], names=names)


def _records(batches):
    """Texts of the records that begin in each range (depth 1 -> 2)."""
    for batch in batches:
        for path, lo, hi, state, depth in zip(*(c.to_pylist() for c in batch.columns[:5])):
            system, inner = _open(path)
            out, kept, begun = [], b"", False
            with system.open_input_file(inner) as fh:
                at, size = lo, fh.size()
                while at < size and (at < hi or begun):
                    data = fh.read_at(min(_READ, size - at), at)
                    base, whole = len(kept), kept + data
                    start = 0 if begun else None
                    for place, token, after in _walk(data, state, depth):
                        if place == len(data):
                            state, depth = token, after
                        elif token in b"{[" and after == 2 and not begun:
                            if at + place >= hi:
                                break
                            begun, start = True, base + place
                        elif token in b"}]" and after == 1 and begun:
                            out.append(whole[start:base + place + 1].decode())
                            begun, start = False, None
                    kept = whole[start:] if begun else b""
                    at += len(data)
                    if sum(map(len, out)) >= _READ:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(p)  # a missing path fails here
    return sorted((s.getPath().toString(), s.getLen()) for s in found
                  if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``value``: the text of every record of a JSON array in one file, or in a folder of parts."""
    ship_package(spark)
    ranges, base = [], 0
    for name, size in _files(spark, path):
        ranges += [(_uri(name), lo, min(lo + range_bytes, size)) for lo in range(0, size, range_bytes)]
    spec = "path string, lo long, hi long"
    if not ranges:
        return spark.createDataFrame([], "value string")
    dealt = spark.createDataFrame(ranges, spec).repartition(len(ranges), "path", "lo")
    told = {(r.path, r.lo, r.start): (r.stop, r.delta) for r in dealt.mapInArrow(
        _summaries, "path string, lo long, start long, stop long, delta long").collect()}
    state, depth, known = CODE, 0, []
    for name, lo, hi in ranges:
        known.append((name, lo, hi, state, depth))
        stop, delta = told[name, lo, state]
        state, depth = stop, depth + delta
    if depth != 0 or state != CODE:
        raise ValueError(f"{path} is no whole JSON array")
    # Every range is a task of its own.
    rdd = spark.sparkContext.parallelize(known, len(known))
    return spark.createDataFrame(rdd, spec + ", state long, depth long").mapInArrow(_records, "value string")


def write_parts(values: DataFrame, path: str) -> None:
    """Write ``value`` (JSON texts, in the order of the partitions) as the parts of one array."""
    staged = store(values.select("value", F.spark_partition_id().alias("_pid"),
                                 F.monotonically_increasing_id().alias("_at")), "array-records")
    ends = staged.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    if ends.lo is None:
        values.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    text = F.concat(F.when(F.col("_at") == ends.lo, F.lit("[")).otherwise(F.lit(",")), "value",
                    F.when(F.col("_at") == ends.hi, F.lit("]")).otherwise(F.lit("")))
    (staged.repartitionByRange("_at").sortWithinPartitions("_at").select(text.alias("value"))
           .write.text(path))
