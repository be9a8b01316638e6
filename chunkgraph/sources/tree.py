"""A source tree as a data source: ``spark.read.format("source_tree")`` and its writer.

Reading (S1/P6): the driver lists names and sizes, pruned while walking (hidden folders and
``venv`` are never entered), and packs the files into input partitions of about
``partitionBytes``; beyond ``listLimit`` names the folders still to walk become partitions of
their own, so what the driver holds is bounded however large the tree is. Spark's own file
lister is not used: it hides every name that starts with ``_`` (``__init__.py``).

Writing (S9): a new tree appears as a whole or not at all. Tasks write into a staging folder
beside it - each file under a temporary name, then renamed, so a retried task writes the same
bytes again; the job's commit renames the folder, its abort removes it. A tree that exists is
never written to, and a path that leaves the tree fails the job.

The tree must be on a filesystem that the driver and all executors mount.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

from chunkgraph.fixed import PRUNED_DIR, SOURCE_SUFFIX
from chunkgraph.schemas import FILES

FORMAT = "source_tree"
PARTITION_BYTES = 16 << 20
LIST_LIMIT = 1_000_000
_FLUSH_CHARS = 8 << 20


def keep_dir(name: str) -> bool:
    return not name.startswith(".") and name != PRUNED_DIR


def is_source_name(name: str) -> bool:
    return name.endswith(SOURCE_SUFFIX) and not name.startswith(".")


def local_path(path: str) -> str:
    """``file:`` URIs as the paths they stand for."""
    if path.startswith("file:"):
        path = path[5:]
        path = "/" + path.lstrip("/")
    return os.path.abspath(path)


def list_folder(root: str, rel: str) -> tuple[list[tuple[str, int]], list[str]]:
    """``(files with sizes, folders to enter)`` of one folder, like one step of ``os.walk``:
    links to folders are not entered. A folder that cannot be listed fails the scan: leaving
    its files out in silence would be worse."""
    files, dirs = [], []
    with os.scandir(os.path.join(root, rel)) as entries:
        for e in entries:
            path = os.path.join(rel, e.name) if rel else e.name
            try:
                is_dir = e.is_dir()
            except OSError:
                is_dir = False
            if is_dir:
                if keep_dir(e.name) and not e.is_symlink():
                    dirs.append(path)
            elif is_source_name(e.name):
                try:
                    files.append((path, e.stat().st_size))
                except OSError:
                    files.append((path, 0))  # a dangling link: a file without content
    return files, dirs


@dataclass
class TreePartition(InputPartition):
    """Files to read, and folders to walk and read."""

    files: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()


def plan_partitions(root: str, partition_bytes: int, list_limit: int) -> list[TreePartition]:
    """Breadth first, so that what is left to walk when the limit is reached are few, large folders."""
    found: list[tuple[str, int]] = []
    todo = [""]
    while todo and len(found) + len(todo) < list_limit:
        files, dirs = list_folder(root, todo.pop(0))
        found += files
        todo += dirs
    out, held, total = [], [], 0
    for path, size in sorted(found):
        held.append(path)
        total += size + 1024  # opening a file costs something, too
        if total >= partition_bytes:
            out.append(TreePartition(files=tuple(held)))
            held, total = [], 0
    if held:
        out.append(TreePartition(files=tuple(held)))
    return out + [TreePartition(folders=(d,)) for d in todo]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.list_limit = int(options.get("listlimit", LIST_LIMIT))
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")

    def partitions(self) -> list[TreePartition]:
        # A tree without sources still is one (empty) partition.
        return plan_partitions(self.root, self.partition_bytes, self.list_limit) or [TreePartition()]

    def _paths(self, partition: TreePartition) -> Iterator[str]:
        yield from partition.files
        todo = list(partition.folders)
        while todo:
            files, dirs = list_folder(self.root, todo.pop())
            yield from sorted(f for f, _ in files)
            todo += dirs

    def read(self, partition: TreePartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.string())])
        paths, contents, held = [], [], 0
        for path in self._paths(partition):
            try:
                # Text mode: universal newlines, as the tool reads its sources.
                with open(os.path.join(self.root, path), encoding="utf-8") as fh:
                    text = fh.read()
            except (OSError, UnicodeDecodeError):
                text = None  # a reject of the extraction
            paths.append(path)
            contents.append(text)
            held += len(text or "") + 256
            if held >= _FLUSH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())],
                                                 schema=schema)
                paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())],
                                             schema=schema)


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root = local_path(options["path"])
        if overwrite:
            raise ValueError("a source tree is written anew, never over another; use mode('append')")
        if os.path.exists(self.root):
            raise FileExistsError(f"{self.root} exists; sources are never rewritten in place")
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex[:12]}"
        os.makedirs(self.staging)

    def write(self, iterator) -> WriterCommitMessage:
        # The temporary file stands beside its target: renames between folders wait for one
        # another on the whole filesystem, and one folder for all of them is a queue as well.
        made, mine = set(), uuid.uuid4().hex
        for no, row in enumerate(iterator):
            rel = os.path.normpath(row["path"])
            if rel.startswith("..") or os.path.isabs(rel):
                raise ValueError(f"path leaves the tree: {row['path']!r}")
            target = os.path.join(self.staging, rel)
            folder = os.path.dirname(target)
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            tmp = os.path.join(folder, f".{mine}-{no}")
            with open(tmp, "w", encoding="utf-8", newline="") as fh:
                fh.write(row["content"] or "")
            os.replace(tmp, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        os.rename(self.staging, self.root)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SourceTree(DataSource):
    """``files(path, content)`` of a folder; paths are relative to it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter({k.lower(): v for k, v in self.options.items()}, overwrite)
