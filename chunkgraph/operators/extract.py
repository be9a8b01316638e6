"""Source files -> chunk rows.

One Arrow job parses each file once and reports *facts*, one flat row per definition that can
become a chunk: its kind, names, lines, the text it stands for and the dotted names of its call
sites as the imports seen so far bind them. A file that cannot be parsed is one row with the
error. What follows from the facts - types, the builtin filter, dedup and order of calls, the
indentation - is column expressions over those rows; nothing is nested, filtered twice or cut
from the text again, so the plan holds one Arrow job and no shuffle.

What a file yields:

* module level, class bodies and compound statements count; function bodies do not (a
  nested ``def`` belongs to its outer chunk, imports inside functions are unseen);
* a function chunk is the ``def`` segment (decorators excluded); its type is ``method``
  inside a class, else ``function`` / ``async_function``;
* a class chunk runs from the ``class`` line to the line before the first method, or -
  when that first method is ``__init__`` - to the line before the second method, with
  ``__init__`` folded into the class chunk (and its calls becoming the class's calls);
  without such a method it is the whole class segment;
* ``calls``: every call under the node, its dotted name resolved through the imports
  seen so far, builtins dropped, deduplicated and sorted.

Newlines are normalised first, as a text-mode read does. A file that cannot be parsed, or
whose texts cannot be stored as UTF-8, gives exactly one reject row with the error.
"""

from __future__ import annotations

import ast
import builtins
import os
import pickle
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkgraph.fixed import (INIT_METHOD, TYPE_ASYNC_FUNCTION, TYPE_CLASS, TYPE_FUNCTION,
                              TYPE_METHOD)
from chunkgraph.functions import text as tx
from chunkgraph.schemas import RAW_CHUNKS
from chunkgraph.session import ship_package

#: One row per definition. ``margin`` is what stands before it on its line, ``sites`` are the
#: names of its calls in the order of the source.
FACTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("no", T.IntegerType()),
    T.StructField("kind", T.StringType()),            # def, async or class
    T.StructField("name", T.StringType()),
    T.StructField("scope", T.StringType()),           # innermost enclosing class
    T.StructField("line", T.IntegerType()),
    T.StructField("body_line", T.IntegerType()),
    T.StructField("doc", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("margin", T.StringType()),
    T.StructField("sites", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])
_ARROW = pa.schema([(f.name, {"int": pa.int32(), "string": pa.string()}.get(
    f.dataType.simpleString(), pa.list_(pa.string()))) for f in FACTS])
REJECTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_KIND = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "async", ast.ClassDef: "class"}


class _Source:
    """A source text with its lines; columns of the parser count UTF-8 bytes."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()
        self.raw = b"" if self.plain else text.encode()
        lines = text.split("\n") if self.plain else self.raw.split(b"\n")
        self.at = [0, *accumulate(len(x) + 1 for x in lines)]
        self._lines: list[str] | None = None

    def _cut(self, lo: int, hi: int) -> str:
        return self.text[lo:hi] if self.plain else self.raw[lo:hi].decode()

    def segment(self, node: ast.stmt) -> str:
        return self._cut(self.at[node.lineno - 1] + node.col_offset,
                         self.at[node.end_lineno - 1] + node.end_col_offset)

    def margin(self, node: ast.stmt) -> str:
        lo = self.at[node.lineno - 1]
        return self._cut(lo, lo + node.col_offset)

    def rows(self, first: int, stop: int) -> str:
        """Lines ``first`` to ``stop - 1`` with their ends; every boundary of str.splitlines counts."""
        if self._lines is None:
            self._lines = self.text.splitlines(keepends=True)
        return "".join(self._lines[first - 1:stop - 1])


def _site(func: ast.AST, bound: dict[str, str]) -> str | None:
    """Dotted name of a call; a leading name goes through its import binding, a base
    that is no name leaves the attributes."""
    parts: list[str] = []
    if type(func) is ast.Name:
        return bound.get(func.id, func.id)
    while isinstance(func, ast.Attribute):
        parts.append(func.attr)
        func = func.value
    if isinstance(func, ast.Name):
        parts.append(bound.get(func.id, func.id))
    return ".".join(reversed(parts)) if parts else None


#: What need not be entered to find calls: nodes without nodes below them, and plain values.
_LEAVES = frozenset({ast.Name, ast.Constant, ast.Pass, ast.alias, type(None), str, int, bool})
_PLAIN = frozenset({"ctx", "op", "ops", "id", "attr", "name", "type_comment"})
_BELOW: dict[type, tuple[str, ...]] = {}


def _calls(node: ast.AST) -> list[ast.Call]:
    """The calls under a node, in the order of ``ast.walk``."""
    todo: list[ast.AST] = [node]
    for sub in todo:
        kind = type(sub)
        if kind is ast.Expr:  # most statements, and a call: the same without a look at every field
            if type(sub.value) not in _LEAVES:
                todo.append(sub.value)
            continue
        if kind is ast.Call:
            if type(sub.func) not in _LEAVES:
                todo.append(sub.func)
            if sub.args:
                todo += [x for x in sub.args if type(x) not in _LEAVES]
            todo += sub.keywords
            continue
        fields = _BELOW.get(kind)
        if fields is None:
            fields = _BELOW[kind] = tuple(f for f in kind._fields if f not in _PLAIN)
        for field in fields:
            value = getattr(sub, field, None)
            if type(value) is list:
                todo += [x for x in value if type(x) not in _LEAVES]
            elif type(value) not in _LEAVES:
                todo.append(value)
    return [sub for sub in todo if type(sub) is ast.Call]


def _sites(node: ast.AST, bound: dict[str, str]) -> list[str]:
    return [s for sub in _calls(node) if (s := _site(sub.func, bound)) is not None]


def _bind(node: ast.Import | ast.ImportFrom, bound: dict[str, str]) -> None:
    module = getattr(node, "module", None)
    for a in node.names:
        bound[a.asname or a.name] = f"{module}.{a.name}" if module else a.name


def file_facts(source: str) -> Iterator[tuple]:
    """The facts of one source, in its order: :data:`FACTS` without path, number and error."""
    src = _Source(source)
    bound: dict[str, str] = {}
    folded: set[int] = set()
    todo: list[tuple[ast.AST, str | None]] = [(ast.parse(source), None)]
    while todo:
        node, scope = todo.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            _bind(node, bound)
            continue
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)) and id(node) not in folded:
            text, called = None, node
            if isinstance(node, ast.ClassDef):
                methods = [m for m in node.body if isinstance(m, _FUNCTIONS)][:2]
                called = None
                if methods and methods[0].name == INIT_METHOD:
                    called = methods.pop(0)
                    folded.add(id(called))
                if methods:
                    text = src.rows(node.lineno, methods[0].lineno)
            yield (_KIND[type(node)], node.name, scope, node.lineno, node.body[0].lineno,
                   ast.get_docstring(node), src.segment(node) if text is None else text,
                   src.margin(node), _sites(called, bound) if called else [])
        if not isinstance(node, _FUNCTIONS):
            inner = node.name if isinstance(node, ast.ClassDef) else scope
            todo += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]


def _facts_of(path: str, content: str | None) -> list[tuple]:
    """Rows of :data:`FACTS`: the file's definitions, or its error."""
    try:
        if content is None:
            raise ValueError("file has no content")
        rows = [(path, i, *facts, None) for i, facts in enumerate(file_facts(content))]
        for row in rows:  # escapes such as "\ud800" parse, but are no text
            (row[7] or "").encode()
        return rows
    except SyntaxError as exc:
        error = f"SyntaxError: {exc.msg} (line {exc.lineno})"
    except Exception as exc:  # noqa: BLE001 - any failure isolates the file, not the task
        error = f"{type(exc).__name__}: {exc}"
    return [(path, *[None] * (len(FACTS) - 2), error)]


# Output batches are flushed by size, so memory stays bounded however many files an input
# batch holds.
_FLUSH_ROWS = 4096
_FLUSH_CHARS = 16 << 20
#: Files and characters that one child process parses.
_CHILD_FILES = 4096
_CHILD_CHARS = 16 << 20


def _send(out, batch: list[tuple[str, str | None]]) -> None:
    """In the child: the rows of the files, a few hundred at a time, then an end mark."""
    rows: list[tuple] = []
    chars = 0
    for path, content in batch:
        rows += _facts_of(path, content)
        chars += len(content or "")
        if len(rows) >= _FLUSH_ROWS // 8 or chars >= _FLUSH_CHARS // 8:
            pickle.dump(rows, out, pickle.HIGHEST_PROTOCOL)
            rows, chars = [], 0
    pickle.dump(rows, out, pickle.HIGHEST_PROTOCOL)
    pickle.dump(None, out)
    out.flush()


def _parsed(batch: list[tuple[str, str | None]]) -> Iterator[list[tuple]]:
    """Rows of :data:`FACTS` of the files, parsed in a child process. The parser keeps every name
    that it ever met for as long as its process lives (interned for good), and Spark's Python
    workers live as long as the executor: in them the names of a whole corpus would pile up."""
    source, sink = os.pipe()
    child = os.fork()
    if child == 0:
        status = 1
        try:
            os.close(source)
            with os.fdopen(sink, "wb", 1 << 16) as out:
                _send(out, batch)
            status = 0
        finally:
            os._exit(status)  # nothing of the worker is run or closed here
    os.close(sink)
    try:
        with os.fdopen(source, "rb", 1 << 16) as rows:
            while (part := pickle.load(rows)) is not None:
                yield part
    except EOFError:
        raise RuntimeError(f"the parser died in one of the files {batch[0][0]} to {batch[-1][0]}") from None
    finally:
        os.waitpid(child, 0)


def _portions(batches) -> Iterator[list[tuple[str, str | None]]]:
    held: list[tuple[str, str | None]] = []
    chars = 0
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((path, content))
            chars += len(content or "")
            if len(held) >= _CHILD_FILES or chars >= _CHILD_CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _read_batches(batches):
    rows: list[tuple] = []
    chars = 0
    for portion in _portions(batches):
        for part in _parsed(portion):
            rows += part
            chars += sum(len(r[8] or "") for r in part)
            if len(rows) >= _FLUSH_ROWS or chars >= _FLUSH_CHARS:
                yield _table(rows, _ARROW)
                rows, chars = [], 0
    yield _table(rows, _ARROW)


def _reject_batches(batches):
    schema = pa.schema([_ARROW.field("path"), _ARROW.field("error")])
    for portion in _portions(batches):
        found = [(r[0], r[-1]) for part in _parsed(portion) for r in part if r[-1] is not None]
        yield _table(found, schema)


def _sources(files: DataFrame, path_col: str, content_col: str, spread: int | None) -> DataFrame:
    """``(path, content)``; ``spread`` redistributes the files round-robin first (useful when the
    source has fewer, larger partitions than there are cores)."""
    ship_package(files.sparkSession)
    src = files.select(F.col(path_col).alias("path"),
                       tx.normalize_newlines(content_col).alias("content"))
    return src.repartition(spread) if spread else src


def extract_facts(files: DataFrame, path_col: str = "path", content_col: str = "content",
                  spread: int | None = None) -> DataFrame:
    """The Arrow job (:data:`FACTS`)."""
    return _sources(files, path_col, content_col, spread).mapInArrow(_read_batches, FACTS)


def clean_calls(sites: Column) -> Column:
    """Call names without builtins (a hash set, whatever their number), each once, sorted."""
    return F.sort_array(F.array_distinct(F.filter(sites, lambda n: ~n.isin(*sorted(dir(builtins))))))


def chunk_rows(facts: DataFrame) -> DataFrame:
    """Facts -> chunk rows (:data:`RAW_CHUNKS`), rejects included."""
    is_class = F.col("kind") == "class"
    kind = (F.when(is_class, TYPE_CLASS).when(F.col("scope").isNotNull(), TYPE_METHOD)
            .when(F.col("kind") == "async", TYPE_ASYNC_FUNCTION).when(F.col("kind") == "def", TYPE_FUNCTION))
    return facts.select(
        "path", F.col("no").alias("chunk_no"), "name", kind.alias("type"),
        F.when(~is_class, F.col("scope")).alias("parent_class"), F.col("text").alias("content"),
        F.col("line").alias("line_number"), F.col("body_line").alias("body_start_line"),
        F.col("doc").alias("docstring"), clean_calls(F.col("sites")).alias("calls"),
        tx.indentation("margin").alias("func_indent"), "error").select([f.name for f in RAW_CHUNKS])


def extract_chunks(files: DataFrame, path_col: str = "path", content_col: str = "content",
                   spread: int | None = None) -> DataFrame:
    """Chunk and reject rows of a corpus (:data:`RAW_CHUNKS`); rows with ``error IS NOT
    NULL`` are rejects."""
    return chunk_rows(extract_facts(files, path_col, content_col, spread))


def good_chunks(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("error").isNull()).drop("error")


def rejects(raw: DataFrame) -> DataFrame:
    """One row per file that could not be parsed."""
    return raw.where(F.col("error").isNotNull()).select("path", "error")


def find_rejects(files: DataFrame, path_col: str = "path", content_col: str = "content",
                 spread: int | None = None) -> DataFrame:
    """S2 straight from the files: only the rejects leave the Python workers."""
    return _sources(files, path_col, content_col, spread).mapInArrow(_reject_batches, REJECTS)
