"""Extraction job (X1/X2/S2) on small modules, run through Spark."""

import ast

import pytest

from chunkgraph.operators import extract
from chunkgraph.plans.index_build import build_index
from tests.conftest import SF_SMALL

SHAPES = '''
import math as m
from shapes import units as u

def area(w, h):
    """Area in square units."""
    return u.scale(w * h)

def diagonal(w, h):
    """Length of the diagonal."""
    return round(m.sqrt(w * w + h * h)) + area(w, h)
'''

ACCOUNT = '''
class Account:
    """An account with a balance."""
    def __init__(self, owner):
        self.owner = check(owner)

    def deposit(self, amount):
        """Add money."""
        self.total += amount

    @property
    def balance(self):
        """Money left."""
        return self.total
'''

MIXED = '''
class Tree:
    def grow(self):
        def ring():
            bark()
        return ring()

    class Leaf:
        def fall(self):
            import json
            return json.dumps({})

async def rain():
    await cloud()

def autumn():
    json.loads("1")
    season().turn.red()
    str.join(",", [])
    (lambda: 1)()
'''


def run(spark, sources):
    files = spark.createDataFrame(list(sources.items()), "path string, content string")
    rows = extract.extract_chunks(files).collect()
    return sorted(rows, key=lambda r: (r.path, r.chunk_no if r.chunk_no is not None else -1))


def test_functions_and_their_docstrings(spark):
    rows = run(spark, {"s.py": SHAPES})
    assert [(r.name, r.type, r.docstring, r.line_number, r.body_start_line) for r in rows] == [
        ("area", "function", "Area in square units.", 5, 6),
        ("diagonal", "function", "Length of the diagonal.", 9, 10)]
    assert rows[0].content.splitlines()[-1] == "    return u.scale(w * h)"


def test_calls_go_through_import_bindings_and_skip_builtins(spark):
    a, d = run(spark, {"s.py": SHAPES})
    assert a.calls == ["shapes.units.scale"] and d.calls == ["area", "math.sqrt"]


def test_class_takes_its_init(spark):
    cls, deposit, balance = run(spark, {"a.py": ACCOUNT})
    assert (cls.name, cls.type, cls.parent_class, cls.docstring, cls.calls) == (
        "Account", "class_definition", None, "An account with a balance.", ["check"])
    assert cls.content.startswith("class Account:") and "__init__" in cls.content
    assert cls.content.rstrip().endswith("self.owner = check(owner)")
    assert (deposit.type, deposit.parent_class, deposit.func_indent) == ("method", "Account", "    ")
    assert balance.content.startswith("def balance") and balance.docstring == "Money left."


def test_function_bodies_are_not_entered(spark):
    rows = {r.name: r for r in run(spark, {"m.py": MIXED})}
    assert set(rows) == {"Tree", "grow", "Leaf", "fall", "rain", "autumn"}
    assert rows["grow"].calls == ["bark", "ring"] and rows["Leaf"].parent_class is None
    assert rows["fall"].parent_class == "Leaf" and rows["rain"].type == "async_function"
    # the import inside fall() is unseen; a call on a call keeps its attributes only
    assert rows["autumn"].calls == ["json.loads", "season", "str.join", "turn.red"]


def test_imports_of_every_form_and_their_order(spark):
    src = ("def before():\n    q.go()\n\n"
           "import a.b as q\nimport c.d\nfrom . import near\nfrom ..pkg import far as away\n"
           "from e import *\n\n"
           "def after():\n    q.go(); c.d.go(); near.x(); away(); c.z()\n\n"
           "if True:\n    import f as q\n\n"
           "def last():\n    q.go()\n")
    rows = {r.name: r.calls for r in run(spark, {"m.py": src})}
    assert rows == {"before": ["q.go"], "last": ["f.go"],
                    "after": ["a.b.go", "c.d.go", "c.z", "near.x", "pkg.far"]}


def test_class_level_imports_are_unknown_to_the_folded_init(spark):
    src = "class C:\n    import x as y\n    def __init__(self):\n        y.a()\n    def m(self):\n        y.a()\n"
    rows = {r.name: r.calls for r in run(spark, {"c.py": src})}
    assert rows == {"C": ["y.a"], "m": ["x.a"]}


def test_compound_statements_in_classes(spark):
    src = ("class C:\n    if True:\n        def __init__(self):\n            g()\n"
           "    else:\n        async def alt(self):\n            h()\n")
    rows = {r.name: r for r in run(spark, {"c.py": src})}
    # an __init__ that is not directly in the class body stays a method of its own
    assert set(rows) == {"C", "__init__", "alt"} and rows["alt"].type == "method"
    assert rows["C"].content == src.rstrip("\n")


def test_one_line_def_and_decorated_class_slice(spark):
    src = ("def tiny(): pass\n\nclass Box:\n    side = 1\n    @staticmethod\n    def unit():\n"
           "        return make()\n")
    rows = {r.name: r for r in run(spark, {"m.py": src})}
    assert rows["tiny"].body_start_line == rows["tiny"].line_number == 1
    # the class text runs to the line before the def, so it holds the method's decorator
    assert rows["Box"].content == "class Box:\n    side = 1\n    @staticmethod\n"
    assert rows["unit"].content.startswith("def unit():") and rows["unit"].calls == ["make"]


def test_decorators_and_async_init(spark):
    src = ("import functools as ft\n\n@ft.lru_cache(maxsize=None)\ndef cached(x):\n    return look(x)\n\n"
           "class Svc:\n    async def __init__(self):\n        await boot()\n\n"
           "    async def run(self):\n        pass\n")
    rows = {r.name: r for r in run(spark, {"m.py": src})}
    assert rows["cached"].calls == ["functools.lru_cache", "look"] and rows["cached"].line_number == 4
    assert set(rows) == {"cached", "Svc", "run"} and rows["Svc"].calls == ["boot"]


def test_files_that_fail_are_rejects_and_harm_no_other(spark):
    rows = run(spark, {"bad.py": "class :\n", "odd.py": 'def f():\n    "\\ud800"\n', "none.py": None,
                       "nul.py": "x = 1\x00", "ok.py": SHAPES})
    errors = {r.path: r.error for r in rows if r.error}
    assert set(errors) == {"bad.py", "odd.py", "none.py", "nul.py"}
    assert errors["bad.py"].startswith("SyntaxError") and "Unicode" in errors["odd.py"]
    assert [r.name for r in rows if r.error is None] == ["area", "diagonal"]


def test_other_newlines_give_the_same_chunks(spark):
    for end in ("\r\n", "\r"):
        a = run(spark, {"s.py": ACCOUNT})
        b = run(spark, {"s.py": ACCOUNT.replace("\n", end)})
        assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_index_of_a_small_repository(spark):
    files = spark.createDataFrame(
        [("pkg/one.py", "def ping():\n    pong()\n\ndef pong():\n    pass\n"),
         ("pkg/zwei.py", "def pong():\n    return 2\n")], "path string, content string")
    idx = build_index(files)
    assert {r.name: (r.path, list(r.calls)) for r in idx.chunks.collect()} == {
        "ping": ("pkg/one.py", ["pong"]), "pong": ("pkg/one.py", [])}
    assert [(r.caller_id, r.callee) for r in idx.edges.collect()] == [(1, "pong")]
    assert idx.rejects.count() == 0


SOURCES = [SHAPES, ACCOUNT, MIXED, "async def a():\n    '''ü\n    ü'''\n    await b()  # ñ\n",
           "x = 1\ndef h():\n\tif x:\n\t\treturn (1,\n\t\t        2)\n", "class Ü:\n    def g(self): 'é'; return 'é'\n"]


@pytest.mark.parametrize("i", range(len(SOURCES)))
def test_segments_equal_the_standard_helper(i):
    src = SOURCES[i]
    texts = sorted(text for kind, *_, text, _, _ in extract.file_facts(src) if kind != "class")
    top = [n for n in ast.walk(ast.parse(src)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    assert set(texts) <= {ast.get_source_segment(src, n) for n in top}


def test_every_file_is_parsed_in_one_job(spark):
    files = spark.createDataFrame([("s.py", SHAPES), ("bad.py", "class :\n")], "path string, content string")
    plan = extract.extract_chunks(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Exchange" not in plan
    assert [r.path for r in extract.find_rejects(files).collect()] == ["bad.py"]


def test_corpus_definitions_are_all_found(spark):
    from chunkgraph.plans.corpus import sc_files
    for r in sc_files(spark, SF_SMALL, broken=False).collect():
        found = [f[1] for f in extract.file_facts(r.content)]
        tree = ast.parse(r.content)
        want = [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ClassDef))
                and n.name != "__init__"]  # folded into its class
        assert sorted(found) == sorted(want)


def test_names_do_not_stay_in_the_worker():
    """The parser interns names for good: parsed in the worker, 200,000 of them take 20 MB."""
    import pyarrow as pa

    def resident():
        with open("/proc/self/status") as fh:
            return next(int(line.split()[1]) for line in fh if line.startswith("VmRSS")) / 1024

    def batches(first, n):
        for i in range(first, first + n):
            text = "def f():\n" + "".join(f"    call_{i}_{k}()\n" for k in range(10_000))
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.py"]), pa.array([text])], names=["path", "content"])

    from chunkgraph.llm.common import release
    held = []
    for first in (0, 20, 40):
        assert sum(b.num_rows for b in extract._read_batches(batches(first, 20))) == 20
        release()
        held.append(resident())
    assert held[2] - held[1] < 10, held


def test_a_parser_that_dies_fails_the_task(monkeypatch):
    import os
    monkeypatch.setattr(extract, "_facts_of", lambda path, content: os._exit(3))
    with pytest.raises(RuntimeError, match="parser died in one of the files a.py to b.py"):
        list(extract._parsed([("a.py", ""), ("b.py", "")]))


def test_portions_end_by_files_and_by_size(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(extract, "_CHILD_FILES", 3)
    monkeypatch.setattr(extract, "_CHILD_CHARS", 10)
    texts = ["x = 1"] * 4 + ["y = 123456789"] + [None] * 2 + [""]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(8)]), pa.array(texts, pa.string())],
                                       names=["path", "content"])
    parts = list(extract._portions([batch]))
    assert [len(p) for p in parts] == [2, 2, 1, 3]
    assert [c for p in parts for _, c in p] == texts


@pytest.mark.parametrize("module", ["ast", "argparse", "typing", "dataclasses", "enum"])
def test_calls_are_those_of_the_plain_walk(module):
    import importlib
    with open(importlib.import_module(module).__file__) as fh:
        tree = ast.parse(fh.read())
    assert extract._calls(tree) == [n for n in ast.walk(tree) if isinstance(n, ast.Call)]


def test_calls_are_those_of_a_walk_in_its_order():
    odd = """
f(1)(g(x=h()), *a(), **b(c()))
1.5()
b"x"()
...()
x.y[z()](lambda q=d(): e())
async def k():
    return await [m(i) async for i in n()]
(yield_ := o(p)) if r() else s.t.u()
"""
    tree = ast.parse(odd)
    assert extract._calls(tree) == [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    seen = []
    fields = extract._BELOW
    extract._BELOW = type("Seen", (dict,), {"get": lambda self, k: seen.append(k) or dict.get(self, k)})(fields)
    try:
        extract._calls(ast.parse("f()\n" * 50))
    finally:
        extract._BELOW = fields
    assert len(seen) <= 1  # plain call statements are entered without a look at every field
