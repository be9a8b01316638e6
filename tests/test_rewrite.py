"""End to end: corpus -> prompts -> (answers from outside) -> rewritten corpus."""

import ast

from chunkgraph.plans.index_build import build_index
from chunkgraph.plans.rewrite import prompts_for_corpus, rewrite_corpus

SAMPLE = "def my_function(a, b):\n    return a + b\n"

MODULE = '''import os

class Store:
    """Keeps things."""
    def __init__(self, root):
        self.root = root

    def save(self, name):
        return os.path.join(self.root, name)

    def load(self, name):
        """Load one."""
        return open(self.save(name)).read()


def helper():
    return Store("/tmp").load("x")
'''


def test_undocumented_function_gets_a_docstring(spark):
    files = spark.createDataFrame([("sample.py", SAMPLE)], "path string, content string")
    prompts = prompts_for_corpus(files).collect()
    assert [p.name for p in prompts] == ["my_function"]
    assert prompts[0].prompt.startswith("### Context from Codebase:\n\n\n### Target Code:\n")
    answers = spark.createDataFrame([(prompts[0].target_id,
                                      '```python\n"""Add two numbers.\n\nReturns the sum."""\n```')],
                                    "target_id long, raw string")
    out = rewrite_corpus(files, answers)
    text = out.files.first().content
    assert '"""' in text and "my_function(a, b)" in text
    assert text == ('def my_function(a, b):\n    """\n    Add two numbers.\n    \n'
                    '    Returns the sum.\n    """\n\n    return a + b\n')
    assert [r.docstring for r in out.chunks.collect()] == ["DONE"]


def test_module_rewrite_keeps_code_and_documents_targets(spark):
    files = spark.createDataFrame([("m.py", MODULE), ("other.py", "x = 1\n")],
                                  "path string, content string")
    idx = build_index(files)
    prompts = {p.name: p for p in prompts_for_corpus(files, idx).collect()}
    assert set(prompts) == {"save", "helper"}      # Store and load are documented
    # load calls self.save, which never matches the chunk "save" (exact names), so save has
    # no context; helper calls Store(...) and Store(...).load(...) -> "Store" and "load"
    assert prompts["save"].prompt.startswith("### Context from Codebase:\n\n\n")
    assert prompts["helper"].prompt.count("--- Source: m.py ---") == 2
    assert "class Store" in prompts["helper"].prompt
    answers = spark.createDataFrame([(p.target_id, f'"""Docs for {n}."""') for n, p in prompts.items()],
                                    "target_id long, raw string")
    out = rewrite_corpus(files, answers, idx)
    texts = {r.path: r.content for r in out.files.collect()}
    assert texts["other.py"] == "x = 1\n"
    tree = ast.parse(texts["m.py"])  # still valid Python
    docs = {n.name: ast.get_docstring(n) for n in ast.walk(tree)
            if isinstance(n, (ast.FunctionDef, ast.ClassDef))}
    assert docs == {"Store": "Keeps things.", "__init__": None, "save": "Docs for save.",
                    "load": "Load one.", "helper": "Docs for helper."}
    assert not any(r.warn_one_line for r in out.edits.collect())
