"""Values that must equal the documented tool's for identical results.

Fixed values, stated as text in natural order; the operators import them from here.
"""

# Prompt and context text.
PROMPT_CONTEXT_HEADER = "### Context from Codebase:\n"
PROMPT_CODE_HEADER = "\n\n### Target Code:\n"
SOURCE_HEADER_PREFIX = "--- Source: "
SOURCE_HEADER_SUFFIX = " ---\n"
SOURCE_UNKNOWN = "unknown"
CONTEXT_SEPARATOR = "\n\n"

# Ranking defaults and the marker a documented target carries.
TOP_N = 10
DEPENDENCY_RATIO = 0.6
DONE_MARKER = "DONE"

# Splitting defaults and the separator order of the Python-aware splitter.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
PYTHON_SEPARATORS = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")

# Chunk type names and the method folded into its class.
TYPE_FUNCTION = "function"
TYPE_ASYNC_FUNCTION = "async_function"
TYPE_METHOD = "method"
TYPE_CLASS = "class_definition"
INIT_METHOD = "__init__"

# Corpus scan rules (source suffix, pruned folder name; names starting with
# a dot are hidden).
SOURCE_SUFFIX = ".py"
PRUNED_DIR = "venv"

# Docstring blocks - the quotes, and the indent added to the definition's.
QUOTES = ('"""', "'''")
DOCSTRING_INDENT = "    "

# Answer cleaning, as Java regular expressions - the text between the first
# pair of triple quotes (dot matches newline), the opening python fence (any case) with its
# newline, any other fence with the newline before it, then runs of double and of single
# quotes at both ends.
TRIPLE_QUOTE_PAIR = "(?s)(?:\"\"\"|''')(.*?)(?:\"\"\"|''')"
PYTHON_FENCE = "(?i)```python\n?"
ANY_FENCE = "\n?```"
DOUBLE_QUOTE_RUNS = '^"+|"+\\z'
SINGLE_QUOTE_RUNS = "^'+|'+\\z"

# The characters for which Python's str.isspace() is true, written as a
# Java regex character-class body: tab, newline, U+000B, form feed, carriage return,
# U+001C-U+001F, space, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F,
# U+205F, U+3000.
PY_WS = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

# Evaluation-set sample size.
SAMPLE_SIZE = 50
