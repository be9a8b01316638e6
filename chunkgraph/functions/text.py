"""Scalar string/array/JSON functions as Column expressions.

Everything here compiles to built-in Catalyst expressions (regex, array higher-order
functions), so it runs inside whole-stage code generation with no Python worker.

Python's ``str.strip()``/``str.isspace()`` treat a wider set of characters as whitespace
than Java's ``\\s``; the class below spells that set out so the column expressions strip
exactly what the Python tool strips.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkgraph.fixed import (ANY_FENCE, CONTEXT_SEPARATOR, DOCSTRING_INDENT,  # noqa: F401
                              DOUBLE_QUOTE_RUNS, PROMPT_CODE_HEADER, PROMPT_CONTEXT_HEADER,
                              PY_WS, PYTHON_FENCE, QUOTES, SINGLE_QUOTE_RUNS, SOURCE_HEADER_PREFIX,
                              SOURCE_HEADER_SUFFIX, SOURCE_UNKNOWN, TRIPLE_QUOTE_PAIR)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same characters as :data:`PY_WS`, spelled out for the trim functions, which look at the
#: ends of a text only.
PY_WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def py_strip(c) -> Column:
    """``str.strip()``: remove Python whitespace at both ends."""
    return F.btrim(_col(c), F.lit(PY_WS_CHARS))


def has_content(c) -> Column:
    """``bool(line.strip())``: the text has at least one non-whitespace character."""
    return _col(c).rlike(f"[^{PY_WS}]")


def has_quotes(c) -> Column:
    """Triple quotes anywhere in the text: a cheap test before ends are stripped and compared."""
    return _col(c).contains(QUOTES[0]) | _col(c).contains(QUOTES[1])


def indentation(c) -> Column:
    """H1: the leading whitespace of a line."""
    return F.regexp_extract(_col(c), f"^([{PY_WS}]*)", 1)


def normalize_newlines(c) -> Column:
    """Universal newlines as Python's text-mode read applies them (``\\r\\n``, ``\\r`` -> ``\\n``)."""
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def split_lines(c) -> Column:
    """H5: split on ``\\n``; a trailing empty element is kept (limit -1)."""
    return F.split(_col(c), "\n", -1)


def slice_join(lines, start, length) -> Column:
    """H6: ``lines[start-1 : start-1+length]`` joined by ``\\n`` (1-based ``start``)."""
    return F.array_join(F.slice(_col(lines), _col(start), _col(length)), "\n")


def clean_response(c) -> Column:
    """H2: turn a free-text model answer into docstring text.

    1. take the text between the first pair of triple quotes (either kind), else all of it;
       strip whitespace;
    2. drop code-fence markers (an opening fence tagged python, any case, with its newline;
       every other fence with the newline before it);
    3. strip whitespace, then runs of double quotes, then runs of single quotes at both ends.
    """
    raw = _col(c)
    pair = TRIPLE_QUOTE_PAIR
    d = F.when(raw.rlike(pair), py_strip(F.regexp_extract(raw, pair, 1))).otherwise(py_strip(raw))
    d = F.regexp_replace(d, PYTHON_FENCE, "")
    d = F.regexp_replace(d, ANY_FENCE, "")
    d = py_strip(d)
    d = F.regexp_replace(d, DOUBLE_QUOTE_RUNS, "")
    d = F.regexp_replace(d, SINGLE_QUOTE_RUNS, "")
    return d


def format_block(doc, func_indent) -> Column:
    """H4: an indented docstring block, exactly as it is written into a file.

    Opening quotes line, one line per docstring line (blank lines become the bare
    indent), closing quotes line, then an empty line; the text ends with two newlines.
    """
    ind = F.concat(_col(func_indent), F.lit(DOCSTRING_INDENT))
    quotes = F.concat(ind, F.lit('"""'))
    body = F.transform(split_lines(doc),
                       lambda line: F.when(has_content(line), F.concat(ind, line)).otherwise(ind))
    return F.array_join(F.concat(F.array(quotes), body, F.array(quotes, F.lit("\n"))), "\n")


def source_header(path, content) -> Column:
    """``--- Source: <path or 'unknown'> ---`` followed by the content."""
    return F.concat(F.lit(SOURCE_HEADER_PREFIX), F.coalesce(_col(path), F.lit(SOURCE_UNKNOWN)),
                    F.lit(SOURCE_HEADER_SUFFIX), _col(content))


def prompt_text(context, code) -> Column:
    """H3: the user prompt built from the context text and the target code."""
    return F.concat(F.lit(PROMPT_CONTEXT_HEADER), _col(context),
                    F.lit(PROMPT_CODE_HEADER), _col(code))


def ordered_join(pairs, sep: str) -> Column:
    """Join ``array<struct<k, v>>`` values in ``k`` order (A5's ordered string aggregation)."""
    return F.array_join(F.transform(F.sort_array(_col(pairs)), lambda x: x["v"]), sep)


def calls_to_json(c) -> Column:
    """H8: list -> JSON text."""
    return F.to_json(_col(c))


def json_to_calls(c) -> Column:
    """H9: JSON text -> list of strings."""
    return F.from_json(_col(c), "array<string>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(value: Column) -> Column:
    """``value``, computed once where it stands.

    The optimiser copies an expression into every filter above it (an explode infers one),
    and chains of array functions then grow exponentially. It leaves non-deterministic
    columns alone, so the value is bound to a row id, which is never negative.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
