"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark plans: candidate dedup is a ``GROUP BY``
instead of the Spark side's pre-aggregated union, ids come from ``row_number()``, line
tables from ``unnest``, and so on. Integer outputs are BIGINT unless the source column is
INTEGER.
"""

from __future__ import annotations

from chunkgraph.fixed import CHUNK_OVERLAP, CHUNK_SIZE, PYTHON_SEPARATORS
from chunkgraph.operators.rank import SYSTEM_TEXT

CG = """
WITH cg_edges_num AS (
  SELECT DISTINCT a, b FROM (
    SELECT l_partkey AS a,
           LEAD(l_partkey) OVER (PARTITION BY l_orderkey
                                 ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
    FROM lineitem) t
  WHERE b IS NOT NULL),
cg_edges AS (
  SELECT a AS caller_id, 'part_' || CAST(b AS VARCHAR) AS callee FROM cg_edges_num),
cg_chunks AS (
  SELECT p_partkey AS id,
         'part_' || CAST(p_partkey AS VARCHAR) AS name,
         (CASE WHEN p_size % 7 = 0 THEN 'tests/' ELSE 'src/' END)
           || replace(lower(p_brand), '#', '_') || '.py' AS path,
         CASE WHEN p_size % 5 = 0 THEN 'method' ELSE 'function' END AS type,
         CASE WHEN p_size % 5 = 0 THEN p_type END AS parent_class,
         p_name AS content,
         p_size AS line_number,
         CASE WHEN p_size % 3 <> 0 THEN p_type END AS docstring
  FROM part),
targets AS (SELECT * FROM cg_chunks WHERE docstring IS NULL)
"""

# Candidate union and ranking, shared by the context queries.
CG_RANK = CG + """,
cand AS (
  SELECT t.id AS target_id, c.id AS cand_id, 1 AS dep
  FROM targets t JOIN cg_edges e ON e.caller_id = t.id JOIN cg_chunks c ON c.name = e.callee
  UNION ALL
  SELECT t.id, c.id, 0
  FROM targets t JOIN cg_edges e ON e.callee = t.name JOIN cg_chunks c ON c.id = e.caller_id),
uni AS (SELECT target_id, cand_id, max(dep) AS dep FROM cand GROUP BY target_id, cand_id),
keyed AS (
  SELECT u.target_id, u.cand_id, c.name AS cand_name, c.path AS cand_path, u.dep,
         CASE WHEN u.dep = 1 THEN (c.docstring IS NOT NULL OR c.id < u.target_id)
              ELSE lower(c.path) LIKE '%test%' END AS k1,
         CASE WHEN u.dep = 1 THEN c.path = t.path ELSE c.path <> t.path END AS k2,
         COALESCE(c.docstring, CASE WHEN c.id < u.target_id THEN 'DONE' END) AS cand_docstring
  FROM uni u JOIN cg_chunks c ON c.id = u.cand_id JOIN cg_chunks t ON t.id = u.target_id),
ranked_all AS (
  SELECT *, row_number() OVER (PARTITION BY target_id, dep
                               ORDER BY k1 DESC, k2 DESC, cand_name DESC) AS rn
  FROM keyed),
ranked AS (
  SELECT target_id, cand_id, cand_name, cand_path, cand_docstring,
         CAST(dep AS INTEGER) AS dep, CAST(rn AS BIGINT) AS rn,
         CAST(dep * 4 + rn AS BIGINT) AS pos
  FROM ranked_all WHERE rn <= CASE WHEN dep = 1 THEN 6 ELSE 4 END),
ctx_rows AS (
  SELECT r.target_id, r.pos, c.path, c.name, c.type, c.parent_class, c.line_number,
         r.cand_docstring AS docstring, c.content
  FROM ranked r JOIN cg_chunks c ON c.id = r.cand_id),
ctx AS (
  SELECT target_id,
         string_agg('--- Source: ' || COALESCE(path, 'unknown') || ' ---' || chr(10) || content,
                    chr(10) || chr(10) ORDER BY pos) AS context
  FROM ctx_rows GROUP BY target_id)
"""

PY_WS_RE2 = ("\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
             "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
_STRIP = "regexp_replace({x}, '^[" + PY_WS_RE2 + "]+|[" + PY_WS_RE2 + "]+\\z', '', 'g')"
ORACLES: dict[str, str] = {}

ORACLES["edge_build"] = CG + "SELECT caller_id, callee FROM cg_edges"

ORACLES["undocumented"] = CG + "SELECT id, name, path FROM targets"

ORACLES["lookup_by_id"] = CG + """
SELECT t.id AS job_id, c.name, c.path, c.content AS current_code
FROM targets t JOIN cg_chunks c ON c.id = t.id"""

ORACLES["lookup_by_name_path"] = CG + """
SELECT e.caller_id, e.callee AS req_name, k.path AS req_path, f.id AS found_id
FROM cg_edges e JOIN cg_chunks k ON k.id = e.caller_id
LEFT JOIN cg_chunks f ON f.name = e.callee AND f.path = k.path"""

ORACLES["dependencies"] = CG + """
SELECT e.caller_id AS chunk_id, c.id AS dep_id, c.name AS dep_name, c.path AS dep_path,
       c.type AS dep_type
FROM cg_edges e JOIN cg_chunks c ON c.name = e.callee
WHERE e.caller_id IN (SELECT id FROM cg_chunks)"""

ORACLES["dependents"] = CG + """
SELECT t.id AS chunk_id, c.id AS user_id, c.name AS user_name, c.path AS user_path,
       c.type AS user_type
FROM cg_chunks t JOIN cg_edges e ON e.callee = t.name JOIN cg_chunks c ON c.id = e.caller_id"""

ORACLES["out_degree"] = CG + """
SELECT c.id, c.name,
       CAST(COUNT(e.callee) AS BIGINT) AS n_calls,
       CAST(COUNT(r.id) AS BIGINT) AS n_resolved
FROM cg_chunks c
LEFT JOIN cg_edges e ON e.caller_id = c.id
LEFT JOIN cg_chunks r ON r.name = e.callee
GROUP BY c.id, c.name"""

ORACLES["context_union"] = CG_RANK + """
SELECT target_id, cand_id, CAST(dep AS INTEGER) AS dep FROM uni"""

ORACLES["context_rank"] = CG_RANK + """
SELECT target_id, cand_id, cand_name, dep, rn, pos FROM ranked"""

ORACLES["context_rows"] = CG_RANK + "SELECT * FROM ctx_rows"

ORACLES["context_string"] = CG_RANK + "SELECT target_id, context FROM ctx"

ORACLES["prompts"] = CG_RANK + f"""
SELECT t.id AS target_id, t.name, t.path, '{SYSTEM_TEXT.replace("'", "''")}' AS system,""" + """
       '### Context from Codebase:' || chr(10) || COALESCE(x.context, '') || chr(10) || chr(10)
         || '### Target Code:' || chr(10) || t.content AS prompt
FROM targets t LEFT JOIN ctx x ON x.target_id = t.id"""

# Every chunk as a target, its callers and callees ranked by the stored docstrings.
CG_RANK_ALL = CG_RANK.replace("SELECT * FROM cg_chunks WHERE docstring IS NULL", "SELECT * FROM cg_chunks"
                              ).replace("(c.docstring IS NOT NULL OR c.id < u.target_id)",
                                        "(c.docstring IS NOT NULL)")

ORACLES["retrieve_by_name"] = CG_RANK_ALL + """
SELECT t.name, t.path, 'callee' AS role, c.id AS rel_id, c.name AS rel_name, c.path AS rel_path,
       CAST(NULL AS BIGINT) AS pos
FROM cg_chunks t JOIN cg_edges e ON e.caller_id = t.id JOIN cg_chunks c ON c.name = e.callee
UNION ALL
SELECT t.name, t.path, 'caller', c.id, c.name, c.path, NULL
FROM cg_chunks t JOIN cg_edges e ON e.callee = t.name JOIN cg_chunks c ON c.id = e.caller_id
UNION ALL
SELECT t.name, t.path, 'context', r.cand_id, r.cand_name, r.cand_path, CAST(r.pos AS BIGINT)
FROM ranked r JOIN cg_chunks t ON t.id = r.target_id"""

ORACLES["target_queue"] = CG + """
SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS place, id FROM targets"""

ORACLES["chunk_ids"] = CG + """
SELECT name, CAST(row_number() OVER (ORDER BY path, line_number, name) AS BIGINT) AS new_id
FROM cg_chunks"""

ORACLES["chunk_types"] = CG + """
SELECT type, CAST(COUNT(*) AS BIGINT) AS n FROM cg_chunks WHERE type IS NOT NULL GROUP BY type"""

ORACLES["index_stats"] = CG + """
SELECT 'chunks' AS stat, CAST(COUNT(*) AS BIGINT) AS value FROM cg_chunks
UNION ALL SELECT 'undocumented', CAST(COUNT(*) AS BIGINT) FROM targets
UNION ALL SELECT 'paths', CAST(COUNT(DISTINCT path) AS BIGINT) FROM cg_chunks
UNION ALL SELECT 'edges', CAST(COUNT(*) AS BIGINT) FROM cg_edges"""

ORACLES["calls_json"] = CG + """,
calls AS (SELECT caller_id, list_sort(list(callee)) AS calls FROM cg_edges GROUP BY caller_id)
SELECT c.id,
       CAST(to_json(COALESCE(k.calls, CAST([] AS VARCHAR[]))) AS VARCHAR) AS calls_json,
       CAST(len(COALESCE(k.calls, CAST([] AS VARCHAR[]))) AS BIGINT) AS n_calls,
       array_to_string(COALESCE(k.calls, CAST([] AS VARCHAR[])), ',') AS calls_text
FROM cg_chunks c LEFT JOIN calls k ON k.caller_id = c.id"""

ORACLES["mark_done"] = CG + """
SELECT id, CASE WHEN docstring IS NULL THEN 'DONE' ELSE docstring END AS docstring
FROM cg_chunks"""


# ---------------------------------------------------------------------------------------
# SC: the synthetic corpus, rebuilt from its definition (expected extraction results).
SC = CG + """,
cg_calls AS (SELECT caller_id, list_sort(list(callee)) AS calls FROM cg_edges GROUP BY caller_id),
sc_blocks AS (
  SELECT c.id, c.name, c.docstring, c.line_number,
         c.type = 'method' AS is_method,
         c.type = 'method' AND c.line_number % 10 = 0 AS has_init,
         COALESCE(k.calls, CAST([] AS VARCHAR[])) AS calls,
         c.id // 100 AS file_no,
         regexp_replace(c.path, '\\.py$', '') || '_' || CAST(c.id // 100 AS VARCHAR) || '.py' AS sc_path
  FROM cg_chunks c LEFT JOIN cg_calls k ON k.caller_id = c.id),
sc_inner AS (
  SELECT *,
    list_concat(list_concat(
      CASE WHEN docstring IS NULL THEN CAST([] AS VARCHAR[])
           WHEN line_number % 2 = 0 THEN ['    \"\"\"' || docstring || '\"\"\"']
           ELSE ['    \"\"\"', '    ' || docstring, '    \"\"\"'] END,
      CASE WHEN len(calls) = 0 THEN ['    pass']
           ELSE list_transform(calls, lambda x: '    ' || x || '()') END),
      CASE WHEN line_number % 4 = 1 THEN ['    osp.join("a")']
           WHEN line_number % 4 = 2 THEN ['    print(len("a"))']
           ELSE CAST([] AS VARCHAR[]) END) AS body_lines,
    CASE WHEN docstring IS NULL THEN 0 WHEN line_number % 2 = 0 THEN 1 ELSE 3 END AS n_doc,
    list_sort(list_concat(calls, CASE WHEN line_number % 4 = 1 THEN ['os.path.join']
                                      ELSE CAST([] AS VARCHAR[]) END)) AS calls_full,
    CASE WHEN has_init THEN ['    def __init__(self):', '        setup()']
         ELSE CAST([] AS VARCHAR[]) END AS init_lines
  FROM sc_blocks),
sc_lines AS (
  SELECT *,
    CASE WHEN is_method
         THEN list_concat(list_concat(list_concat(
                ['class K' || CAST(id AS VARCHAR) || ':'], init_lines),
                ['    def ' || name || '(self):']),
                list_transform(body_lines, lambda x: '    ' || x))
         ELSE list_concat(['def ' || name || '():'], body_lines) END AS lines,
    CASE WHEN is_method THEN 2 ELSE 1 END AS n_chunks
  FROM sc_inner),
sc_pos AS (
  SELECT *,
    4 + COALESCE(SUM(len(lines)) OVER w_prev, 0) AS block_line,
    1 + COALESCE(SUM(n_chunks) OVER w_prev, 0) AS chunk_base
  FROM sc_lines
  WINDOW w_prev AS (PARTITION BY sc_path ORDER BY id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sc_good AS (
  SELECT *, block_line + CASE WHEN NOT is_method THEN 0 WHEN has_init THEN 3 ELSE 1 END
              AS def_line
  FROM sc_pos),
sc_expected AS (
  SELECT DISTINCT sc_path AS path, CAST(0 AS BIGINT) AS chunk_no, 'setup' AS name,
         'function' AS type, CAST(NULL AS VARCHAR) AS parent_class,
         CAST(2 AS INTEGER) AS line_number, CAST(3 AS INTEGER) AS body_start_line,
         CAST(NULL AS VARCHAR) AS docstring, 'def setup():' || chr(10) || '    pass' AS content,
         CAST([] AS VARCHAR[]) AS calls
  FROM sc_good
  UNION ALL
  SELECT sc_path, CAST(chunk_base AS BIGINT), name, 'function', CAST(NULL AS VARCHAR),
         CAST(def_line AS INTEGER), CAST(def_line + 1 AS INTEGER), docstring,
         array_to_string(lines, chr(10)), calls_full
  FROM sc_good WHERE NOT is_method
  UNION ALL
  SELECT sc_path, CAST(chunk_base AS BIGINT), 'K' || CAST(id AS VARCHAR), 'class_definition',
         CAST(NULL AS VARCHAR), CAST(block_line AS INTEGER), CAST(block_line + 1 AS INTEGER),
         CAST(NULL AS VARCHAR),
         'class K' || CAST(id AS VARCHAR) || ':' || chr(10)
           || CASE WHEN has_init THEN '    def __init__(self):' || chr(10) || '        setup()'
                                      || chr(10) ELSE '' END,
         CASE WHEN has_init THEN ['setup'] ELSE CAST([] AS VARCHAR[]) END
  FROM sc_good WHERE is_method
  UNION ALL
  SELECT sc_path, CAST(chunk_base + 1 AS BIGINT), name, 'method', 'K' || CAST(id AS VARCHAR),
         CAST(def_line AS INTEGER), CAST(def_line + 1 AS INTEGER), docstring,
         'def ' || name || '(self):' || chr(10)
           || array_to_string(list_transform(body_lines, lambda x: '    ' || x), chr(10)),
         calls_full
  FROM sc_good WHERE is_method),
sc_index AS (
  SELECT CAST(row_number() OVER (ORDER BY path, chunk_no) AS BIGINT) AS id, *
  FROM (SELECT * FROM sc_expected
        WHERE name <> 'setup' OR path = (SELECT min(path) FROM sc_expected WHERE name = 'setup')) s)
"""

ORACLES["extract_chunks"] = SC + """
SELECT path, chunk_no, name, type, parent_class, line_number, body_start_line, docstring, content
FROM sc_expected"""

ORACLES["call_lists"] = SC + """
SELECT path, name, CAST(len(calls) AS BIGINT) AS n_calls, array_to_string(calls, ',') AS calls_text
FROM sc_expected"""

ORACLES["rejects_per_dir"] = SC + """
SELECT split_part(sc_path, '/', 1) AS dir, CAST(COUNT(DISTINCT sc_path) AS BIGINT) AS n_rejects
FROM sc_pos WHERE file_no % 10 = 9 GROUP BY 1"""



def _split_sql(source: str, key: str, text: str, size: int, overlap: int, separators) -> str:
    """CTEs ending in ``split_rows(key, piece_no, piece)``: the structure-aware splitter.

    Per separator: the cuts of every open text, runs of short cuts with their prefix sums
    ``p``, and a recursive walk over the pieces of a run, each the cuts ``a..e``. The next
    piece starts at the first cut from which the rest of this one fits the overlap.
    """
    def lit(x):
        return "'" + x.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"

    strip = _STRIP.replace("{x}", f"{text}")
    out = [f"""items_0 AS (
  SELECT {key}, [0] AS ord, {text} AS t, true AS o FROM {source} WHERE length({text}) >= {size}
  UNION ALL
  SELECT {key}, [0], {strip}, false FROM {source}
  WHERE length({text}) < {size} AND {strip} <> '')"""]
    for k, sep in enumerate(separators):
        has = "o" if sep == "" else f"(o AND contains(t, {lit(sep)}))"
        cuts = ("string_split(t, '')" if sep == "" else
                f"list_filter(list_transform(string_split(t, {lit(sep)}), lambda x, i: "
                f"CASE WHEN i = 1 THEN x ELSE {lit(sep)} || x END), lambda x: x <> '')")
        out.append(f"""
cut_{k} AS (SELECT {key}, ord, unnest(c) AS cut, generate_subscripts(c, 1) AS j
            FROM (SELECT {key}, ord, {cuts} AS c FROM items_{k} WHERE {has}) x),
grp_{k} AS (SELECT *, length(cut) AS n, length(cut) >= {size} AS long,
              CAST(sum(CASE WHEN length(cut) >= {size} THEN 1 ELSE 0 END)
                   OVER (PARTITION BY {key}, ord ORDER BY j) AS INTEGER) AS g FROM cut_{k}),
sum_{k} AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {key}, ord, g ORDER BY j) AS BIGINT) AS s
            FROM grp_{k} WHERE NOT long),
run_{k} AS (SELECT {key}, ord, g, list(cut ORDER BY j) AS c, list(s ORDER BY j) AS p
            FROM sum_{k} GROUP BY {key}, ord, g),
walk_{k} AS (
  SELECT {key}, ord, g, c, p, CAST(1 AS BIGINT) AS a, len(list_filter(p, lambda x: x <= {size})) AS e FROM run_{k}
  UNION ALL
  SELECT {key}, ord, g, c, p, a2, len(list_filter(p, lambda x: x <= {size} + CASE WHEN a2 = 1 THEN 0 ELSE p[a2 - 1] END))
  FROM (SELECT *, e + 1 - len(list_filter(range(1, e + 1), lambda x:
            p[e] - CASE WHEN x = 1 THEN 0 ELSE p[x - 1] END <= least({overlap}, {size} - (p[e + 1] - p[e])))) AS a2
        FROM walk_{k} WHERE e < len(p)) y),
piece_{k} AS (SELECT {key}, list_concat(ord, [g, 1, CAST(a AS INTEGER)]) AS ord,
                {_STRIP.replace("{x}", "array_to_string(c[a:e], '')")} AS t FROM walk_{k}),
items_{k + 1} AS (
  SELECT {key}, ord, t, o FROM items_{k} WHERE NOT {has}
  UNION ALL SELECT {key}, ord, t, false FROM piece_{k} WHERE t <> ''
  UNION ALL SELECT {key}, list_concat(ord, [g, 0, 0]), cut, true FROM grp_{k} WHERE long)""")
    out.append(f"""
split_rows AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ord) - 1 AS piece_no, t AS piece
               FROM items_{len(separators)})""")
    return ",".join(out)


ORACLES["split_pack"] = ("WITH RECURSIVE " + _split_sql("documents", "doc_id", "text", CHUNK_SIZE, CHUNK_OVERLAP,
                                                         PYTHON_SEPARATORS)
                         + " SELECT doc_id, CAST(piece_no AS BIGINT) AS piece_no, piece FROM split_rows")

# Small pieces, so that most definitions of the corpus are cut.
ORACLES["index_pieces"] = (SC.replace("WITH", "WITH RECURSIVE", 1) + ","
                           + _split_sql("sc_index", "id", "content", 120, 30, PYTHON_SEPARATORS)
                           + " SELECT id AS chunk_id, CAST(piece_no AS BIGINT) AS piece_no, piece AS content"
                             " FROM split_rows")

ORACLES["stored_index"] = SC + """
SELECT id, name, path, CAST(len(calls) AS BIGINT) AS n_edges FROM sc_index"""

ORACLES["index_chunks"] = SC + "SELECT id, name, path, type, line_number FROM sc_index"

ORACLES["index_edges"] = SC + """
SELECT id AS caller_id, callee FROM (SELECT id, unnest(calls) AS callee FROM sc_index) t"""

ORACLES["sc_edges_roundtrip"] = SC + """
SELECT id AS caller_id, callee FROM (SELECT id, unnest(calls_full) AS callee FROM sc_good) t"""

ORACLES["corpus_scan"] = SC + """,
files AS (SELECT DISTINCT sc_path AS p FROM sc_pos),
variants AS (
  SELECT unnest([p, '.git/' || p, 'venv/' || p, 'lib/venv/' || p, 'lib/.cache/' || p,
                 regexp_replace(p, '([^/]+)$', '.\\1'), regexp_replace(p, '\\.py$', '.pyc'),
                 'venv2/' || p, '_build/' || p, regexp_replace(p, '([^/]+)$', '__\\1')]) AS path
  FROM files),
parts AS (SELECT path, string_split(path, '/') AS comp FROM variants)
SELECT path FROM parts
WHERE ends_with(path, '.py')
  AND NOT starts_with(comp[len(comp)], '.')
  AND len(list_filter(comp[1:len(comp) - 1], lambda d: starts_with(d, '.') OR d = 'venv')) = 0"""

ORACLES["corpus_shape"] = """
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_cols,
       'doc_id,text,lang,source,n_chars' AS columns
FROM documents"""

ORACLES["value_counts"] = """
SELECT source, CAST(COUNT(*) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL GROUP BY source"""

ORACLES["first_wins"] = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars
FROM documents d JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) m
  ON m.doc_id = d.doc_id"""

ORACLES["first_wins_flags"] = """
SELECT doc_id, CAST(doc_id = min(doc_id) OVER (PARTITION BY text) AS INTEGER) AS is_new
FROM documents"""

ORACLES["split_windows"] = """
SELECT doc_id, CAST(s // 1800 AS BIGINT) AS piece_no, substring(text, s + 1, 2000) AS piece
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) + 1, 1800)) AS s
      FROM documents) t
WHERE length(substring(text, s + 1, 2000)) > 0"""


# ---------------------------------------------------------------------------------------
# Line tables, text functions and edits.
# Python's whitespace set (str.isspace) as an RE2 character-class body.

DOC_LINES = """
WITH d AS (
  SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS arr
  FROM documents)
"""

ORACLES["line_table"] = DOC_LINES + """
SELECT doc_id, CAST(i AS INTEGER) AS ln, arr[i] AS line
FROM (SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i FROM d) t"""

ORACLES["line_slice"] = DOC_LINES + """
SELECT doc_id, CAST(len(arr) AS BIGINT) AS n_lines,
       array_to_string(arr[2:len(arr) - 1], chr(10)) AS body
FROM d"""

ORACLES["format_block"] = f"""
WITH d AS (
  SELECT doc_id, repeat(' ', CAST(doc_id % 3 * 4 AS INTEGER)) || '    ' AS ind,
         string_split(text, chr(10)) AS arr
  FROM documents)
SELECT doc_id,
       array_to_string(list_concat(list_concat(
         [ind || '\"\"\"'],
         list_transform(arr, lambda l: CASE WHEN regexp_matches(l, '[^{PY_WS_RE2}]')
                                            THEN ind || l ELSE ind END)),
         [ind || '\"\"\"', chr(10)]), chr(10)) AS block
FROM d"""

_PAIR = "(?s)(?:\"\"\"|'''''')(.*?)(?:\"\"\"|'''''')"

ORACLES["clean_response"] = """
WITH r AS (
  SELECT conv_id, turn,
         CASE (conv_id + turn) % 4
           WHEN 0 THEN '\"\"\"' || text || '\"\"\"'
           WHEN 1 THEN '```python' || chr(10) || text || chr(10) || '```'
           WHEN 2 THEN 'Here it is: ''''''' || text || ''''''' done'
           ELSE '  ' || text || ' ' || chr(10) END AS raw
  FROM conversations),
s1 AS (
  SELECT conv_id, turn,
         CASE WHEN regexp_matches(raw, '""" + _PAIR + """')
              THEN """ + _STRIP.replace("{x}", "regexp_extract(raw, '" + _PAIR + "', 1)") + """
              ELSE """ + _STRIP.replace("{x}", "raw") + """ END AS d
  FROM r),
s2 AS (
  SELECT conv_id, turn,
         regexp_replace(regexp_replace(d, '(?i)```python\\n?', '', 'g'), '\\n?```', '', 'g') AS d
  FROM s1),
s3 AS (SELECT conv_id, turn, """ + _STRIP.replace("{x}", "d") + """ AS d FROM s2)
SELECT conv_id, turn,
       regexp_replace(regexp_replace(d, '^"+|"+\\z', '', 'g'), '^''+|''+\\z', '', 'g') AS docstring
FROM s3"""

SC_FILES = SC + """,
sc_file AS (
  SELECT sc_path, file_no,
         array_to_string(list_concat(['import os.path as osp', 'def setup():', '    pass'],
                                     flatten(list(lines ORDER BY id))), chr(10)) || chr(10) AS content
  FROM sc_lines GROUP BY sc_path, file_no),
sc_spoilt AS (
  SELECT regexp_replace(sc_path, '\\.py$', '_spoilt.py') AS path,
         content || 'def broken(:' || chr(10) AS content
  FROM sc_file WHERE file_no % 10 = 9),
sc_bounds AS (
  SELECT DISTINCT sc_path AS path, 'setup' AS name, CAST(3 AS INTEGER) AS body_start_line,
         CAST(NULL AS INTEGER) AS doc_start, CAST(NULL AS INTEGER) AS doc_end
  FROM sc_good
  UNION ALL
  SELECT sc_path, name, CAST(def_line + 1 AS INTEGER),
         CAST(CASE WHEN docstring IS NOT NULL THEN def_line + 1 END AS INTEGER),
         CAST(CASE WHEN docstring IS NULL THEN NULL
                   WHEN line_number % 2 = 0 THEN def_line + 1 ELSE def_line + 3 END AS INTEGER)
  FROM sc_good
  UNION ALL
  SELECT sc_path, 'K' || CAST(id AS VARCHAR), CAST(block_line + 1 AS INTEGER),
         CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
  FROM sc_good WHERE is_method)
"""

ORACLES["line_indent"] = """
WITH arrs AS (SELECT doc_id, repeat(' ', CAST(doc_id % 3 * 4 AS INTEGER)) AS ind,
                     string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS arr
              FROM documents WHERE text IS NOT NULL),
ls AS (SELECT doc_id, i, ind || arr[i] AS line FROM (SELECT doc_id, ind, arr, unnest(range(1, len(arr) + 1)) AS i FROM arrs) t)
SELECT doc_id, CAST(i AS INTEGER) AS ln, regexp_extract(line, '^[""" + PY_WS_RE2 + """]*') AS indent,
       CAST(length(regexp_extract(line, '^[""" + PY_WS_RE2 + """]*')) AS BIGINT) AS indent_len
FROM ls"""

ORACLES["block_bounds"] = SC_FILES + "SELECT path, name, doc_start, doc_end FROM sc_bounds"

ORACLES["edits_per_file"] = SC_FILES + """
SELECT path, CAST(COUNT(*) AS BIGINT) AS n_edits,
       string_agg(CAST(COALESCE(doc_start, body_start_line) AS VARCHAR) || '-'
                  || COALESCE(CAST(doc_end AS VARCHAR), ''), ',' ORDER BY body_start_line) AS spans
FROM sc_bounds GROUP BY path"""


def _new_block(name: str, calls_text: str, ind: str) -> str:
    """The lines of a freshly written docstring block (ending with the empty line)."""
    return ("[" + ind + " || '    \"\"\"', " + ind + " || '    Summary of ' || " + name
            + " || '.', " + ind + " || '    ', " + ind + " || '    Calls: ' || " + calls_text
            + ", " + ind + " || '    \"\"\"', '']")


ORACLES["apply_edits"] = SC_FILES + """,
rewritten AS (
  SELECT sc_path AS path, id,
         CASE WHEN NOT is_method THEN
           list_concat(list_concat([lines[1]],
             """ + _new_block("name", "array_to_string(calls_full, ', ')", "''") + """),
             lines[2 + n_doc:])
         ELSE
           list_concat(list_concat(list_concat(list_concat(list_concat(
             ['class K' || CAST(id AS VARCHAR) || ':'],
             """ + _new_block("'K' || CAST(id AS VARCHAR)",
                              "CASE WHEN has_init THEN 'setup' ELSE '' END", "''") + """),
             init_lines),
             ['    def ' || name || '(self):']),
             """ + _new_block("name", "array_to_string(calls_full, ', ')", "'    '") + """),
             list_transform(body_lines[n_doc + 1:], lambda x: '    ' || x))
         END AS new_lines
  FROM sc_good),
good_files AS (
  SELECT path,
         array_to_string(list_concat(list_concat(list_concat(
           ['import os.path as osp', 'def setup():'],
           """ + _new_block("'setup'", "''", "''") + """), ['    pass']),
           flatten(list(new_lines ORDER BY id))), chr(10)) || chr(10) AS content
  FROM rewritten GROUP BY path)
SELECT path, content FROM good_files
UNION ALL
SELECT path, content FROM sc_spoilt"""


def _calls_line(calls_text: str) -> str:
    """After cleaning (strip), an empty call list leaves ``Calls:`` without the space."""
    return ("'Calls:' || CASE WHEN " + calls_text + " = '' THEN '' ELSE ' ' || " + calls_text
            + " END")


def _answer_block(name: str, calls_text: str, ind: str) -> str:
    return ("[" + ind + " || '    \"\"\"', " + ind + " || '    Summary of ' || " + name
            + " || '.', " + ind + " || '    ', " + ind + " || '    ' || " + _calls_line(calls_text)
            + ", " + ind + " || '    \"\"\"', '']")


ORACLES["rewrite_targets"] = SC_FILES + """,
first_setup AS (SELECT min(sc_path) AS p FROM sc_good),
rw AS (
  SELECT sc_path AS path, id,
         CASE WHEN NOT is_method THEN
           CASE WHEN docstring IS NOT NULL THEN lines
                ELSE list_concat(list_concat([lines[1]],
                       """ + _answer_block("name", "array_to_string(calls_full, ', ')", "''") + """),
                       lines[2:]) END
         ELSE
           list_concat(list_concat(list_concat(list_concat(
             ['class K' || CAST(id AS VARCHAR) || ':'],
             """ + _answer_block("'K' || CAST(id AS VARCHAR)",
                                 "CASE WHEN has_init THEN 'setup' ELSE '' END", "''") + """),
             init_lines),
             ['    def ' || name || '(self):']),
             CASE WHEN docstring IS NOT NULL
                  THEN list_transform(body_lines, lambda x: '    ' || x)
                  ELSE list_concat(
                    """ + _answer_block("name", "array_to_string(calls_full, ', ')", "'    '") + """,
                    list_transform(body_lines, lambda x: '    ' || x)) END)
         END AS new_lines
  FROM sc_good),
good_files AS (
  SELECT path,
         array_to_string(list_concat(list_concat(list_concat(
           ['import os.path as osp', 'def setup():'],
           CASE WHEN path = (SELECT p FROM first_setup)
                THEN """ + _answer_block("'setup'", "''", "''") + """
                ELSE CAST([] AS VARCHAR[]) END),
           ['    pass']),
           flatten(list(new_lines ORDER BY id))), chr(10)) || chr(10) AS content
  FROM rw GROUP BY path)
SELECT path, content FROM good_files
UNION ALL
SELECT path, content FROM sc_spoilt"""


ORACLES["rewrite_chunks"] = SC + """
SELECT id, name, COALESCE(docstring, 'DONE') AS docstring FROM sc_index"""

ORACLES["rewrite_unapplied"] = SC + """
SELECT reason, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT unnest(CASE WHEN docstring IS NULL THEN ['other answers', 'null answer', 'no such chunk']
                     ELSE ['already documented'] END) AS reason FROM sc_index) t GROUP BY reason"""


# ---------------------------------------------------------------------------------------
# Evaluation sets.
def _clean_sql(x: str) -> str:
    """The response-cleaning steps as one nested DuckDB expression over ``x``."""
    first = ("CASE WHEN regexp_matches(" + x + ", '" + _PAIR + "') THEN "
             + _STRIP.replace("{x}", "regexp_extract(" + x + ", '" + _PAIR + "', 1)")
             + " ELSE " + _STRIP.replace("{x}", x) + " END")
    fences = ("regexp_replace(regexp_replace(" + first
              + ", '(?i)```python\\n?', '', 'g'), '\\n?```', '', 'g')")
    stripped = _STRIP.replace("{x}", fences)
    return ("regexp_replace(regexp_replace(" + stripped
            + ", '^\"+|\"+\\z', '', 'g'), '^''+|''+\\z', '', 'g')")


ORACLES["eval_load"] = "SELECT item_id, text AS source_code FROM benchmark"

ORACLES["sample_sink"] = """
SELECT item_id, source_code, docstring FROM (
  SELECT b.item_id, b.text AS source_code, d.text AS docstring
  FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id
  ORDER BY b.item_id LIMIT 50) t
WHERE source_code IS NOT NULL AND docstring IS NOT NULL"""

ORACLES["eval_json"] = """
SELECT item_id, source_code, docstring FROM (
  SELECT b.item_id, b.text AS source_code, d.text AS docstring
  FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id ORDER BY b.item_id LIMIT 20) t
WHERE source_code IS NOT NULL AND docstring IS NOT NULL ORDER BY item_id LIMIT 12"""

ORACLES["eval_rows"] = """
WITH ranked AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
         row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn_role
  FROM conversations),
ans AS (SELECT conv_id, text AS raw FROM ranked WHERE role = 'assistant' AND rn_role = 1),
ctx AS (SELECT conv_id, COUNT(*) AS n,
               string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS t
        FROM ranked WHERE rn <= 10 GROUP BY conv_id)
SELECT b.item_id, b.text AS question, """ + _clean_sql("a.raw") + """ AS answer,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n_contexts, COALESCE(c.t, '') AS contexts_text,
       d.text AS ground_truth
FROM benchmark b
LEFT JOIN documents d ON d.doc_id = b.item_id
LEFT JOIN ans a ON a.conv_id = b.item_id
LEFT JOIN ctx c ON c.conv_id = b.item_id"""


# ---------------------------------------------------------------------------------------
# The stored index.
ORACLES["upsert_index"] = SC + """,
batch AS (
  SELECT 1 AS b, path, chunk_no, name FROM sc_expected WHERE path NOT LIKE 'tests/%'
  UNION ALL SELECT 2, path, chunk_no, name FROM sc_expected WHERE path LIKE 'tests/%'
  UNION ALL SELECT 2, 'copy/' || path, chunk_no, name FROM sc_expected WHERE path NOT LIKE 'tests/%'),
holder AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY b, path, chunk_no) AS k FROM batch),
named AS (SELECT *, CAST(row_number() OVER (ORDER BY b, path, chunk_no) AS BIGINT) AS id FROM holder WHERE k = 1)
SELECT x.path, x.chunk_no, x.name, n.id, CAST(x.k = 1 AS INTEGER) AS created
FROM holder x JOIN named n ON n.name = x.name"""

ORACLES["dependencies_stored"] = ORACLES["dependencies"]
ORACLES["dependents_stored"] = ORACLES["dependents"]

ORACLES["retrieve_stored"] = CG_RANK_ALL + """,
busy AS (SELECT callee FROM cg_edges GROUP BY callee ORDER BY COUNT(*) DESC, callee LIMIT 20)
SELECT r.target_id, r.cand_id, r.cand_name, r.dep, r.rn, r.pos
FROM ranked r JOIN cg_chunks t ON t.id = r.target_id JOIN busy ON busy.callee = t.name"""

ORACLES["context_refresh"] = CG_RANK.replace(
    "CASE WHEN p_size % 3 <> 0 THEN p_type END AS docstring",
    "CASE WHEN p_size % 3 <> 0 THEN p_type WHEN p_size % 5 = 0 THEN 'DONE' END AS docstring").replace(
    "(c.docstring IS NOT NULL OR c.id < u.target_id)", "(c.docstring IS NOT NULL)") + """
SELECT target_id, cand_id, cand_name, dep, rn, pos FROM ranked"""


# ---------------------------------------------------------------------------------------
# Trees and arrays of any size.
ORACLES["corpus_roundtrip"] = SC_FILES + "SELECT sc_path AS path, content FROM sc_file"

ORACLES["eval_array"] = "SELECT doc_id, text, lang FROM documents"

ORACLES["apply_edits_blocked"] = ORACLES["apply_edits"]
