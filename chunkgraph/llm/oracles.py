"""DuckDB SQL of the queries that SQL can express, written on its own lines of thought: lists
and joins where the Spark side hashes, no hashes, no batches."""

from __future__ import annotations

import re
from collections import Counter

from chunkgraph.llm import importance, license_scan, quality_rules, substring, url_filter

_WS = "[\\x20\\x09-\\x0D]+"
_WS_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS a FROM documents) d),
k AS (SELECT *, translate(trim(line, {_WS_SET}), {_AZ}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE doc_id <> first) AS BIGINT) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i)
                       FILTER (WHERE first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""

_SYMBOLS = "len(regexp_extract_all({x}, '[#*$%&|<>]'))"
_COVERED = f"length(lower(bare)) - length(regexp_replace(lower(bare), {_text(quality_rules.PHRASE)}, '', 'g'))"
_PHRASES = f"({_COVERED} > 0 AND {_COVERED} >= {quality_rules.MIN_PHRASE_SHARE} * length(lower(bare)))"

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t,
         list_filter(string_split_regex(COALESCE(text, ''), '{_WS}'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) x),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n
        FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) x GROUP BY doc_id),
line AS (
  SELECT doc_id, line, trim(line, {_WS_SET}) AS bare,
         list_filter(string_split_regex(line, '{_WS}'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x),
judged AS (
  SELECT doc_id, line, len(w) AS n,
         bare = '' OR NOT (
           (len(w) <= {quality_rules.SHORT_LINE_WORDS}
              AND NOT regexp_matches(bare, {_text(quality_rules.SENTENCE_END)}))
           OR {_SYMBOLS.replace('{x}', 'bare')} > {quality_rules.MAX_SYMBOL_SHARE} * length(bare)
           OR len(list_filter(w[2:], lambda x: regexp_full_match(x, '[|»›→•·/>]+'))) > 2
           OR (len(w) <= {quality_rules.SHORT_LINE_WORDS}
              AND regexp_matches(lower(bare), {_text(quality_rules.NAV_ENTRY)}))
           OR {_PHRASES}
           OR len(list_filter(range(1, len(w) - 2),
                lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3])) > 0) AS ok
  FROM line),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT ok) AS n_removed,
         sum(length(line)) AS chars, COALESCE(sum(length(line)) FILTER (WHERE ok), 0) AS left_chars,
         count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup
  FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         {_SYMBOLS.replace('{x}', 't')} AS n_symbols, COALESCE(cov.n, 0) AS n_repeat
  FROM d LEFT JOIN cov USING (doc_id)),
both_ AS (
  SELECT *, n_words < 20 OR 100 * n_repeat > 30 * n_words AS failed,
         CASE WHEN chars > 0 THEN 1 - left_chars / chars ELSE 0.0 END AS loss
  FROM base JOIN per USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines,
       CAST(n_repeat AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND loss <= {quality_rules.MAX_LOSS} AS kept, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_removed AS BIGINT) AS n_removed_lines, CAST(round(loss, 6) AS DOUBLE) AS loss
FROM both_"""


def _license_scan() -> str:
    rows = []
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        for g, c in Counter(zip(w, w[1:])).items():
            rows.append(f"({i}, {_text(name)}, {_text(' '.join(g))}, {c}, {len(w) - 1})")
    t = license_scan.THRESHOLD
    return f"""
WITH t(tid, license, g, c, total) AS (VALUES {', '.join(rows)}),
l AS (SELECT doc_id, COALESCE(text, '') AS t, string_split(COALESCE(text, ''), chr(10)) AS a,
             string_split_regex(COALESCE(text, ''), '\\n[\\x20\\x09-\\x0D]*\\n') AS p FROM documents),
u AS (SELECT doc_id, list_concat(a, CASE WHEN len(a) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_concat(
               CASE WHEN len(p) > 1 THEN list_filter(p, lambda x: contains(x, chr(10)))
                    ELSE CAST([] AS VARCHAR[]) END, list_concat([t], CASE WHEN len(p) < 2 THEN CAST([] AS VARCHAR[])
                    ELSE flatten(list_transform(range(2, {license_scan.RUN + 1}), lambda k: list_transform(
                      range(1, len(p) - k + 2), lambda i: array_to_string(p[i:i + k - 1], ' ')))) END)) END) AS units
      FROM l),
w AS (SELECT doc_id, unit, list_filter(string_split_regex(lower(s), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, generate_subscripts(units, 1) - 1 AS unit, unnest(units) AS s FROM u) x),
b AS (SELECT doc_id, unit, len(w) - 1 AS size,
             unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
      FROM w WHERE len(w) BETWEEN 2 AND (SELECT 1.5 * max(total) + 2 FROM t)),
n AS (SELECT doc_id, unit, size, g, count(*) AS c FROM b GROUP BY ALL),
m AS (SELECT doc_id, unit, license, sum(least(n.c, t.c)) AS common, 2 * sum(least(n.c, t.c)) / (size + total) AS d
      FROM n JOIN t USING (g) GROUP BY doc_id, unit, size, tid, license, total HAVING d >= {t}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY common DESC, d DESC, license, unit) AS r,
                count(*) OVER (PARTITION BY doc_id) AS _x FROM m),
units AS (SELECT doc_id, count(DISTINCT unit) AS k FROM m GROUP BY doc_id)
SELECT x.doc_id, best.license, round(best.d, 6) AS dice, CAST(best.unit AS INTEGER) AS unit,
       CAST(COALESCE(units.k, 0) AS BIGINT) AS n_matches
FROM documents x LEFT JOIN best ON best.doc_id = x.doc_id AND best.r = 1
LEFT JOIN units ON units.doc_id = x.doc_id"""


def _up(template: str) -> str:
    """The template with its last fixed segment as a wildcard."""
    segs = f"string_split({template}, '/')"
    last = f"list_max(list_filter(range(1, len({segs}) + 1), lambda i: {segs}[i] <> '*'))"
    return (f"CASE WHEN {template} = '' OR {last} IS NULL THEN {template} ELSE array_to_string(list_transform("
            f"{segs}, lambda s, i: CASE WHEN i = {last} THEN '*' ELSE s END), '/') END")


def _url_filter() -> str:
    u = url_filter
    rules = sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))

    def case(pick) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text(p)}) "
            f"THEN {_text(pick(h, p, v))}" for h, p, v in rules) + " END"

    return f"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                           ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
g AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda s:
        CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {u.LONG_SEGMENT} THEN '*' ELSE s END) AS segs FROM h),
pg AS (SELECT *, array_to_string(segs, '/') AS shape FROM g),
bad AS (SELECT doc_id, max(CASE WHEN COALESCE(quality, 1) = 0 OR COALESCE(toxic, 0) = 1 THEN 1 ELSE 0 END) AS is_bad
        FROM labels GROUP BY doc_id),
leaf AS (SELECT host, shape, segs, count(*) AS n, count(is_bad) AS labelled, COALESCE(sum(is_bad), 0) AS bad
         FROM pg LEFT JOIN bad ON doc_id = page_id GROUP BY host, shape, segs),
lev AS (
  SELECT host, shape, segs, n, labelled, bad, 0 AS i, CAST([] AS VARCHAR[]) AS prefix FROM leaf
  UNION ALL
  SELECT host, shape, segs, n, labelled, bad, i + 1, list_append(prefix, CASE
           WHEN children >= {u.VARIABLE_CHILDREN} AND children >= {u.VARIABLE_SHARE} * pages THEN '*' ELSE segs[i + 1] END)
  FROM (SELECT *, count(DISTINCT segs[i + 1]) OVER w AS children, sum(n) FILTER (i < len(segs)) OVER w AS pages
        FROM lev WINDOW w AS (PARTITION BY host, prefix)) x WHERE i < len(segs)),
m_0 AS (SELECT host, shape, array_to_string(prefix, '/') AS template, labelled, bad FROM lev WHERE i = len(segs)),
m AS (
  SELECT 0 AS k, host, template AS t0, template AS cur, sum(labelled) AS n, sum(bad) AS b FROM m_0 GROUP BY host, template
  UNION ALL
  SELECT k + 1, host, t0, branch, n, b FROM (
    SELECT *, max(CASE WHEN branch <> cur THEN 1 ELSE 0 END) OVER () AS moved FROM (
      SELECT *, CASE WHEN peers < 2 THEN cur
          WHEN tn > 0 AND an > tn AND spread > 0
            AND abs(CAST(tb AS DOUBLE) / tn - CAST(ab - tb AS DOUBLE) / (an - tn)) > {u.MERGE_Z} * sqrt(spread)
          THEN cur ELSE parent END AS branch
      FROM (SELECT *, CAST(ab AS DOUBLE) / an * (1 - CAST(ab AS DOUBLE) / an)
                      * (CAST(1 AS DOUBLE) / tn + CAST(1 AS DOUBLE) / (an - tn)) AS spread
        FROM (SELECT *, sum(n) OVER (PARTITION BY host, parent) AS an, sum(b) OVER (PARTITION BY host, parent) AS ab,
                     sum(n) OVER (PARTITION BY host, cur) AS tn, sum(b) OVER (PARTITION BY host, cur) AS tb,
                     count(DISTINCT cur) OVER (PARTITION BY host, length) AS peers
          FROM (SELECT *, CASE WHEN cur = '' THEN 0 ELSE len(string_split(cur, '/')) END AS length,
                       {_up('cur')} AS parent FROM m) a) c) d) e) f
  WHERE moved = 1),
fin AS (SELECT host, t0, cur, n, b FROM m QUALIFY k = max(k) OVER ()),
tt AS (SELECT host, cur AS template, sum(n) AS n, sum(b) AS b FROM fin GROUP BY host, cur),
pp AS (SELECT *, sum(n) OVER (PARTITION BY host, parent) AS an, sum(b) OVER (PARTITION BY host, parent) AS ab
       FROM (SELECT *, {_up('template')} AS parent FROM tt) x),
hh AS (SELECT host, sum(n) AS hn, sum(b) AS hb FROM tt GROUP BY host),
al AS (SELECT CASE WHEN sum(hn) > 0 THEN CAST(sum(hb) AS DOUBLE) / sum(hn) ELSE 0.0 END AS base FROM hh),
pu AS (SELECT host, template, hn, (CASE WHEN n > 0 THEN b ELSE ab END
                                   + {u.SMOOTHING} * ((hb + {u.SMOOTHING} * base) / (hn + {u.SMOOTHING})))
                                  / (CASE WHEN n > 0 THEN n ELSE an END + {u.SMOOTHING}) AS purity
       FROM pp JOIN hh USING (host), al),
tree AS (SELECT x.host, x.shape, fin.cur AS template FROM m_0 x JOIN fin ON fin.host = x.host AND fin.t0 = x.template)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
       COALESCE({case(lambda h, p, v: v)}, CASE WHEN hn > 0 AND purity >= {u.REJECT_PURITY} THEN 'block'
                                                ELSE 'allow' END) AS verdict,
       template, CAST(round(purity, 6) AS DOUBLE) AS purity
FROM pg JOIN tree USING (host, shape) JOIN pu USING (host, template)"""


_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"


def _importance() -> str:
    """CRC-32 by its table, made bit by bit; every feature's bytes are folded through it once."""
    i = importance
    words = f"regexp_extract_all(translate(COALESCE(text, ''), {_AZ}), {_WORD})"
    return f"""
WITH RECURSIVE crc_bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1
            FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
words AS (SELECT 'd' AS src, doc_id, {words} AS w FROM documents
          UNION ALL SELECT 'b', NULL, {words} FROM benchmark),
feature AS (SELECT src, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
            FROM words),
per AS (SELECT src, doc_id, f, count(*) AS n FROM feature GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per) x),
bucket AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2),
                    lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
                  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % {i.BUCKETS} AS b
           FROM bytes, crc_table),
tally AS (SELECT b, COALESCE(sum(n) FILTER (src = 'd'), 0) AS s, COALESCE(sum(n) FILTER (src = 'b'), 0) AS t
          FROM per JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM tally) + {i.BUCKETS}) AS DOUBLE)
                   / CAST((s + 1) * ((SELECT sum(t) FROM tally) + {i.BUCKETS}) AS DOUBLE))) AS BIGINT) AS g FROM tally),
weight AS (SELECT doc_id, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
           FROM per JOIN bucket USING (f) JOIN gain USING (b) WHERE src = 'd' GROUP BY doc_id),
scored AS (
  SELECT x.doc_id, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE 2 * len(w) - 1 END AS n_features,
         COALESCE(weight, 0) AS weight,
         COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{i.SEED}:' || x.doc_id), 1, 8)) AS BIGINT)
                                                          + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM words x LEFT JOIN weight USING (doc_id) WHERE src = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
           FROM scored WHERE n_words >= {i.MIN_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN r <= {i.PERCENT} * n // 100 THEN r END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


def _repair() -> str:
    """Row by row over all conversations at once: the least (cost, letters) for each role state
    (0 start, 1 system, 2 user, 3 assistant), with the repaired rows beside it."""
    after = "CASE {q} WHEN 2 THEN 3 ELSE 2 END"
    one = after.replace("{q}", "q")
    two = after.replace("{q}", f"({one})")
    name = "CASE {q} WHEN 3 THEN 'assistant' ELSE 'user' END"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc_bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n + 1
            FROM crc_bits WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE n = 8),
kind AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(hex(encode(k))) // 2),
                    lambda i: CAST(('0x' || substr(hex(encode(k)), 2 * i + 1, 2)) AS BIGINT))),
                  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM raw, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
         FROM kind WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                    rtrim(text, {_WS_SET}) AS bare, substr(role, 1, 1) AS ini FROM hurt),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM numbered),
facts AS (SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS fixed FROM facts
  UNION ALL
  SELECT conv_id, i, q, cost, audit, fixed FROM (
    SELECT conv_id, i + 1 AS i, nq AS q, cost, audit, fixed,
           row_number() OVER (PARTITION BY conv_id, nq ORDER BY cost, audit) AS best
    FROM (
      SELECT p.conv_id, p.i, e.edit, CASE e.edit WHEN 'D' THEN p.q WHEN 'R' THEN {after.replace('{q}', 'p.q')}
                 ELSE CASE f.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS nq,
             p.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
               + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
             p.audit || e.edit AS audit,
             CASE e.edit WHEN 'D' THEN p.fixed
               WHEN 'K' THEN list_append(p.fixed, f.role || ':' || f.text)
               ELSE list_append(p.fixed, {name.replace('{q}', after.replace('{q}', 'p.q'))} || ':' || f.text) END AS fixed
      FROM (SELECT conv_id, i, q, cost, audit, fixed FROM walk
            UNION ALL SELECT conv_id, i, {one}, cost + 3, audit || 'I',
                             list_append(fixed, {name.replace('{q}', one)} || ':') FROM walk
            UNION ALL SELECT conv_id, i, {two}, cost + 6, audit || 'II',
                             list_concat(fixed, [{name.replace('{q}', one)} || ':', {name.replace('{q}', two)} || ':'])
                      FROM walk) p
      JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
      JOIN (VALUES ('D'), ('K'), ('R')) e(edit)
        ON e.edit = 'D' OR (COALESCE(f.fault, '') NOT IN ('blank', 'duplicate') AND (e.edit = 'R'
           OR (f.ini = 's' AND p.q = 0) OR (f.ini = 'u' AND p.q <> 2) OR (f.ini = 'a' AND p.q = 2)))) c) d
  WHERE best = 1),
ends AS (SELECT w.* FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i),
closed AS (
  SELECT conv_id, q, cost, audit, fixed FROM ends
  UNION ALL SELECT conv_id, {one}, cost + 3, audit || 'I', list_append(fixed, {name.replace('{q}', one)} || ':') FROM ends
  UNION ALL SELECT conv_id, {two}, cost + 6, audit || 'II',
                   list_concat(fixed, [{name.replace('{q}', one)} || ':', {name.replace('{q}', two)} || ':']) FROM ends),
chosen AS (SELECT * FROM closed WHERE q IN (0, 3)
           QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, CAST(COALESCE(blank, 0) AS BIGINT) AS blank,
       CAST(COALESCE(duplicate, 0) AS BIGINT) AS duplicate, CAST(COALESCE(truncated, 0) AS BIGINT) AS truncated,
       CAST(COALESCE(illegal, 0) AS BIGINT) AS illegal, CAST(COALESCE(cost, 0) AS BIGINT) AS cost,
       COALESCE(audit, '') AS audit, sha256(COALESCE(array_to_string(fixed, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM o.conv_id"""


SUBSTRING_DEDUP = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '{_WS}'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {substring.WINDOW - 1}], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM d WHERE len(w) >= {substring.WINDOW}) x),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS j FROM late),
word AS (SELECT doc_id, generate_subscripts(w, 1) AS j, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


ORACLES = {
    "op3_url_filter": _url_filter(),
    "op5_license_scan": _license_scan(),
    "op7_line_dedup": LINE_DEDUP,
    "op10_quality_rules": QUALITY_RULES,
    "op11_importance_resampling": _importance(),
    "op12_conversation_repair": _repair(),
    "op13_substring_dedup": SUBSTRING_DEDUP,
}
