"""DuckDB SQL for the fix table (F4-F8) and odd scanner results (D10), written out here, not taken from the Spark side."""

from __future__ import annotations

from ..sources.corpus import corpus_sql
from . import oracle_more as om

#: The list of fixes, and what each kind does to a line `t`.
_LIST = """
listed AS (
  SELECT DISTINCT l_orderkey + CASE WHEN l_suppkey % 41 = 0 THEN 1000000000000 ELSE 0 END AS file,
    't-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fix_id,
    CASE WHEN l_suppkey % 37 <> 0 THEN CAST(l_linenumber * 2 - l_suppkey % 3 AS INTEGER) END AS line,
    l_suppkey % 4 = 0 AS confirm, CAST(l_partkey % 11 AS INTEGER) AS k
  FROM lineitem),
src AS (SELECT file, string_split(code, chr(10)) AS lines FROM {corpus} AS c),
judged AS (
  SELECT l.*, greatest(1, l.line) AS at_line,
    CASE WHEN k IN (0, 1, 2, 8, 9, 10) THEN 'REPLACE' WHEN k = 3 THEN 'DELETE' WHEN k = 7 THEN 'MULTI_FILE' ELSE 'INSERT' END AS fix_type,
    CASE WHEN k = 7 THEN 'refused'
         WHEN line IS NULL OR k = 10 THEN 'incomplete'
         WHEN confirm AND file % 2 <> 0 THEN 'not_approved'
         WHEN s.file IS NULL THEN 'no_text'
         WHEN greatest(1, l.line) > len(s.lines) THEN 'out_of_range' END AS status
  FROM listed l LEFT JOIN src s USING (file)),
todo AS (
  SELECT file, at_line, fix_id, k, row_number() OVER (PARTITION BY file, at_line ORDER BY fix_id) AS step,
         bool_or(k = 3) OVER (PARTITION BY file, at_line) AS del
  FROM judged WHERE status IS NULL),
fold(file, at_line, step, t, fix_id, status) AS (
  SELECT DISTINCT d.file, d.at_line, CAST(0 AS BIGINT), s.lines[d.at_line], CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  FROM todo d JOIN src s USING (file)
  UNION ALL
  SELECT file, at_line, step, n, fix_id,
         CASE WHEN k NOT IN (0, 1, 2, 8, 9) THEN 'applied' WHEN del THEN 'overridden' WHEN n = t THEN 'unchanged' ELSE 'applied' END
  FROM (
    SELECT d.file, d.at_line, d.step, d.fix_id, d.k, d.del, f.t,
      CASE WHEN d.k = 0 AND instr(t, '(') > 0 THEN substr(t, 1, instr(t, '(') - 1) || '[($' || substr(t, instr(t, '(') + 1)
           WHEN d.k = 1 AND instr(t, 'const ') > 0
             THEN substr(t, 1, instr(t, 'const ') - 1) || 'let $1 ' || substr(t, instr(t, 'const ') + 6)
           WHEN d.k = 2 THEN regexp_replace(t, '(\\w+)\\.(\\w+)', '\\2:\\1$3')
           WHEN d.k = 8 THEN regexp_replace(t, '\\d{{19}}', '-')
           WHEN d.k = 9 AND instr(t, '=') > 0
             THEN substr(t, 1, instr(t, '=') - 1) || '{{' || substr(t, 1, instr(t, '=') - 1) || '|' || substr(t, instr(t, '=') + 1) || '}}'
                  || substr(t, instr(t, '=') + 1)
           ELSE t END AS n
    FROM fold f JOIN todo d ON d.file = f.file AND d.at_line = f.at_line AND d.step = f.step + 1))"""


def _head() -> str:
    return "WITH RECURSIVE " + _LIST.format(corpus=corpus_sql())


def fix_table_statuses_sql() -> str:
    return _head() + """
SELECT file, fix_id, line, fix_type, coalesce(j.status, f.status) AS status, coalesce(j.status, f.status) = 'applied' AS applied
FROM judged j LEFT JOIN (SELECT file, fix_id, status FROM fold WHERE step > 0) f USING (file, fix_id)"""


def fix_table_texts_sql() -> str:
    return _head() + """,
ends AS (
  SELECT d.file, d.at_line, arg_max(f.t, f.step) AS t, bool_or(d.del) AS del
  FROM todo d JOIN fold f USING (file, at_line) GROUP BY ALL),
ins AS (
  SELECT file, at_line, CASE WHEN k = 4 THEN 0 ELSE 2 END AS part, step,
         CASE k WHEN 4 THEN '// above' WHEN 5 THEN '// below' ELSE '// end' END AS t
  FROM todo WHERE k IN (4, 5, 6)),
lns AS (SELECT file, unnest(lines) AS t, generate_subscripts(lines, 1) AS i FROM src),
parts AS (
  SELECT l.file, l.i, 1 AS part, CAST(0 AS BIGINT) AS step, coalesce(e.t, l.t) AS t
  FROM lns l LEFT JOIN ends e ON e.file = l.file AND e.at_line = l.i WHERE NOT coalesce(e.del, false)
  UNION ALL SELECT file, at_line, part, step, t FROM ins),
texts AS (SELECT file, string_agg(t, chr(10) ORDER BY i, part, step) AS code_fixed FROM parts GROUP BY file),
counts AS (SELECT file, count(*) AS n FROM fold WHERE step > 0 AND status = 'applied' GROUP BY file)
SELECT s.file, coalesce(t.code_fixed, '') AS code_fixed, CAST(coalesce(c.n, 0) AS INTEGER) AS n_applied
FROM src s LEFT JOIN texts t USING (file) LEFT JOIN counts c USING (file)"""


def some_approved_sql() -> str:
    body = om._fixed_corpus_body(True)
    confirmed = "uf AS (SELECT * FROM f WHERE "
    assert confirmed in body
    secret = ", ".join(om.q(i) for i in om.fx.SECRET_IDS)
    needs = f"(kind = 'secret' OR rule_id IN ({secret}, 'SENSITIVE_DATA_LOG'))"
    body = body.replace(confirmed, f"{confirmed}(NOT {needs} OR (file + line) % 2 = 0) AND ")
    return om.with_f(body + "\nSELECT file, code_fixed, n_fixes, n_applied FROM fixed")


#: What each odd text comes to: (shape, covered, position, rule, severity, message, line).
_ODD = """(VALUES
    (0, true, 0, 'C1', 'high', 'm', 2),
    (1, true, NULL, NULL, NULL, NULL, NULL),
    (2, true, NULL, NULL, NULL, NULL, NULL),
    (3, true, NULL, NULL, NULL, NULL, NULL),
    (5, true, 0, 'C1', 'high', 'm', 2),
    (7, true, 0, 'C2', 'medium', 'Vulnerability detected', 7),
    (8, true, 0, 'unknown', 'medium', 'Vulnerability detected', 0),
    (8, true, 1, 'unknown', 'medium', 'Vulnerability detected', 0),
    (8, true, 2, 'unknown', 'medium', '12', 3),
    (10, true, 0, 'A', 'medium', 'Vulnerability detected', -4),
    (10, true, 1, 'B', 'critical', 'Vulnerability detected', 2147483647)) AS odd(shape, covered, pos, rid, sev, msg, line)"""


def odd_precedence_sql() -> str:
    return om.with_f(f""",
odd AS (SELECT * FROM {_ODD}),
told AS (SELECT o_orderkey AS file, odd.* FROM orders JOIN odd ON o_orderkey % 13 = odd.shape)
SELECT f.*, CAST(NULL AS INTEGER) AS ext_pos FROM f
WHERE f.kind <> 'vulnerability' OR f.file NOT IN (SELECT file FROM told)
UNION ALL
SELECT file, 'vulnerability', 'Security', rid, sev, msg, CAST(line AS INTEGER), CAST(-1 AS INTEGER), CAST(pos AS INTEGER)
FROM told WHERE pos IS NOT NULL""").replace("\n,\nodd AS", ",\nodd AS")
