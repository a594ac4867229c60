"""DuckDB SQL oracles for the queries built on top of the scan."""

from __future__ import annotations

import json

from ..functions.dialect import to_re2
from ..knowledge_data import EXPLANATIONS, GUIDES
from ..operators import fixes as fx
from ..operators import reports as rp
from ..operators.relations import EDGES, VERBS
from ..rules import ALL_RULES
from ..sources.corpus import corpus_sql
from .oracle_scan import context_sql, q, safe_text_sql, scan_sql

NL = "chr(10)"


def _v(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    return q(str(x))


def values(rows, cols) -> str:
    body = ",\n    ".join("(" + ", ".join(_v(x) for x in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS v({', '.join(cols)})"


def corpus_findings(src: str | None = None) -> str:
    return scan_sql(src or corpus_sql(), "code", ["file"], ALL_RULES)


def with_f(body: str, findings: str | None = None) -> str:
    return f"WITH f AS ({findings or corpus_findings()})\n{body}"


def as_file_code(table: str, id_col: str, text_col: str) -> str:
    """A given table viewed as (file, code), as the Spark side does with aliases."""
    return f"(SELECT {id_col} AS file, {text_col} AS code FROM {table})"


# ------------------------------------------------------------- aggregates
def severity_groups_sql() -> str:
    return with_f("""SELECT severity, CAST(count(*) AS BIGINT) AS n,
  CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS INTEGER) AS group_order
FROM f GROUP BY severity""")


def severity_members_sql() -> str:
    place = "CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS INTEGER)"
    return with_f(f"""SELECT f.*, {place} AS group_order,
  row_number() OVER (PARTITION BY severity ORDER BY file, rule_seq, line) AS rank FROM f""")


def _numbered_lines(parts: str, findings: str | None = None) -> str:
    """Report lines from rows (part, grp, place, item..., text), texts split at line breaks."""
    return with_f(findings=findings, body=f""",
parts AS ({parts}),
ordered AS (SELECT text, row_number() OVER (ORDER BY part, g1, g2, place, i1, i2, i3, i4) AS o FROM parts),
cut AS (SELECT o, unnest(string_split(text, {NL})) AS text, generate_subscripts(string_split(text, {NL}), 1) AS k FROM ordered)
SELECT row_number() OVER (ORDER BY o, k) AS n, text FROM cut""").replace("\n,\nparts AS", ",\nparts AS")


_NO_KEY = "NULL AS g1, NULL AS g2, 0 AS place, NULL AS i1, NULL AS i2, NULL AS i3, NULL AS i4"
_FILE_KEY = "file AS g1, NULL AS g2, {} AS place, NULL AS i1, NULL AS i2, NULL AS i3, NULL AS i4"
_ITEM_KEY = "file AS g1, NULL AS g2, 1 AS place, rule_seq AS i1, line AS i2, NULL AS i3, NULL AS i4"


def text_report_file_sql() -> str:
    return _numbered_lines(f"""
  SELECT 1 AS part, {_FILE_KEY.format(0)}, {NL} || printf('=== %s (%d issue(s)) ===', CAST(file AS VARCHAR), count(*)) AS text FROM f GROUP BY file
  UNION ALL SELECT 1, {_ITEM_KEY}, printf('  [%s] L%d: %s — %s', upper(severity), line, rule_id, message) FROM f
  UNION ALL SELECT 2, {_NO_KEY}, {NL} || printf('Total: %d issue(s) in %d file(s).', count(*), count(DISTINCT file)) FROM f""")


def markdown_report_file_sql() -> str:
    return _numbered_lines(f"""
  SELECT 0 AS part, {_NO_KEY}, printf('# Scan report' || {NL} || {NL} || '**%d issue(s)** across **%d file(s)**' || {NL},
         count(*), count(DISTINCT file)) AS text FROM f
  UNION ALL SELECT DISTINCT 1, {_FILE_KEY.format(0)}, '## `' || CAST(file AS VARCHAR) || '`' FROM f
  UNION ALL SELECT 1, {_ITEM_KEY}, printf('- **[%s] L%d** `%s` — %s', upper(severity), line, rule_id, message) FROM f
  UNION ALL SELECT DISTINCT 1, {_FILE_KEY.format(2)}, '' FROM f""")


def listing_file_sql() -> str:
    return _numbered_lines(f"""
  SELECT 1 AS part, {_ITEM_KEY}, {_listing_entry()} AS text FROM f LEFT JOIN {explanation_values()} ON upper(f.rule_id) = v.ex_id
  UNION ALL SELECT 2, {_NO_KEY}, {NL} || printf('Total: %d issue(s).', count(*)) FROM f""")


def domain_report_file_sql() -> str:
    item = ("concat_ws(chr(10), printf('[%s] L%d: %s', upper(severity), line, rule_id), '  ' || message, "
            "CASE WHEN ex_id IS NOT NULL THEN concat_ws(chr(10), '  What: ' || what, '  Why:  ' || why, "
            "CASE WHEN n_steps > 0 THEN '  Fix:  ' || fix_title END, '  Ref:  ' || standard_url) END, '')")
    bar = "repeat('=', 60)"
    return _numbered_lines(f"""
  SELECT 0 AS part, {_NO_KEY}, concat_ws({NL}, {bar}, 'Findings report', printf('Total: %d issue(s)', count(*)), {bar}, '') AS text FROM f
  UNION ALL SELECT 1, min(rule_seq), NULL, 0, NULL, NULL, NULL, NULL, printf('--- %s (%d) ---', domain, count(*)) FROM f GROUP BY domain
  UNION ALL SELECT 1, min(rule_seq) OVER (PARTITION BY domain), NULL, 1, file, rule_seq, line, NULL, {item}
  FROM f LEFT JOIN {explanation_values()} ON upper(f.rule_id) = v.ex_id""")


def domain_counts_sql() -> str:
    return with_f("SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(min(rule_seq) AS INTEGER) AS first_seq "
                  "FROM f GROUP BY domain")


def totals_sql() -> str:
    return with_f("SELECT CAST(count(*) AS BIGINT) AS n_findings, CAST(count(DISTINCT file) AS BIGINT) AS n_files FROM f")


def per_file_counts_sql() -> str:
    return with_f("SELECT file, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY file")


def summary_sql(findings: str | None = None) -> str:
    return with_f(findings=findings, body="""SELECT total, critical,
  CASE WHEN total = 0 THEN 'No issues detected.'
       WHEN critical > 0 THEN printf('%d issue(s), %d critical.', total, critical)
       ELSE printf('%d issue(s).', total) END AS summary
FROM (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(coalesce(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END), 0) AS BIGINT) AS critical FROM f)""")


def gate_per_file_sql() -> str:
    return with_f(f"""SELECT c.file, CAST(coalesce(max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END), 0) AS INTEGER)
  AS exit_code FROM (SELECT DISTINCT file FROM {corpus_sql()} AS s) c LEFT JOIN f ON f.file IS NOT DISTINCT FROM c.file GROUP BY c.file""")


def gate_sql() -> str:
    return with_f("SELECT CAST(coalesce(max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END), 0) AS INTEGER) "
                  "AS exit_code FROM f")


def distinct_ids_sql() -> str:
    return with_f("SELECT DISTINCT file, rule_id FROM f")


def labels_sql() -> str:
    n = rp.PREVIEW_CHARS
    return with_f(f"""SELECT *, printf('[L%d]  %s', line, rule_id) AS label,
  printf('[%s]  %s', upper(substr(domain, 1, 3)),
         CASE WHEN length(message) > {n} THEN substr(message, 1, {n}) || '…' ELSE message END) AS description
FROM f""")


def diagnostics_sql(src: str | None = None) -> str:
    rules = [r for r in ALL_RULES if r.domain == "Security"]
    src = src or corpus_sql()
    fsql = scan_sql(src, "code", ["file"], rules)
    return f"""WITH f AS ({fsql}),
src AS (SELECT file, string_split({safe_text_sql('code')}, chr(10)) AS lines FROM {src} AS c)
SELECT f.file, f.rule_id, f.line, CAST(greatest(0, f.line - 1) AS INTEGER) AS line_index,
  CAST(length(src.lines[least(greatest(0, f.line - 1), len(src.lines) - 1) + 1]) AS INTEGER) AS end_col,
  CASE WHEN f.kind = 'secret' OR f.severity IN ('critical', 'high') THEN 'Error' ELSE 'Warning' END AS level,
  CASE WHEN f.kind = 'secret' THEN printf('%s detected, use an environment variable', f.rule_id)
       ELSE printf('%s (%s)', f.message, f.rule_id) END AS diag_message
FROM f JOIN src ON f.file = src.file"""


# ---------------------------------------------------------------- reports
def _item_order(item: str) -> str:
    return f"ORDER BY rule_seq, line, {item}"


def text_report_sql(src: str | None = None) -> str:
    item = "printf('  [%s] L%d: %s — %s', upper(severity), line, rule_id, message)"
    return with_f(findings=corpus_findings(src), body=f"""SELECT file, {NL} || printf('=== %s (%d issue(s)) ===', CAST(file AS VARCHAR), count(*)) || {NL}
  || string_agg({item}, {NL} {_item_order(item)}) AS block
FROM f GROUP BY file""")


def text_totals_sql() -> str:
    return with_f(f"""SELECT n_findings, n_files,
  CASE WHEN n_findings = 0 THEN 'No issues found.'
       ELSE {NL} || printf('Total: %d issue(s) in %d file(s).', n_findings, n_files) END AS footer
FROM (SELECT CAST(count(*) AS BIGINT) AS n_findings, CAST(count(DISTINCT file) AS BIGINT) AS n_files FROM f)""")


def markdown_report_sql() -> str:
    item = "printf('- **[%s] L%d** `%s` — %s', upper(severity), line, rule_id, message)"
    return with_f(f"""SELECT file, '## `' || CAST(file AS VARCHAR) || '`' || {NL}
  || string_agg({item}, {NL} {_item_order(item)}) || {NL} AS section
FROM f GROUP BY file""")


def json_report_sql() -> str:
    rows = [(e["rule_id"], json.dumps({k: e[k] for k in ("what", "why", "risks", "standard", "example", "steps", "refs")},
                                      ensure_ascii=False, separators=(",", ":"))) for e in EXPLANATIONS]
    return with_f(f"""SELECT file, CAST(to_json({{'file': file, 'issues': list(
    {{'line': line, 'id': rule_id, 'domain': domain, 'severity': severity, 'title': rule_id, 'message': message,
     'explanation': CAST(ex_json AS JSON)}}
    ORDER BY rule_seq, line, rule_id, domain, severity, message)}}) AS VARCHAR) AS json
FROM (SELECT f.*, v.ex_json FROM f LEFT JOIN {values(rows, ["ex_id", "ex_json"])} ON upper(f.rule_id) = v.ex_id) x
GROUP BY file""")


def domain_report_header_sql() -> str:
    return with_f(f"""SELECT file, CAST(count(*) AS BIGINT) AS n,
  printf('Findings report' || {NL} || 'Total: %d issue(s)', count(*)) AS header FROM f GROUP BY file""")


def guide_coverage_sql() -> str:
    return with_f(f"""SELECT v.g_id AS rule_id, v.guide_domain, CAST(v.guide_pos AS INTEGER) AS guide_pos,
  (SELECT CAST(count(*) AS BIGINT) FROM f WHERE f.rule_id = v.g_id) AS n_findings FROM {guide_values()}""")


def explanation_values() -> str:
    rows = [(e["rule_id"], e["what"], e["why"], e["standard"]["name"], e["standard"]["cwe_name"],
             e["standard"]["url"], e["steps"][0]["title"] if e["steps"] else None, len(e["steps"]),
             e["example"]["docs_url"]) for e in EXPLANATIONS]
    return values(rows, ["ex_id", "what", "why", "standard_name", "cwe_name", "standard_url", "fix_title",
                         "n_steps", "docs_url"])


def explain_findings_sql() -> str:
    return with_f(f"""SELECT f.file, f.rule_id, f.line, v.what, v.why, v.standard_name, v.cwe_name,
  v.standard_url, v.fix_title, CAST(v.docs_url AS VARCHAR) AS docs_url
FROM f LEFT JOIN {explanation_values()} ON upper(f.rule_id) = v.ex_id""")


def domain_report_sql(findings: str | None = None) -> str:
    item = ("concat_ws(chr(10), printf('[%s] L%d: %s', upper(severity), line, rule_id), '  ' || message, "
            "CASE WHEN ex_id IS NOT NULL THEN concat_ws(chr(10), '  What: ' || what, '  Why:  ' || why, "
            "CASE WHEN n_steps > 0 THEN '  Fix:  ' || fix_title END, '  Ref:  ' || standard_url) END)")
    return with_f(findings=findings, body=f"""SELECT file, domain, CAST(count(*) AS BIGINT) AS n, CAST(min(rule_seq) AS INTEGER) AS first_seq,
  printf('--- %s (%d) ---', domain, count(*)) || {NL} || string_agg({item}, {NL} || {NL} {_item_order(item)}) AS section
FROM (SELECT * FROM f LEFT JOIN {explanation_values()} ON upper(f.rule_id) = v.ex_id) x
GROUP BY file, domain""")


def _listing_entry() -> str:
    return f"""printf('[%s][%s] L%d: %s (%s)', domain, upper(severity), line, message, rule_id)
  || coalesce(CASE WHEN v.ex_id IS NOT NULL THEN {NL} || '  Fix: ' || coalesce(v.fix_title, '') || {NL}
  || '  Ref: ' || coalesce(v.docs_url, v.standard_url) END, '')"""


def listing_sql(findings: str | None = None) -> str:
    return with_f(findings=findings, body=f"""SELECT f.*, {_listing_entry()} AS entry
FROM f LEFT JOIN {explanation_values()} ON upper(f.rule_id) = v.ex_id""")


# -------------------------------------------------------------- knowledge
def guide_values() -> str:
    rows = [(g["rule_id"], g["guide_domain"], g["severity"], g["minutes"], g["gain_ms"], g["env_var"],
             ", ".join(g["related"]) if g["related"] else None, g["confidence"], i) for i, g in enumerate(GUIDES)]
    return values(rows, ["g_id", "guide_domain", "guide_severity", "minutes", "gain_ms", "env_var", "related",
                         "confidence", "guide_pos"])


def guide_findings_sql() -> str:
    ctx = context_sql(corpus_sql(), "code", ["file"], ALL_RULES)
    return f"""WITH c AS ({ctx})
SELECT c.file, c.rule_id, c.line, c.in_test, v.guide_severity, v.confidence, v.env_var, v.related,
  CAST(CASE WHEN v.g_id IS NULL THEN NULL WHEN coalesce(c.in_test, false) THEN greatest(1, v.minutes - 2)
       ELSE v.minutes END AS INTEGER) AS fix_minutes,
  CAST(v.gain_ms AS DOUBLE) AS gain_ms
FROM c LEFT JOIN {guide_values()} ON c.rule_id = v.g_id"""


def guide_gains_sql() -> str:
    return with_f(f"""SELECT f.file, f.rule_id, f.line, CAST(v.minutes AS INTEGER) AS fix_minutes,
  CAST(v.gain_ms AS DOUBLE) * CAST(f.file % 2500 AS DOUBLE) AS gain_ms
FROM f JOIN {guide_values()} ON f.rule_id = v.g_id""")


def guide_domains_found_sql() -> str:
    return with_f(f"""SELECT v.guide_domain, v.g_id AS rule_id, CAST(v.guide_pos AS INTEGER) AS guide_pos,
  CAST(count(*) AS BIGINT) AS n_findings
FROM f JOIN {guide_values()} ON f.rule_id = v.g_id GROUP BY v.guide_domain, v.g_id, v.guide_pos""")


def detail_rows():
    out = []
    for e in EXPLANATIONS:
        rid = e["rule_id"]
        out += [(rid, "what", 0, "What", e["what"]), (rid, "why", 0, "Why", e["why"]),
                (rid, "standard", 0, e["standard"]["name"], e["standard"]["cwe_name"]),
                (rid, "example", 0, "bad", e["example"]["bad"]), (rid, "example", 1, "good", e["example"]["good"])]
        out += [(rid, "risk", i, "Risk", r) for i, r in enumerate(e["risks"])]
        out += [(rid, "step", s["order"], s["title"], s["description"]) for s in e["steps"]]
        if e["standard"]["url"]:
            out.append((rid, "standard_url", 0, e["standard"]["name"], e["standard"]["url"]))
        if e["example"]["docs_url"]:
            out.append((rid, "docs", 0, "Docs", e["example"]["docs_url"]))
        out += [(rid, "step_example", s["order"], s["title"], s["example"]) for s in e["steps"] if s["example"]]
        out += [(rid, "ref", i, r["name"], r["url"]) for i, r in enumerate(e["refs"])]
    return out


def explanation_details_sql() -> str:
    return with_f(f"""SELECT v.rule_id, v.section, CAST(v.pos AS INTEGER) AS pos, v.label, v.detail
FROM {values(detail_rows(), ['rule_id', 'section', 'pos', 'label', 'detail'])}
WHERE v.rule_id IN (SELECT upper(rule_id) FROM f)""")


def _sheet_bodies() -> tuple[list[tuple], list[tuple]]:
    """(id, text before the message, text after it) of explanations, and (id, text) of guides, line by line."""
    bar = ["-" * 66, ""]
    push = lambda text, n: [" " * n + x for x in text.split("\n")]
    explained, guided = [], []
    for e in EXPLANATIONS:
        lines = ["", "  WHAT IS IT", *push(e["what"], 2), "", "  WHY IT MATTERS", *push(e["why"], 2), ""]
        if e["risks"]:
            lines += ["  RISKS", *(f"  * {r}" for r in e["risks"]), ""]
        lines += [*bar, "  VULNERABLE CODE", *push(e["example"]["bad"], 4), "", "  SECURE ALTERNATIVE", *push(e["example"]["good"], 4), ""]
        if e["steps"]:
            lines += [*bar, f"  HOW TO FIX ({len(e['steps'])} steps)", ""]
            for s in e["steps"]:
                lines += [f"  {s['order']}. {s['title']}", f"     {s['description']}"]
                lines += [f"     > {s['example']}"] if s["example"] else []
                lines.append("")
        std = e["standard"]
        lines += [*bar, "  STANDARD", f"  {std['name']}", f"  {std['cwe_name']}", *([f"  {std['url']}"] if std["url"] else []), ""]
        if e["refs"]:
            lines += ["  REFERENCES", *(f"  * {r['name']}: {r['url']}" for r in e["refs"]), ""]
        if e["example"]["docs_url"]:
            lines += ["  OFFICIAL DOCS", f"  {e['example']['docs_url']}", ""]
        explained.append((e["rule_id"], "\n".join(lines)))
    for g in GUIDES:
        lines = ["  PROBLEM", *push(g["problem"], 2), "", *push(g["explanation"], 2), ""]
        lines += [*bar, "  VULNERABLE CODE", *push(g["bad"], 4), ""] if g["bad"] else []
        lines += ["  SECURE ALTERNATIVE", *push(g["good"], 4), ""] if g["good"] else []
        if g["steps"]:
            lines += [*bar, "  HOW TO FIX", "", *(f"  {i}. {s}" for i, s in enumerate(g["steps"], 1)), ""]
        lines += [*bar, f"  Est. fix time: {g['minutes']} min, confidence: {g['confidence']}"]
        lines += [f"  Env var needed: {g['env_var']}"] if g["env_var"] else []
        lines += [f"  Performance gain: ~{g['gain_ms']:g}ms"] if g["gain_ms"] else []
        lines += [f"  Related: {', '.join(g['related'])}"] if g["related"] else []
        guided.append((g["rule_id"], "\n".join([*lines, ""])))
    return explained, guided


def issue_sheets_sql(findings: str | None = None) -> str:
    explained, guided = _sheet_bodies()
    ev = values(explained, ["ex_id", "body"])
    gv = values(guided, ["g_id", "body"]).replace(" AS v(", " AS g(")
    edge, nl = q("=" * 66), NL
    return with_f(findings=findings, body=f"""SELECT f.*,
  CASE WHEN v.ex_id IS NOT NULL THEN 'explanation' WHEN g.g_id IS NOT NULL THEN 'guide' ELSE 'none' END AS sheet_source,
  concat_ws({nl}, {edge}, '  ISSUE DETAIL', {edge}, '',
    printf('  [%s]  %s, line %d, %s', upper(f.severity), f.rule_id, f.line, f.domain), '',
    CASE WHEN v.ex_id IS NOT NULL THEN '  PROBLEM' || {nl} || '  ' || f.message || {nl} || v.body
         WHEN g.g_id IS NOT NULL THEN g.body
         ELSE '  PROBLEM' || {nl} || '  ' || f.message || {nl} || {nl} || '  No guide for "' || f.rule_id || '".' || {nl}
              || '  Look the issue type up in a public security guide.' || {nl} END,
    {edge}, '  Apply the planned fix, or follow the steps above.', {edge}) AS sheet
FROM f LEFT JOIN {ev} ON upper(f.rule_id) = v.ex_id
LEFT JOIN {gv} ON f.rule_id = g.g_id""")


# ---------------------------------------------------------- relationships
def edge_values() -> str:
    return values([(*e, i) for i, e in enumerate(EDGES)],
                  ["from_id", "to_id", "rel_type", "priority", "reason", "edge_idx"]).replace(" AS v(", " AS e(")


def _sentence(alias: str = "e") -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in VERBS.items())
    return (f"printf('%s %s %s: %s', {alias}.from_id, CASE {alias}.rel_type {cases} ELSE {alias}.rel_type END, "
            f"{alias}.to_id, {alias}.reason)")


def relations_from_found_sql() -> str:
    return with_f(f"""SELECT d.rule_id, e.to_id, e.rel_type, CAST(e.priority AS INTEGER) AS priority,
  CAST(e.edge_idx AS INTEGER) AS edge_idx, {_sentence()} AS sentence
FROM (SELECT DISTINCT rule_id FROM f) d JOIN {edge_values()} ON d.rule_id = e.from_id""")


def _ids_cte() -> str:
    return """ids AS (
  SELECT file, rule_id, CAST(row_number() OVER (PARTITION BY file ORDER BY min(rule_seq), min(line), rule_id) AS INTEGER) AS pos
  FROM f GROUP BY file, rule_id
)"""


def relations_in_file_sql() -> str:
    return with_f(f""", {_ids_cte()}
SELECT i.file, e.from_id, e.to_id, e.rel_type, CAST(e.priority AS INTEGER) AS priority,
  CAST(e.edge_idx AS INTEGER) AS edge_idx, {_sentence()} AS sentence
FROM ids i JOIN {edge_values()} ON i.rule_id = e.from_id
WHERE EXISTS (SELECT 1 FROM ids j WHERE j.file = i.file AND j.rule_id = e.to_id)""").replace("\n, ids AS", ",\nids AS")


def _order_ctes() -> str:
    """Kahn order for the shipped edge table (ordering depth 1)."""
    return f""", {_ids_cte()},
oe AS (
  SELECT CASE WHEN rel_type IN ('BLOCKS', 'DEPENDS_ON') THEN from_id ELSE to_id END AS before,
         CASE WHEN rel_type IN ('BLOCKS', 'DEPENDS_ON') THEN to_id ELSE from_id END AS after, edge_idx
  FROM {edge_values()} WHERE rel_type IN ('BLOCKS', 'DEPENDS_ON', 'CAUSED_BY')
),
pe AS (
  SELECT i.file, oe.before, oe.after, oe.edge_idx FROM ids i JOIN oe ON i.rule_id = oe.before
  WHERE EXISTS (SELECT 1 FROM ids j WHERE j.file = i.file AND j.rule_id = oe.after)
),
r0 AS (
  SELECT file, rule_id, pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS rank FROM ids
  WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.file = ids.file AND pe.after = ids.rule_id)
),
r1 AS (
  SELECT i.file, i.rule_id, i.pos, max(r0.rank) AS brank, max(pe.edge_idx) AS eidx
  FROM ids i JOIN pe ON pe.file = i.file AND pe.after = i.rule_id
  JOIN r0 ON r0.file = pe.file AND r0.rule_id = pe.before
  GROUP BY i.file, i.rule_id, i.pos
),
ranked AS (
  SELECT file, rule_id, pos, rank FROM r0
  UNION ALL
  SELECT r1.file, r1.rule_id, r1.pos,
         (SELECT count(*) FROM r0 WHERE r0.file = r1.file)
         + row_number() OVER (PARTITION BY r1.file ORDER BY r1.brank, r1.eidx) AS rank
  FROM r1
)"""


def fix_order_sql() -> str:
    return with_f(_order_ctes() + """
SELECT file, rule_id, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank FROM ranked""").replace(
        "\n, ids AS", ",\nids AS")


def order_report_sql(findings: str | None = None) -> str:
    body = _order_ctes() + f""",
rel AS (
  SELECT i.file, e.from_id, string_agg('   - ' || {_sentence()}, chr(10) ORDER BY e.edge_idx) AS rl
  FROM ids i JOIN {edge_values()} ON i.rule_id = e.from_id
  WHERE EXISTS (SELECT 1 FROM ids j WHERE j.file = i.file AND j.rule_id = e.to_id)
  GROUP BY i.file, e.from_id
),
items AS (
  SELECT r.file, r.rank, printf('%d. **%s**', r.rank, r.rule_id) || coalesce(chr(10) || rel.rl, '') AS item
  FROM ranked r LEFT JOIN rel ON rel.file = r.file AND rel.from_id = r.rule_id
)
SELECT file, CAST(count(*) AS BIGINT) AS n_ids,
  '## Fix order' || chr(10) || chr(10) || '### Sequence' || chr(10) || chr(10)
  || string_agg(item, chr(10) ORDER BY rank) || chr(10) || chr(10) || printf('_%d issue(s) analysed._', count(*)) AS report
FROM items GROUP BY file"""
    return with_f(body, findings).replace("\n, ids AS", ",\nids AS")


def order_report_everything_sql() -> str:
    """All findings as those of one file."""
    return f"SELECT n_ids, report FROM ({order_report_sql(f'SELECT * REPLACE (0 AS file) FROM ({corpus_findings()}) a')}) r"


def relations_of_parts_sql() -> str:
    return """WITH ids AS (SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem),
edges AS (
  SELECT DISTINCT 'P' || l_partkey AS from_id, 'P' || ((l_partkey * 7 + l_suppkey) % 5000 + 1) AS to_id,
    ['BLOCKS', 'RELATED_TO', 'CAUSED_BY'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS rel_type FROM lineitem)
SELECT from_id, to_id, rel_type FROM edges
WHERE from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)"""


# ------------------------------------------------------------------ fixes
def _re2_find(rule_id: str) -> str:
    if rule_id == "TODO_FIXME":
        return to_re2(*fx.TODO_FIND)
    if rule_id == "EMPTY_CATCH":
        return to_re2(*fx.EMPTY_CATCH_FIND)
    if rule_id == "DEBUG_ENABLED":
        return to_re2(*fx.DEBUG_FIND)
    # the secret template's back-reference, as two alternatives
    return to_re2(r"""=\s*'[^'"]{4,}'|=\s*"[^'"]{4,}\"""")


def fix_plan_sql(src_sql: str | None = None) -> str:
    sec_find, _ = fx._first_only(fx.SECRET_FIND, "")
    todo = fx._first_only(fx.TODO_FIND, fx.TODO_REPLACE)
    catch = fx._first_only(fx.EMPTY_CATCH_FIND, fx.EMPTY_CATCH_REPLACE)
    debug = fx._first_only(fx.DEBUG_FIND, fx.DEBUG_REPLACE)
    env = "upper(regexp_replace(f.rule_id, '[^A-Za-z0-9_]', '_', 'g'))"
    secret_ids = ", ".join(q(i) for i in fx.SECRET_IDS)
    is_secret = f"(f.kind = 'secret' OR f.rule_id IN ({secret_ids}))"
    return with_f(f""",
src AS (SELECT file, string_split({safe_text_sql('code')}, chr(10)) AS lines FROM {src_sql or corpus_sql()} AS c),
p AS (
  SELECT f.file, f.rule_id, f.line, len(src.lines) AS n, src.lines[least(greatest(1, f.line), greatest(len(src.lines), 1))] AS orig,
    CASE WHEN {is_secret} THEN 'REPLACE' WHEN f.rule_id IN ('CONSOLE_LOG', 'SENSITIVE_DATA_LOG') THEN 'DELETE'
         WHEN f.rule_id IN ('TODO_FIXME', 'EMPTY_CATCH', 'DEBUG_ENABLED') THEN 'REPLACE' END AS fix_type,
    CASE WHEN {is_secret} THEN {q(sec_find)} WHEN f.rule_id = 'TODO_FIXME' THEN {q(todo[0])}
         WHEN f.rule_id = 'EMPTY_CATCH' THEN {q(catch[0])} WHEN f.rule_id = 'DEBUG_ENABLED' THEN {q(debug[0])} END AS find,
    CASE WHEN {is_secret} THEN '$1= process.env.' || {env} WHEN f.rule_id = 'TODO_FIXME' THEN {q(todo[1])}
         WHEN f.rule_id = 'EMPTY_CATCH' THEN {q(catch[1])} WHEN f.rule_id = 'DEBUG_ENABLED' THEN {q(debug[1])} END AS replace,
    CASE WHEN {is_secret} THEN {q(_re2_find('SECRET'))} WHEN f.rule_id = 'TODO_FIXME' THEN {q(_re2_find('TODO_FIXME'))}
         WHEN f.rule_id = 'EMPTY_CATCH' THEN {q(_re2_find('EMPTY_CATCH'))}
         WHEN f.rule_id = 'DEBUG_ENABLED' THEN {q(_re2_find('DEBUG_ENABLED'))} END AS re2_find,
    CASE WHEN {is_secret} THEN true WHEN f.rule_id = 'SENSITIVE_DATA_LOG' THEN true ELSE false END AS requires_confirmation,
    CASE WHEN {is_secret} THEN 'move the secret to process.env.' || {env}
         WHEN f.rule_id = 'CONSOLE_LOG' THEN 'remove the console call'
         WHEN f.rule_id = 'TODO_FIXME' THEN 'mark the TODO as tracked'
         WHEN f.rule_id = 'EMPTY_CATCH' THEN 'log the caught error'
         WHEN f.rule_id = 'SENSITIVE_DATA_LOG' THEN 'remove the leaking log call'
         WHEN f.rule_id = 'DEBUG_ENABLED' THEN 'derive debug from NODE_ENV' END AS description
  FROM f JOIN src ON f.file = src.file
)
SELECT file, 'fix-' || rule_id || '-' || CAST(line AS VARCHAR) AS fix_id, rule_id, fix_type, CAST(line AS INTEGER) AS line,
  find, replace, CAST(NULL AS VARCHAR) AS insert_at, CAST(NULL AS VARCHAR) AS insert_content, requires_confirmation,
  description,
  CASE WHEN fix_type = 'DELETE' THEN greatest(1, line) <= n
       ELSE greatest(1, line) <= n AND regexp_matches(orig, re2_find) END AS applied
FROM p WHERE fix_type IS NOT NULL""", findings=corpus_findings(src_sql)).replace("\n,\nsrc AS", ",\nsrc AS")


# --------------------------------------------------------------- external
def _fixture_rows_sql() -> str:
    from ..sources import external as ex

    def pick(vals, idx):
        arr = "[" + ", ".join(_v(v) for v in vals) + "]"
        return f"CAST({arr} AS VARCHAR[])[CAST(({idx}) % {len(vals)} AS INTEGER) + 1]"

    return f"""SELECT li.l_orderkey AS file, o.o_orderpriority AS prio, li.l_linenumber AS ord, li.l_partkey AS ord2,
    {pick(ex.FIXTURE_IDS, 'li.l_partkey')} AS rid, {pick(ex.FIXTURE_MESSAGES, 'li.l_suppkey')} AS msg,
    {pick(ex.FIXTURE_SEVERITIES, 'li.l_partkey + li.l_suppkey')} AS sev, li.l_linenumber AS line
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey WHERE li.l_quantity < 25"""


def _normalise_sql(col: str) -> str:
    return (f"coalesce(CASE lower({col}) WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'high' "
            f"WHEN 'info' THEN 'medium' WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' "
            f"WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' END, 'medium')")


def _external_rows(prio_filter: str) -> str:
    return f"""SELECT file, 'vulnerability' AS kind, 'Security' AS domain, coalesce(rid, 'unknown') AS rule_id,
    {_normalise_sql('sev')} AS severity, coalesce(msg, 'Vulnerability detected') AS message,
    CAST(coalesce(line, 0) AS INTEGER) AS line, CAST(-1 AS INTEGER) AS rule_seq,
    CAST(row_number() OVER (PARTITION BY file ORDER BY ord, ord2, rid NULLS FIRST, msg NULLS FIRST, sev NULLS FIRST) - 1 AS INTEGER) AS ext_pos
  FROM ({_fixture_rows_sql()}) x WHERE {prio_filter}"""


def external_api_sql() -> str:
    return _external_rows("prio IN ('1-URGENT', '2-HIGH')")


def external_cli_sql() -> str:
    return _external_rows("prio = '3-MEDIUM'")


def precedence_sql() -> str:
    return with_f(f""",
ext AS ({_external_rows("prio IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")}),
covered AS (SELECT o_orderkey AS file FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
            AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT f.*, CAST(NULL AS INTEGER) AS ext_pos FROM f
WHERE f.kind <> 'vulnerability' OR f.file NOT IN (SELECT file FROM covered)
UNION ALL
SELECT * FROM ext""").replace("\n,\next AS", ",\next AS")


# ------------------------------------------------------------------ gates
def _js_trim_sql(col: str) -> str:
    ws = to_re2(r"\s")
    return f"regexp_replace(regexp_replace({col}, {q('^' + ws + '+')}, ''), {q(ws + '+$')}, '')"


def prompt_gate_sql() -> str:
    n = f"length({_js_trim_sql('text')})"
    return f"""SELECT *, CAST({n} AS INTEGER) AS trimmed_len,
  ({n} BETWEEN 10 AND 1000) AS ok,
  CASE WHEN {n} < 10 THEN 'too_short' WHEN {n} > 1000 THEN 'too_long' END AS reason
FROM conversations"""


def sanitize_sql() -> str:
    return f"SELECT conv_id, turn, {_js_trim_sql('text')} AS sanitized FROM conversations"




# ------------------------------------------------------- applied fixes
def _fixed_corpus_body(approve_all: bool, src_sql: str | None = None) -> str:
    """CTE chain ending in `fixed(file, code_fixed, n_fixes, n_applied)`; needs `f` (findings)."""
    secret_ids = ", ".join(q(i) for i in fx.SECRET_IDS)
    is_secret = f"(kind = 'secret' OR rule_id IN ({secret_ids}))"
    usable = "true" if approve_all else f"NOT ({is_secret} OR rule_id = 'SENSITIVE_DATA_LOG')"
    fixable = f"({is_secret} OR rule_id IN ('CONSOLE_LOG', 'SENSITIVE_DATA_LOG', 'TODO_FIXME', 'EMPTY_CATCH', 'DEBUG_ENABLED'))"
    todo = q(to_re2(*fx.TODO_FIND))
    catch = q(to_re2(*fx.EMPTY_CATCH_FIND))
    debug = q(to_re2(*fx.DEBUG_FIND))
    secret = q(to_re2(r"""=\s*'[^'"]{4,}'|=\s*"[^'"]{4,}\""""))
    catch_rep = q(fx.EMPTY_CATCH_REPLACE.replace("$1", "\\1"))
    # replacements run in full-scan rule order: Security (DEBUG_ENABLED), secrets, Quality
    from ..rules import SECRET_RULES
    chain = "txt"
    chain = f"CASE WHEN dbg THEN regexp_replace({chain}, {debug}, {q(fx.DEBUG_REPLACE)}) ELSE {chain} END"
    for r in SECRET_RULES:
        env = r.rule_id.upper()
        chain = (f"CASE WHEN s_{r.rule_id.lower()} THEN regexp_replace({chain}, {secret}, "
                 f"{q('= process.env.' + env)}) ELSE {chain} END")
    chain = f"CASE WHEN ec THEN regexp_replace({chain}, {catch}, {catch_rep}) ELSE {chain} END"
    chain = f"CASE WHEN todo THEN regexp_replace({chain}, {todo}, {q(fx.TODO_REPLACE)}) ELSE {chain} END"
    secret_flags = ", ".join(f"bool_or(rule_id = {q(r.rule_id)}) AS s_{r.rule_id.lower()}" for r in SECRET_RULES)
    applied = (f"CASE WHEN rule_id IN ('CONSOLE_LOG', 'SENSITIVE_DATA_LOG') THEN true "
               f"WHEN {is_secret} THEN regexp_matches(orig, {secret}) "
               f"WHEN rule_id = 'TODO_FIXME' THEN regexp_matches(orig, {todo}) "
               f"WHEN rule_id = 'EMPTY_CATCH' THEN regexp_matches(orig, {catch}) "
               f"ELSE regexp_matches(orig, {debug}) END")
    return f""",
src AS (SELECT file, {safe_text_sql('code')} AS t FROM {src_sql or corpus_sql()} AS c),
uf AS (SELECT * FROM f WHERE {fixable} AND {usable}),
per_line AS (
  SELECT file, line, bool_or(rule_id IN ('CONSOLE_LOG', 'SENSITIVE_DATA_LOG')) AS del,
         bool_or(rule_id = 'DEBUG_ENABLED') AS dbg, bool_or(rule_id = 'EMPTY_CATCH') AS ec,
         bool_or(rule_id = 'TODO_FIXME') AS todo, {secret_flags}
  FROM uf GROUP BY file, line
),
lns AS (
  SELECT file, t, unnest(string_split(t, chr(10))) AS txt, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM src
),
rew AS (
  SELECT l.file, l.i, CASE WHEN p.line IS NULL THEN l.txt WHEN p.del THEN NULL ELSE {chain} END AS nt
  FROM lns l LEFT JOIN per_line p ON p.file = l.file AND p.line = l.i
),
cnt AS (
  SELECT uf.file, CAST(count(*) AS INTEGER) AS n_fixes,
         CAST(sum(CASE WHEN {applied} THEN 1 ELSE 0 END) AS INTEGER) AS n_applied
  FROM uf JOIN (SELECT file, i, txt AS orig FROM lns) o ON o.file = uf.file AND o.i = uf.line
  GROUP BY uf.file
),
fixed AS (
  SELECT r.file, coalesce(string_agg(r.nt, chr(10) ORDER BY r.i), '') AS code_fixed,
         coalesce(cnt.n_fixes, 0) AS n_fixes, coalesce(cnt.n_applied, 0) AS n_applied
  FROM rew r LEFT JOIN cnt ON cnt.file = r.file
  GROUP BY r.file, cnt.n_fixes, cnt.n_applied
)"""


def fixed_corpus_sql(approve_all: bool = False, src_sql: str | None = None) -> str:
    return with_f(_fixed_corpus_body(approve_all, src_sql) + "\nSELECT file, code_fixed, n_fixes, n_applied FROM fixed",
                  findings=corpus_findings(src_sql))


def before_after_sql() -> str:
    after = scan_sql("fixed", "code_fixed", ["file"], ALL_RULES, src="src2", hits="hits2")
    assert after.startswith("WITH ")
    head, _, tail = after[len("WITH "):].partition("\nSELECT ")
    return with_f(_fixed_corpus_body(False) + f""",
{head},
g AS (SELECT {tail}),
b AS (SELECT file, rule_id, count(*) AS n FROM f GROUP BY file, rule_id),
a AS (SELECT file, rule_id, count(*) AS n FROM g GROUP BY file, rule_id)
SELECT coalesce(b.file, a.file) AS file, coalesce(b.rule_id, a.rule_id) AS rule_id,
  CAST(coalesce(b.n, 0) AS BIGINT) AS before, CAST(coalesce(a.n, 0) AS BIGINT) AS after,
  CASE WHEN coalesce(a.n, 0) = 0 THEN 'fixed' WHEN coalesce(b.n, 0) = 0 THEN 'new'
       WHEN a.n < b.n THEN 'reduced' WHEN a.n = b.n THEN 'remaining' ELSE 'increased' END AS status
FROM b FULL OUTER JOIN a ON a.file = b.file AND a.rule_id = b.rule_id""")


def markdown_header_sql() -> str:
    return with_f("""SELECT printf('# Scan report' || chr(10) || chr(10) || '**%d issue(s)** across **%d file(s)**' || chr(10),
  count(*), count(DISTINCT file)) AS header FROM f""")


def _doc_findings_by_source() -> str:
    return scan_sql("documents", "text", ["doc_id", "source"], ALL_RULES)


def gate_per_source_sql() -> str:
    return with_f("""SELECT d.source, CAST(coalesce(max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END), 0) AS INTEGER)
  AS exit_code FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN f ON f.source IS NOT DISTINCT FROM d.source GROUP BY d.source""",
                  findings=_doc_findings_by_source())


def domain_counts_per_source_sql() -> str:
    return with_f("SELECT source, domain, CAST(count(*) AS BIGINT) AS n, CAST(min(rule_seq) AS INTEGER) AS first_seq "
                  "FROM f GROUP BY source, domain", findings=_doc_findings_by_source())


def severity_groups_effective_sql() -> str:
    ctx = context_sql(corpus_sql(), "code", ["file"], ALL_RULES)
    return f"""WITH c AS ({ctx})
SELECT severity_effective AS severity, CAST(count(*) AS BIGINT) AS n,
  CAST(CASE severity_effective WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
       ELSE 4 END AS INTEGER) AS group_order
FROM c GROUP BY severity_effective"""


def effective_findings() -> str:
    """The corpus findings of the editor path: severity is the context-adjusted one."""
    ctx = context_sql(corpus_sql(), "code", ["file"], ALL_RULES)
    return (f"SELECT file, kind, domain, rule_id, severity_effective AS severity, message, line, rule_seq "
            f"FROM ({ctx}) e")
