"""DuckDB (RE2) SQL for the scan, used as the correctness oracle.

RE2 has no lookaround. The eight rules that use it get exact rewrites:
a negative lookahead becomes a first pass that spoils the first character of
every candidate the lookahead would reject (chr(3) never occurs in the input),
followed by the plain pattern; `^` in multiline mode consumes the preceding
line terminator and the mark goes after it. The other 37 run as written,
with JavaScript's `\\s` and `.` spelled out (see `functions.dialect`).
"""

from __future__ import annotations

from ..functions.dialect import to_re2
from ..rules import Rule
from ..operators.scan import RULE_SEQ

EOL = r"\n\r\x{2028}\x{2029}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _mark(t: str, re2: str) -> str:
    return f"regexp_replace({t}, {q(re2)}, chr(1) || '\\0', 'g')"


def _spoil(t: str, re2_with_group: str) -> str:
    """Replace the first (ungrouped) part of each match by chr(3), keep group 1."""
    return f"regexp_replace({t}, {q(re2_with_group)}, chr(3) || '\\1', 'g')"


def marked_sql(rule: Rule, t: str) -> str:
    """SQL expression: `t` with chr(1) before every match start of `rule`."""
    rid = rule.rule_id
    if rid == "XSS_INNER_HTML":
        return _mark(t, to_re2(r"\.innerHTML\s*\+?=(?:[^=]|$)"))
    if rid == "DEBUG_ENABLED":
        s = _spoil(t, to_re2(r"(?:debug|DEBUG)(\s*[:=]\s*true\s*(?:&&|\|\|))"))
        return _mark(s, to_re2(r"(?:debug|DEBUG)\s*[:=]\s*true"))
    if rid == "COOKIE_INSECURE":
        body = r"\.cookie\s*\(\s*['" + '"' + r"][^'" + '"' + r"]+['" + '"' + r"]\s*,\s*[^,)]+\s*\)"
        s = _spoil(t, to_re2("res(" + body + r"\s*;?\s*\/\/)"))
        return _mark(s, to_re2("res" + body))
    if rid == "DANGEROUS_HTML":
        body = r"SetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:"
        s = _spoil(t, to_re2("dangerously(" + body) + f"[^{EOL}]*DOMPurify)")
        return _mark(s, to_re2("dangerously" + body))
    if rid == "MAGIC_NUMBER":
        marked = f"regexp_replace({t}, {q(to_re2(r'(^|[^.\w])(\d{2,})\b'))}, '\\1' || chr(1) || '\\2', 'g')"
        unit = to_re2(r"(\d+\s*[,\]\)]?\s*(?:ms|px|vh|vw|em|rem|%|s\b))")
        return f"regexp_replace({marked}, chr(1) || {q(unit)}, '\\1', 'g')"
    if rid == "UNHANDLED_PROMISE":
        poisoned = (f"regexp_replace({t}, {q(f'(^|[{EOL}])([^{EOL}]*' + to_re2(r'\.catch\b') + ')')}, "
                    f"'\\1' || chr(3) || '\\2', 'g')")
        space = to_re2(r"\s")[1:-1]
        base = f"(^|[{EOL}])((?:[^{EOL}\\x03][^{EOL}]*)?\\.then[{space}\\x03]*\\()"
        return f"regexp_replace({poisoned}, {q(base)}, '\\1' || chr(1) || '\\2', 'g')"
    if rid == "MISSING_TIMEOUT":
        body = r"(\s+fetch\s*\(\s*[^,)]+\s*\)"
        s = _spoil(t, to_re2(r"\bawait" + body + r"\s*\/\*[^*]*timeout)"))
        return _mark(s, to_re2(r"\bawait" + body + ")"))
    if rid == "NO_PAGINATION":
        quote = "['\"`]"
        body = r"SELECT\s+\*\s+FROM\s+\w+(?:\s+WHERE[^'" + '"`' + r"]*)?" + quote
        s = _spoil(t, to_re2(quote + "(" + body + r"[^'" + '"`' + r",;]*\bLIMIT\b)", "i"))
        return _mark(s, to_re2(quote + body, "i"))
    if rid == "DEEP_NESTING":
        base = f"(^|[{EOL}])(" + to_re2(r"(?:\t| {2}){4,}(?:if|for|while|switch)\s*\(") + ")"
        return f"regexp_replace({t}, {q(base)}, '\\1' || chr(1) || '\\2', 'g')"
    if "(?=" in rule.pattern or "(?!" in rule.pattern or "(?<" in rule.pattern or "m" in rule.flags:
        raise ValueError(f"{rid}: no RE2 form")
    return _mark(t, to_re2(rule.pattern, rule.flags))


def lines_sql(marked: str) -> str:
    """Distinct ascending 1-based lines holding a mark (DuckDB list)."""
    skel = f"regexp_replace({marked}, '[^\\n\\x01]+', '', 'g')"
    return (f"list_filter(list_transform(string_split({skel}, chr(10)), "
            f"lambda x, i: CASE WHEN x <> '' THEN i END), lambda x: x IS NOT NULL)")


def safe_text_sql(text: str) -> str:
    return f"translate({text}, chr(1) || chr(3), chr(2) || chr(2))"


def rules_values_sql(rules) -> str:
    rows = ",\n    ".join(
        f"({j}, {q(r.kind)}, {q(r.domain)}, {q(r.rule_id)}, {q(r.severity)}, {q(r.message)}, {RULE_SEQ[r.rule_id]})"
        for j, r in enumerate(rules))
    return f"(VALUES\n    {rows}) AS rl(r, kind, domain, rule_id, severity, message, rule_seq)"


def scan_sql(source: str, text_col: str, id_cols, rules, src: str = "src", hits: str = "hits") -> str:
    """Findings of `rules` over `source` (a table name or parenthesised query)."""
    ids = ", ".join(id_cols)
    parts = []
    for j, r in enumerate(rules):
        parts.append(f"SELECT {ids}, {j} AS r, unnest({lines_sql(marked_sql(r, 't'))}) AS line FROM {src}")
    union = "\n  UNION ALL\n  ".join(parts)
    out_ids = ", ".join(f"h.{c}" for c in id_cols)
    return f"""WITH {src} AS (SELECT {ids}, {safe_text_sql(text_col)} AS t FROM {source} AS s0),
{hits} AS (
  {union}
)
SELECT {out_ids}, rl.kind, rl.domain, rl.rule_id, rl.severity, rl.message,
       CAST(h.line AS INTEGER) AS line, CAST(rl.rule_seq AS INTEGER) AS rule_seq
FROM {hits} h JOIN {rules_values_sql(rules)} ON h.r = rl.r"""


# ------------------------------------------------------------------ context
def _in(col: str, ids) -> str:
    return f"{col} IN ({', '.join(q(i) for i in ids)})"


def severity_sql_columns(iterations: str = "NULL") -> str:
    """SQL for severity_adjusted / severity_effective / severity_note over flag columns."""
    from ..operators import severity as sev

    base = (f"(CASE WHEN {_in('rule_id', sev.CRITICAL_IDS)} THEN 'critical' "
            f"WHEN {_in('rule_id', sev.HIGH_IDS)} THEN 'high' ELSE 'medium' END)")
    down = f"(CASE WHEN {base} = 'critical' THEN 'high' WHEN {base} = 'high' THEN 'medium' ELSE 'low' END)"
    b = lambda c: f"coalesce({c}, false)"
    it = f"coalesce({iterations}, 0)"
    unbounded = f"({b('in_loop')} AND NOT {b('loop_bounded')})"
    adjusted = (f"(CASE WHEN {_in('rule_id', sev.PINNED_SECURITY_IDS)} AND {base} = 'critical' THEN 'critical' "
                f"WHEN {b('in_test')} THEN {down} "
                f"WHEN {unbounded} AND rule_id = 'SEQUENTIAL_ASYNC' THEN "
                f"(CASE WHEN {it} > {sev.ITERATIONS_LIMIT} THEN 'critical' ELSE 'high' END) "
                f"WHEN {unbounded} AND rule_id = 'N_PLUS_ONE' THEN 'critical' "
                f"WHEN {b('has_fallback')} OR {b('has_retry')} THEN {down} "
                f"ELSE {base} END)")
    rank = lambda c: (f"(CASE {c} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 "  # noqa: E731
                      f"WHEN 'critical' THEN 3 ELSE 0 END)")
    reasons = ("concat_ws(', ', "
               f"CASE WHEN {b('in_test')} THEN 'found in test code' END, "
               f"CASE WHEN {unbounded} THEN 'inside a loop with no bound' END, "
               f"CASE WHEN {it} > {sev.ITERATIONS_LIMIT} THEN 'loop may run more than 1000 times' END, "
               f"CASE WHEN {b('has_fallback')} THEN 'a fallback handles failure' END, "
               f"CASE WHEN {b('has_retry')} THEN 'retry logic present' END)")
    note = (f"CASE WHEN severity = severity_adjusted THEN printf('[%s] %s: no context adjustment', rule_id, severity) "
            f"ELSE printf('%s from %s to %s because: %s.', "
            f"CASE WHEN {rank('severity_adjusted')} > {rank('severity')} THEN 'Upgraded' ELSE 'Downgraded' END, "
            f"severity, severity_adjusted, {reasons}) END")
    return adjusted, note


def context_sql(source: str, text_col: str, id_cols, rules, iterations: str = "NULL") -> str:
    from ..operators import context as cx

    ids = ", ".join(id_cols)
    join = " AND ".join(f"f.{c} = src.{c}" for c in id_cols)
    rx = lambda pat, flags="": q(to_re2(pat, flags))
    adjusted, note = severity_sql_columns(iterations)
    return f"""WITH f AS ({scan_sql(source, text_col, id_cols, rules)}),
src AS (SELECT {ids}, {safe_text_sql(text_col)} AS t FROM {source} AS s1),
j AS (
  SELECT f.*, string_split(src.t, chr(10)) AS lines, src.t AS t FROM f JOIN src ON {join}
),
w AS (
  SELECT *, array_to_string(list_slice(lines, greatest(1, line - {cx.WINDOW_BEFORE}),
                                       least(len(lines), line + {cx.WINDOW_AFTER})), chr(10)) AS win,
         coalesce(lines[greatest(1, line)], '') AS lt
  FROM j
),
flags AS (
  SELECT {ids}, kind, domain, rule_id, severity, message, line, rule_seq,
         regexp_matches(win, {rx(cx.LOOP)}) AS in_loop,
         regexp_matches(win, {rx(cx.LOOP_BOUND)}) AS loop_bounded,
         regexp_matches(win, {rx(cx.TEST_CALL)}) OR regexp_matches(substr(t, 1, {cx.HEAD_CHARS}), {rx(cx.TEST_FILE)}) AS in_test,
         regexp_matches(win, {rx(cx.FALLBACK)}) OR regexp_matches(lt, {rx(cx.NULLISH)}) AS has_fallback,
         regexp_matches(win, {rx(*cx.RETRY)}) AS has_retry,
         NOT regexp_matches(array_to_string(list_slice(lines, 1, {cx.HEAD_LINES}), chr(10)), {rx(*cx.NOT_PRODUCTION)}) AS in_production
  FROM w
),
adj AS (SELECT *, {adjusted} AS severity_adjusted FROM flags)
SELECT *, CASE WHEN kind = 'vulnerability' THEN severity_adjusted WHEN kind = 'secret' THEN 'critical'
               ELSE severity END AS severity_effective,
       {note} AS severity_note
FROM adj"""
