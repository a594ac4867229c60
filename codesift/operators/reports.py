"""Roll-ups, gates and rendered reports.

Every report is a DataFrame: one row per file, domain or scope, so it can be
written with `.write.text/json` in parallel. Grouped text is built with
`collect_list` + `array_sort` per group; a group is one file's (or one
domain-of-a-scope's) findings, never the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import decode_line, decode_rule, js_length, js_prefix
from ..rules import SEVERITY_ORDER, Rule, rules_for
from ..session import materialize
from .knowledge import with_explanation
from .ranking import rank_in_groups
from .scan import HITS, TEXT, rule_attr, spread, with_hits

ORDER = ("rule_seq", "line")

# Report formats.
TEXT_HEADER = "\n=== %s (%d issue(s)) ==="
TEXT_ITEM = "  [%s] L%d: %s — %s"
TEXT_TOTAL = "\nTotal: %d issue(s) in %d file(s)."
MD_ITEM = "- **[%s] L%d** `%s` — %s"
LISTING = "[%s][%s] L%d: %s (%s)"
PREVIEW_CHARS = 52


def _sev_order(sev: Column) -> Column:
    m = F.create_map(*[x for i, s in enumerate(SEVERITY_ORDER) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(m[sev], F.lit(len(SEVERITY_ORDER)))


def severity_groups(findings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A1: count per severity, critical..low, empty groups absent."""
    return (findings.groupBy(*scope, "severity").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .withColumn("group_order", _sev_order(F.col("severity")).cast("int")))


def severity_members(findings: DataFrame, order: Sequence[str] = ("file", *ORDER)) -> DataFrame:
    """A1 with its members: the findings, each with its group's place and its own `rank` in the group, in input order.

    The groups are four hot keys, so the ranks come from sorted partitions, not from a window per severity.
    """
    placed = materialize(findings.withColumn("group_order", _sev_order(F.col("severity")).cast("int")))  # the scan runs once
    return rank_in_groups(placed, ["group_order"], list(order))


def domain_counts(findings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A2: count per domain; `first_seq` gives first-seen order."""
    return findings.groupBy(*scope, "domain").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min("rule_seq").cast("int").alias("first_seq"))


def totals(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """A3: findings and files with findings (one row, also for an empty input)."""
    return findings.agg(F.count(F.lit(1)).cast("bigint").alias("n_findings"),
                        F.count_distinct(*[F.col(c) for c in file_cols]).cast("bigint").alias("n_files"))


def per_file_counts(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """A4."""
    return findings.groupBy(*file_cols).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def summary(findings: DataFrame, severity_col: str = "severity") -> DataFrame:
    """A5: total, critical count and the one-line summary (three forms)."""
    agg = findings.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                       F.sum(F.when(F.col(severity_col) == "critical", 1).otherwise(0)).cast("bigint").alias("critical"))
    total, crit = F.col("total"), F.coalesce(F.col("critical"), F.lit(0)).cast("bigint")
    text = (F.when(total == 0, F.lit("No issues detected."))
            .when(crit > 0, F.format_string("%d issue(s), %d critical.", total, crit))
            .otherwise(F.format_string("%d issue(s).", total)))
    return agg.select(total.alias("total"), crit.alias("critical"), text.alias("summary"))


def gate(findings: DataFrame, scope: Sequence[str] = (), scopes: DataFrame | None = None) -> DataFrame:
    """Exit code 1 when any finding is critical, else 0 (per scope, or one row).

    `scopes` lists all scopes (e.g. the scanned files), so that clean ones pass
    with 0 instead of being absent.
    """
    if scope and scopes is not None:
        found = gate(findings, scope)
        listed = scopes.select(*scope).distinct().alias("s")
        same = reduce(and_, [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in scope])
        return (listed.join(found.alias("f"), same, "left")
                .select(*[F.col(f"s.{c}") for c in scope],
                        F.coalesce("f.exit_code", F.lit(0)).cast("int").alias("exit_code")))
    crit = F.max(F.when(F.col("severity") == "critical", 1).otherwise(0))
    if scope:
        return findings.groupBy(*scope).agg(F.coalesce(crit, F.lit(0)).cast("int").alias("exit_code"))
    return findings.agg(F.coalesce(crit, F.lit(0)).cast("int").alias("exit_code"))


def distinct_ids(findings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A7."""
    return findings.select(*scope, "rule_id").distinct()


def labels(findings: DataFrame) -> DataFrame:
    """Row label, 3-letter domain badge and message preview (52 chars + ellipsis)."""
    msg = F.col("message")
    preview = F.when(js_length(msg) > PREVIEW_CHARS,
                     F.concat(js_prefix(msg, PREVIEW_CHARS), F.lit("…"))).otherwise(msg)
    return findings.select(
        "*",
        F.format_string("[L%d]  %s", F.col("line"), F.col("rule_id")).alias("label"),
        F.format_string("[%s]  %s", F.upper(F.substring("domain", 1, 3)), preview).alias("description"))


def diagnostics(df: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
                rules: Sequence[Rule] | None = None) -> DataFrame:
    """Editor diagnostics for Security rows from the raw severity.

    critical/high and every secret -> Error, else Warning; range on the line
    index (at least 0) from column 0 to the length of that line, the line taken
    clipped into the file. Computed in-row (needs the line text).
    """
    id_cols = list(id_cols)
    chosen = rules_for(domains=["Security"], rules=rules)
    hits = with_hits(spread(df, id_cols, text_col), text_col, id_cols, chosen)
    lines = F.when(F.size(HITS) > 0, F.split(F.col(TEXT), "\n", -1))
    p = hits.select(*id_cols, HITS, lines.alias("_lines"))

    def diag(h):
        r, ln = decode_rule(h), decode_line(h)
        idx = F.greatest(F.lit(0), ln - 1)
        clip = F.least(idx, F.size("_lines") - 1)
        sev, kind, rid = rule_attr(chosen, r, "severity"), rule_attr(chosen, r, "kind"), rule_attr(chosen, r, "rule_id")
        level = F.when((kind == "secret") | sev.isin("critical", "high"), "Error").otherwise("Warning")
        msg = F.when(kind == "secret", F.format_string("%s detected, use an environment variable", rid)) \
            .otherwise(F.format_string("%s (%s)", rule_attr(chosen, r, "message"), rid))
        return F.struct(rid.alias("rule_id"), ln.alias("line"), idx.cast("int").alias("line_index"),
                        js_length(F.get(F.col("_lines"), clip)).alias("end_col"),
                        level.alias("level"), msg.alias("diag_message"))

    out = p.select(*id_cols, F.transform(HITS, diag).alias("_d"))
    return (out.select(*id_cols, F.explode_outer("_d").alias("d")).filter(F.col("d").isNotNull())
            .select(*id_cols, "d.*"))


def _sorted_items(item: Column, order: Sequence[str] = ORDER) -> Column:
    key = F.struct(*[F.col(c) for c in order], item.alias("_txt"))
    return F.transform(F.array_sort(F.collect_list(key)), lambda x: x["_txt"])


def json_report(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """One JSON document per file with findings: {file, issues: [...]} in report order.

    Each issue carries its whole explanation (null if there is none).
    """
    # the issue's own fields order the list; a rule's explanation follows from its id
    issue = F.struct("rule_seq", "line", F.col("rule_id").alias("id"), "domain", "severity",
                     F.col("rule_id").alias("title"), "message", "explanation")
    per = with_explanation(findings).groupBy(*file_cols).agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    issues = F.transform("issues", lambda i: i.dropFields("rule_seq"))
    document = F.struct(*[F.col(c) for c in file_cols], issues.alias("issues"))
    return per.select(*file_cols, F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def text_report(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """Per-file block `=== file (n issue(s)) ===` + one line per finding."""
    item = F.format_string(TEXT_ITEM, F.upper("severity"), F.col("line"), F.col("rule_id"), F.col("message"))
    fid = F.concat_ws("/", *[F.col(c).cast("string") for c in file_cols])
    per = findings.groupBy(*file_cols).agg(_sorted_items(item).alias("items"), F.count(F.lit(1)).alias("n"))
    return per.select(*file_cols, F.concat(F.format_string(TEXT_HEADER, fid, F.col("n")), F.lit("\n"),
                                           F.array_join("items", "\n")).alias("block"))


def text_totals(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """S6 footer: total line, or the fixed sentence when there is nothing."""
    t = totals(findings, file_cols)
    return t.select("n_findings", "n_files", F.when(F.col("n_findings") == 0, F.lit("No issues found."))
                    .otherwise(F.format_string(TEXT_TOTAL, F.col("n_findings"), F.col("n_files"))).alias("footer"))


def markdown_report(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """`## \\`file\\`` section with bullets per file (title and totals from `markdown_header`)."""
    item = F.format_string(MD_ITEM, F.upper("severity"), F.col("line"), F.col("rule_id"), F.col("message"))
    fid = F.concat_ws("/", *[F.col(c).cast("string") for c in file_cols])
    per = findings.groupBy(*file_cols).agg(_sorted_items(item).alias("items"))
    return per.select(*file_cols, F.concat(F.lit("## `"), fid, F.lit("`\n"), F.array_join("items", "\n"),
                                           F.lit("\n")).alias("section"))


def markdown_header(findings: DataFrame, file_cols: Sequence[str] = ("file",)) -> DataFrame:
    t = totals(findings, file_cols)
    return t.select(F.format_string("# Scan report\n\n**%d issue(s)** across **%d file(s)**\n",
                                    F.col("n_findings"), F.col("n_files")).alias("header"))


def domain_report_header(findings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The head of a scope's domain report, with its total."""
    per = findings.groupBy(*scope).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return per.select(*scope, "n", F.format_string("Findings report\nTotal: %d issue(s)", F.col("n")).alias("header"))


def domain_report(findings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per (scope, domain); a scope (a file, a source) bounds the section, so it must be given.

    Per (scope, domain) a section `--- Domain (n) ---` with each finding and,
    when an explanation exists, what / why / first step / reference."""
    if not scope:
        raise ValueError("give the columns of the scope: one text per domain of everything has no bound")
    f = with_explanation(findings)
    ex = F.col("explanation")
    detail = F.when(ex.isNotNull(), F.concat_ws(
        "\n", F.concat(F.lit("  What: "), ex["what"]), F.concat(F.lit("  Why:  "), ex["why"]),
        F.when(F.size(ex["steps"]) > 0, F.concat(F.lit("  Fix:  "), F.get(ex["steps"], 0)["title"])),
        F.concat(F.lit("  Ref:  "), ex["standard"]["url"])))
    item = F.concat_ws("\n", F.format_string("[%s] L%d: %s", F.upper("severity"), F.col("line"), F.col("rule_id")),
                       F.concat(F.lit("  "), F.col("message")), detail)
    per = f.groupBy(*scope, "domain").agg(_sorted_items(item).alias("items"), F.count(F.lit(1)).alias("n"),
                                          F.min("rule_seq").alias("first_seq"))
    return per.select(*scope, "domain", F.col("n").cast("bigint").alias("n"), F.col("first_seq").cast("int"),
                      F.concat(F.format_string("--- %s (%d) ---\n", F.col("domain"), F.col("n")),
                               F.array_join("items", "\n\n")).alias("section"))


def listing(findings: DataFrame) -> DataFrame:
    """One line per finding, plus fix title and a link (docs URL, else the standard's)."""
    f = with_explanation(findings)
    ex = F.col("explanation")
    head = F.format_string(LISTING, F.col("domain"), F.upper("severity"), F.col("line"), F.col("message"),
                           F.col("rule_id"))
    more = F.when(ex.isNotNull(), F.concat(
        F.lit("\n  Fix: "), F.coalesce(F.get(ex["steps"], 0)["title"], F.lit("")),
        F.lit("\n  Ref: "), F.coalesce(ex["example"]["docs_url"], ex["standard"]["url"])))
    return f.select(*[c for c in findings.columns], F.concat(head, F.coalesce(more, F.lit(""))).alias("entry"))


