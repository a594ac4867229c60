"""Registered queries: each a Spark plan over the given tables, most with an
equivalent DuckDB SQL text used as the oracle.

`QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, sql or None)`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fix_table as ft
from ..operators import fixes as fx
from ..operators import gates as gt
from ..operators import knowledge as kn
from ..operators import relations as rel
from ..operators import reports as rp
from ..operators import sinks as sk
from ..operators.context import scan_in_context
from ..operators.scan import scan
from ..rules import (ALL_RULES, DEVOPS_RULES, QUALITY_RULES, SCALABILITY_RULES, SECRET_RULES,
                     SECURITY_RULES, rules_for)
from ..session import read_table
from ..sources import external as ext
from ..sources.corpus import N_SNIPPETS, code_corpus, corpus_sql, snippet_code_column, snippets_sql
from ..sources.fix_list import approvals_of, fix_list
from . import oracle_fixes as of
from . import oracle_more as om
from .oracle_scan import context_sql, scan_sql

SparkFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[SparkFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: SparkFn) -> SparkFn:
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- scan core
def _corpus_scan(rules):
    return lambda spark, sf: scan(code_corpus(spark, sf), "code", ["file"], rules=rules)


for _name, _rules in [
    ("scan_security", SECURITY_RULES),
    ("scan_secrets", SECRET_RULES),
    ("scan_quality", QUALITY_RULES),
    ("scan_devops", DEVOPS_RULES),
    ("scan_scalability", SCALABILITY_RULES),
    ("scan_full", ALL_RULES),
]:
    register(_name, scan_sql(corpus_sql(), "code", ["file"], _rules))(_corpus_scan(_rules))

_HIGH = rules_for(min_severity="high")
register("scan_min_high", scan_sql(corpus_sql(), "code", ["file"], _HIGH))(
    lambda spark, sf: scan(code_corpus(spark, sf), "code", ["file"], min_severity="high"))


@register("scan_documents", scan_sql("documents", "text", ["doc_id"], ALL_RULES))
def scan_documents(spark, sf):
    return scan(read_table(spark, sf, "documents"), "text", ["doc_id"])


@register("scan_pages", scan_sql("pages", "html", ["page_id"], ALL_RULES))
def scan_pages(spark, sf):
    return scan(read_table(spark, sf, "pages"), "html", ["page_id"])


@register("scan_conversations", scan_sql("conversations", "text", ["conv_id", "turn"], ALL_RULES))
def scan_conversations(spark, sf):
    return scan(read_table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


@register("scan_conversations_with_code", scan_sql(f"""(
  SELECT conv_id, turn, text || chr(10) || s.code AS text FROM conversations
  JOIN {snippets_sql()} ON s.sid = (conv_id + turn) % {N_SNIPPETS})""", "text", ["conv_id", "turn"], ALL_RULES))
def scan_conversations_with_code(spark, sf):
    """S2 over chat turns that carry a snippet each; the plain turns hold no findings."""
    c = read_table(spark, sf, "conversations")
    code = snippet_code_column(((F.col("conv_id") + F.col("turn")) % N_SNIPPETS).cast("int"))
    return scan(c.select("conv_id", "turn", F.concat("text", F.lit("\n"), code).alias("text")), "text", ["conv_id", "turn"])


@register("scan_benchmark", scan_sql("benchmark", "text", ["item_id"], ALL_RULES))
def scan_benchmark(spark, sf):
    return scan(read_table(spark, sf, "benchmark"), "text", ["item_id"])


# ------------------------------------------------------ context and severity
@register("scan_in_context", context_sql(corpus_sql(), "code", ["file"], ALL_RULES))
def q_scan_in_context(spark, sf):
    return scan_in_context(code_corpus(spark, sf), "code", ["file"])


@register("relations_of_parts", om.relations_of_parts_sql())
def q_relations_of_parts(spark, sf):
    """G2 over one scope of everything with a table of edges that grows with the data: parts that follow each other."""
    li = read_table(spark, sf, "lineitem")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    ids = li.select(name(F.col("l_partkey")).alias("rule_id"), F.lit(0).alias("pos")).distinct()
    kinds = F.array(F.lit("BLOCKS"), F.lit("RELATED_TO"), F.lit("CAUSED_BY"))
    edges = li.select(
        name(F.col("l_partkey")).alias("from_id"), name((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 5000 + 1).alias("to_id"),
        F.element_at(kinds, (F.col("l_suppkey") % 3).cast("int") + 1).alias("rel_type")).distinct()
    return rel.relationships_in_scope(ids, [], edges).select("from_id", "to_id", "rel_type")


@register("scan_in_context_iterations", context_sql(corpus_sql(), "code", ["file"], ALL_RULES, iterations="file % 2500"))
def q_scan_in_context_iterations(spark, sf):
    """C7 with the caller's own loop counts: more than 1,000 of them raise SEQUENTIAL_ASYNC to critical."""
    code = code_corpus(spark, sf).withColumn("iterations", F.col("file") % 2500)
    return scan_in_context(code, "code", ["file"], iterations_col="iterations").drop("iterations")


@register("documents_in_context", context_sql("documents", "text", ["doc_id"], ALL_RULES))
def q_documents_in_context(spark, sf):
    return scan_in_context(read_table(spark, sf, "documents"), "text", ["doc_id"])


# ------------------------------------------------------------- everything else


def corpus_findings(spark, sf):
    return scan(code_corpus(spark, sf), "code", ["file"])


def _on_findings(name, sql, fn):
    register(name, sql)(lambda spark, sf: fn(corpus_findings(spark, sf)))


_on_findings("severity_groups", om.severity_groups_sql(), rp.severity_groups)
_on_findings("severity_members", om.severity_members_sql(), rp.severity_members)
_on_findings("domain_counts", om.domain_counts_sql(), rp.domain_counts)
_on_findings("totals", om.totals_sql(), rp.totals)
_on_findings("per_file_counts", om.per_file_counts_sql(), rp.per_file_counts)
_on_findings("summary", om.summary_sql(), rp.summary)


@register("gate_per_file", om.gate_per_file_sql())
def q_gate_per_file(spark, sf):
    return rp.gate(corpus_findings(spark, sf), ["file"], scopes=code_corpus(spark, sf))


_on_findings("gate", om.gate_sql(), rp.gate)
_on_findings("distinct_ids_per_file", om.distinct_ids_sql(), lambda f: rp.distinct_ids(f, ["file"]))
_on_findings("labels", om.labels_sql(), rp.labels)
_on_findings("text_report", om.text_report_sql(), rp.text_report)
_on_findings("text_totals", om.text_totals_sql(), rp.text_totals)
_on_findings("markdown_report", om.markdown_report_sql(), rp.markdown_report)
_on_findings("json_report", om.json_report_sql(), rp.json_report)
for _fmt, _sql in [("text", om.text_report_file_sql()), ("markdown", om.markdown_report_file_sql()), ("listing", om.listing_file_sql()),
                   ("domain", om.domain_report_file_sql())]:
    _on_findings(f"{_fmt}_report_file", _sql, lambda f, fmt=_fmt: sk.written(f.sparkSession, f, fmt))
_on_findings("domain_report", om.domain_report_sql(), lambda f: rp.domain_report(f, ["file"]))
_on_findings("domain_report_header", om.domain_report_header_sql(), lambda f: rp.domain_report_header(f, ["file"]))
_on_findings("guide_coverage", om.guide_coverage_sql(), kn.guide_coverage)
_on_findings("listing", om.listing_sql(), rp.listing)
_on_findings("explain_findings", om.explain_findings_sql(), lambda f: kn.with_explanation(f).select(
    "file", "rule_id", "line", "explanation.what", "explanation.why",
    F.col("explanation.standard.name").alias("standard_name"),
    F.col("explanation.standard.cwe_name").alias("cwe_name"),
    F.col("explanation.standard.url").alias("standard_url"),
    F.get(F.col("explanation.steps"), 0)["title"].alias("fix_title"),
    F.col("explanation.example.docs_url").alias("docs_url")))
_on_findings("explanation_details", om.explanation_details_sql(), kn.explanation_detail_rows)
_on_findings("issue_sheets", om.issue_sheets_sql(), kn.issue_sheet)
_on_findings("guide_domains_found", om.guide_domains_found_sql(), lambda f: f.join(
    F.broadcast(kn.guide_ids_for_domain(f.sparkSession, None)), "rule_id").groupBy("guide_domain", "rule_id", "guide_pos")
    .agg(F.count(F.lit(1)).cast("bigint").alias("n_findings")))
_on_findings("relations_from_found", om.relations_from_found_sql(), lambda f: rel.relationships_from(
    f.select("rule_id").distinct()).select(
    "rule_id", "to_id", "rel_type", F.col("priority").cast("int"), F.col("edge_idx").cast("int"),
    rel.sentence(F.col("from_id"), F.col("to_id"), F.col("rel_type"), F.col("reason")).alias("sentence")))
_on_findings("relations_in_file", om.relations_in_file_sql(), lambda f: rel.relationships_in_scope(
    rel.scope_ids(f, ["file"]), ["file"]).select(
    "file", "from_id", "to_id", "rel_type", F.col("priority").cast("int"), F.col("edge_idx").cast("int"),
    rel.sentence(F.col("from_id"), F.col("to_id"), F.col("rel_type"), F.col("reason")).alias("sentence")))
_on_findings("fix_order_per_file", om.fix_order_sql(), lambda f: rel.fix_order(rel.scope_ids(f, ["file"]), ["file"]))
_on_findings("order_report_per_file", om.order_report_sql(), lambda f: rel.order_report(
    rel.scope_ids(f, ["file"]), ["file"]))


@register("order_report_everything", om.order_report_everything_sql())
def q_order_report_everything(spark, sf):
    """G6 over one scope of everything: ids ranked over sorted partitions, edges met by joins."""
    return rel.order_report(rel.scope_ids(corpus_findings(spark, sf), []), [])


@register("guide_findings", om.guide_findings_sql())
def q_guide_findings(spark, sf):
    c = scan_in_context(code_corpus(spark, sf), "code", ["file"])
    g = kn.with_guide(c, in_test=F.col("in_test"))
    return g.select("file", "rule_id", "line", "in_test", F.col("guide.severity").alias("guide_severity"),
                    F.col("guide.confidence").alias("confidence"), F.col("guide.env_var").alias("env_var"),
                    F.array_join(F.col("guide.related"), ", ").alias("related"),
                    F.col("fix_minutes").cast("int"), F.col("gain_ms").cast("double"))


@register("guide_gains", om.guide_gains_sql())
def q_guide_gains(spark, sf):
    """K4 with the caller's loop counts: the gain of a fix grows with them."""
    g = kn.with_guide(corpus_findings(spark, sf), iterations=(F.col("file") % 2500).cast("double"))
    return g.where("guide IS NOT NULL").select("file", "rule_id", "line", F.col("fix_minutes").cast("int"), "gain_ms")


@register("diagnostics", om.diagnostics_sql())
def q_diagnostics(spark, sf):
    return rp.diagnostics(code_corpus(spark, sf), "code", ["file"])


@register("fix_plan", om.fix_plan_sql())
def q_fix_plan(spark, sf):
    return fx.plan_fixes(code_corpus(spark, sf), "code", ["file"])


@register("fixed_corpus", om.fixed_corpus_sql(False))
def q_fixed_corpus(spark, sf):
    return fx.fixed_texts(code_corpus(spark, sf), "code", ["file"])


@register("fixed_corpus_approved", om.fixed_corpus_sql(True))
def q_fixed_corpus_approved(spark, sf):
    return fx.fixed_texts(code_corpus(spark, sf), "code", ["file"], approve_all=True)


@register("fix_table_texts", of.fix_table_texts_sql())
def q_fix_table_texts(spark, sf):
    """F4-F8 with an outside list of fixes: literal and regex finds, inserts, approvals, refused rows."""
    listed = fix_list(spark, sf)
    done = ft.apply_fixes(code_corpus(spark, sf), listed, approved=approvals_of(listed))
    return done.texts.select("file", "code_fixed", "n_applied")


@register("fix_table_statuses", of.fix_table_statuses_sql())
def q_fix_table_statuses(spark, sf):
    listed = fix_list(spark, sf)
    return ft.apply_fixes(code_corpus(spark, sf), listed, approved=approvals_of(listed)).statuses


@register("fixed_corpus_some_approved", of.some_approved_sql())
def q_fixed_corpus_some_approved(spark, sf):
    """F8: of the fixes that need confirmation only those on an outside list of approvals."""
    plan = fx.plan_fixes(code_corpus(spark, sf), "code", ["file"])
    approved = plan.where("requires_confirmation AND (file + line) % 2 = 0").select("file", "fix_id")
    return fx.fixed_texts(code_corpus(spark, sf), "code", ["file"], approved=approved)


@register("before_after", om.before_after_sql())
def q_before_after(spark, sf):
    return fx.fix_and_rescan(code_corpus(spark, sf), "code", ["file"])


@register("external_api", om.external_api_sql())
def q_external_api(spark, sf):
    e = ext.external_fixture(spark, sf)
    return ext.ingest_api(e.filter(F.col("api_json").isNotNull()), ["file"], "api_json")


@register("external_cli", om.external_cli_sql())
def q_external_cli(spark, sf):
    e = ext.external_fixture(spark, sf)
    return ext.ingest_cli(e.filter(F.col("cli_json").isNotNull()), ["file"], "cli_json")


@register("scan_with_external", om.precedence_sql())
def q_scan_with_external(spark, sf):
    return ext.with_precedence(corpus_findings(spark, sf), ext.external_fixture(spark, sf), ["file"])


@register("scan_with_odd_external", of.odd_precedence_sql())
def q_scan_with_odd_external(spark, sf):
    """D10 over results of every shape: what is no usable result falls back to the next source."""
    return ext.with_precedence(corpus_findings(spark, sf), ext.odd_external_fixture(spark, sf), ["file"])


@register("prompt_gate", om.prompt_gate_sql())
def q_prompt_gate(spark, sf):
    return gt.prompt_gate(read_table(spark, sf, "conversations"), "text")


@register("sanitize_conversations", om.sanitize_sql())
def q_sanitize(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", gt.sanitize(F.col("text")).alias("sanitized"))


@register("stream_scan_documents", scan_sql("documents", "text", ["doc_id"], ALL_RULES))
def q_stream_scan_documents(spark, sf):
    from ..streaming.scan_stream import stream_table_findings

    return stream_table_findings(spark, sf, "documents", "text", ["doc_id"])


@register("rescan_documents", scan_sql("""(
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 5 = 0 THEN text || chr(10) || 'eval(added);' ELSE text END AS text
  FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 <> 0)""", "text", ["doc_id"], ALL_RULES))
def q_rescan_documents(spark, sf):
    """Documents arrive twice, some changed or withdrawn; only what holds now is left."""
    from ..streaming.rescan import rescanned_documents

    return rescanned_documents(spark, sf)


_on_findings("markdown_header", om.markdown_header_sql(), rp.markdown_header)


# ------------------------------------------------- the same operators on given text tables
def as_file_code(spark, sf, table, id_col, text_col):
    return read_table(spark, sf, table).select(F.col(id_col).alias("file"), F.col(text_col).alias("code"))


_DOCS = om.as_file_code("documents", "doc_id", "text")
_PAGES = om.as_file_code("pages", "page_id", "html")


@register("documents_fix_plan", om.fix_plan_sql(_DOCS))
def q_documents_fix_plan(spark, sf):
    return fx.plan_fixes(as_file_code(spark, sf, "documents", "doc_id", "text"))


@register("documents_redacted", om.fixed_corpus_sql(True, _DOCS))
def q_documents_redacted(spark, sf):
    """Approved fixes on documents: hardcoded secrets become environment lookups."""
    return fx.fixed_texts(as_file_code(spark, sf, "documents", "doc_id", "text"), approve_all=True)


@register("documents_diagnostics", om.diagnostics_sql(_DOCS))
def q_documents_diagnostics(spark, sf):
    return rp.diagnostics(as_file_code(spark, sf, "documents", "doc_id", "text"))


@register("pages_text_report", om.text_report_sql(_PAGES))
def q_pages_text_report(spark, sf):
    return rp.text_report(scan(as_file_code(spark, sf, "pages", "page_id", "html")))


@register("documents_text_report", om.text_report_sql(_DOCS))
def q_documents_text_report(spark, sf):
    return rp.text_report(scan(as_file_code(spark, sf, "documents", "doc_id", "text")))


# ------------------------------------------------- repository scope (documents.source)
def _doc_findings_by_source(spark, sf):
    return scan(read_table(spark, sf, "documents"), "text", ["doc_id", "source"])


@register("gate_per_source", om.gate_per_source_sql())
def q_gate_per_source(spark, sf):
    return rp.gate(_doc_findings_by_source(spark, sf), ["source"], scopes=read_table(spark, sf, "documents"))


@register("domain_counts_per_source", om.domain_counts_per_source_sql())
def q_domain_counts_per_source(spark, sf):
    return rp.domain_counts(_doc_findings_by_source(spark, sf), ["source"])


@register("severity_groups_effective", om.severity_groups_effective_sql())
def q_severity_groups_effective(spark, sf):
    """A1 over the editor path: vulnerability rows grouped by their context-adjusted severity."""
    ctx = scan_in_context(code_corpus(spark, sf), "code", ["file"])
    return rp.severity_groups(ctx.select(F.col("severity_effective").alias("severity")))


# ------------------------------------------------- editor path: adjusted severity
def effective_findings(spark, sf):
    """Corpus findings whose severity is the context-adjusted one, as the editor shows them."""
    ctx = scan_in_context(code_corpus(spark, sf), "code", ["file"])
    return ctx.withColumn("severity", F.col("severity_effective")).select(
        "file", "kind", "domain", "rule_id", "severity", "message", "line", "rule_seq")


for _name, _sql, _fn in [
    ("summary_effective", om.summary_sql, rp.summary),
    ("listing_effective", om.listing_sql, rp.listing),
    ("domain_report_effective", om.domain_report_sql, lambda f: rp.domain_report(f, ["file"])),
    ("issue_sheets_effective", om.issue_sheets_sql, kn.issue_sheet),
]:
    register(_name, _sql(om.effective_findings()))(lambda spark, sf, fn=_fn: fn(effective_findings(spark, sf)))
