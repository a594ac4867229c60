"""The scan core: one row per text in, one row per finding out.

For every rule whose literals it holds, the text gets one regex pass
(`regexp_replace` marks each match start) and, if that found something, one
strip pass; the distinct match lines come out of the newline skeleton in order. All rules of a row are evaluated in one projection
and exploded once. No shuffle, no Python.

Finding row: id columns, kind, domain, rule_id, severity, message, line,
rule_seq (position of the rule in the full-scan order; with `line` it gives
the reference's report order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import java_pattern, java_skip
from ..functions.lines import MARK, decode_line, decode_rule, line_skeleton, mark_matches, safe_text, skeleton_codes_sql
from ..rules import ALL_RULES, SEVERITY_RANK, Rule, rules_for

RULE_SEQ = {r.rule_id: i for i, r in enumerate(ALL_RULES)}

FINDING_FIELDS = [
    T.StructField("kind", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("rule_seq", T.IntegerType()),
]
FINDING_COLUMNS = [f.name for f in FINDING_FIELDS]

SCAN_PARTITIONS = "spark.codesift.scanPartitions"
TEXT = "_text"
HITS = "_hits"


def _needle_test(r: Rule, text: Column, lower_text: Column | None) -> Column | None:
    """AND over needle groups, OR inside a group (a plain string is a group of one)."""
    if not r.needles:
        return None
    src = lower_text if ("i" in r.flags and lower_text is not None) else text
    groups = [r.needles] if all(isinstance(n, str) for n in r.needles) else r.needles
    out = None
    for g in groups:
        g = (g,) if isinstance(g, str) else g
        any_of = None
        for n in g:
            # `contains` scans bytes with a first-byte check; `instr` counts characters at every position
            t = src.contains(n.lower() if "i" in r.flags else n)
            any_of = t if any_of is None else (any_of | t)
        out = any_of if out is None else (out & any_of)
    return out


def spread(df: DataFrame, id_cols: Sequence[str], text_col: str | None = None,
           partitions: int | None = None) -> DataFrame:
    """Hash-spread a table over `partitions` tasks; by default it keeps the partitions of its files.

    Regex scanning is CPU-bound, so a table in few unsplittable files may want
    more tasks than files. That is the caller's decision: the argument, or the
    session setting `spark.codesift.scanPartitions`. Nothing depends on sizes
    or on the shape of the plan. The key is the ids plus a hash of the text:
    retries are deterministic, and a hot id value still spreads evenly.
    """
    if partitions is None:
        setting = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
        partitions = int(setting) if setting else None
    if df.isStreaming or not partitions:
        return df
    key = [F.col(c) for c in id_cols] + ([F.xxhash64(F.col(text_col))] if text_col else [])
    return df.repartition(partitions, *key)


def with_hits(df: DataFrame, text_col: str, id_cols: Sequence[str], rules: Sequence[Rule],
              keep: Sequence[str] = (), prefilter: bool = True) -> DataFrame:
    """Add `_text` (the safe text) and `_hits` array<bigint> per row.

    Each hit is `r << 32 | line` with `r` indexing `rules`; hits are ordered
    by rule, then line (see `explode_hits`).
    """
    cols = list(dict.fromkeys([*id_cols, *keep]))
    base = df.select(*cols, safe_text(F.col(text_col)).alias(TEXT))
    text = F.col(TEXT)
    lower_text = None
    if prefilter and any("i" in r.flags and r.needles for r in rules):
        base = base.select("*", F.lower(text).alias("_lower"))
        lower_text = F.col("_lower")
    marked, skels = [], []
    for j, r in enumerate(rules):
        pat, skip = java_pattern(r), java_skip(r)
        # cheap literal test, then the marking pass; only texts that got a mark are stripped
        test = _needle_test(r, text, lower_text) if prefilter else None
        if skip is not None:  # a match begins with its opener
            test = text.rlike(skip) if test is None else test & text.rlike(skip)
        marks = mark_matches(text, pat, skip)
        marked.append((marks if test is None else F.when(test, marks).otherwise(F.lit(""))).alias(f"_m{j}"))
        m = F.col(f"_m{j}")
        skels.append(F.when(m.contains(MARK), line_skeleton(m)).otherwise(F.lit("")).alias(f"_s{j}"))
    step = base.select(*cols, TEXT, *marked).select(*cols, TEXT, *skels)
    per_rule = ", ".join(skeleton_codes_sql(f"_s{j}", j) for j in range(len(rules)))
    return step.select(*cols, TEXT, F.expr(f"flatten(array({per_rule}))").alias(HITS))


def rule_attr(rules: Sequence[Rule], pos: Column, attr: str) -> Column:
    """Look a rule attribute up by position from a literal array (no join)."""
    if attr == "rule_seq":
        values = [F.lit(RULE_SEQ.get(r.rule_id, -1)) for r in rules]
    else:
        values = [F.lit(getattr(r, attr)) for r in rules]
    return F.element_at(F.array(*values), pos + 1)


def finding_columns(rules: Sequence[Rule], pos: Column, line: Column) -> list[Column]:
    return [
        rule_attr(rules, pos, "kind").alias("kind"),
        rule_attr(rules, pos, "domain").alias("domain"),
        rule_attr(rules, pos, "rule_id").alias("rule_id"),
        rule_attr(rules, pos, "severity").alias("severity"),
        rule_attr(rules, pos, "message").alias("message"),
        line.cast("int").alias("line"),
        rule_attr(rules, pos, "rule_seq").cast("int").alias("rule_seq"),
    ]


def empty_findings(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in id_cols] + FINDING_FIELDS)
    return df.sparkSession.createDataFrame([], schema)


def scan(df: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
         rules: Sequence[Rule] | None = None, domains=None, kinds=None,
         min_severity: str | None = None, prefilter: bool = True, partitions: int | None = None) -> DataFrame:
    """Findings of `rules` (default: all 45) over `df[text_col]`.

    `min_severity` keeps findings whose raw severity ranks at least that high
    (D12); it prunes the rule list before scanning.
    """
    id_cols = list(id_cols)
    chosen = rules_for(domains=domains, kinds=kinds, min_severity=min_severity, rules=rules)
    if not chosen:
        return empty_findings(df, id_cols)
    hits = with_hits(spread(df, id_cols, text_col, partitions), text_col, id_cols, chosen, prefilter=prefilter)
    flat = explode_hits(hits, id_cols)
    return flat.select(*id_cols, *finding_columns(chosen, F.col("r"), F.col("line")))


def explode_hits(hits: DataFrame, cols: Sequence[str], field: str = HITS) -> DataFrame:
    """One row per hit.

    `inline_outer` + a null filter instead of `inline`: for a plain `inline`
    Catalyst infers `size(hits) > 0` and pushes it below the projections,
    which would run every regex twice.
    """
    flat = hits.select(*cols, F.explode_outer(F.col(field)).alias("_h")).filter(F.col("_h").isNotNull())
    return flat.select(*cols, decode_rule(F.col("_h")).alias("r"), decode_line(F.col("_h")).alias("line"))


def severity_rank(sev: Column) -> Column:
    """Rank of a severity name; unknown names rank 0 (as the CLI filter does)."""
    m = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[sev], F.lit(0))


def filter_min_severity(findings: DataFrame, min_severity: str = "low") -> DataFrame:
    """D12 on an existing findings table (e.g. with external rows mixed in)."""
    if min_severity not in SEVERITY_RANK:
        return findings.filter(F.lit(False))
    return findings.filter(severity_rank(F.col("severity")) >= SEVERITY_RANK[min_severity])
