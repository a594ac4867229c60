"""Context of a finding (C1-C5) and the editor-path severity.

The window of lines around each hit is cut inside the row, before the
explode, so the text itself is never copied onto finding rows and no join
back to the source is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import to_java
from ..functions.lines import decode_line, decode_rule, js_prefix, line_window
from ..rules import Rule, rules_for
from . import severity as sev
from .scan import HITS, TEXT, empty_findings, finding_columns, spread, with_hits

# ---------------------------------------------------------------------------
# Context patterns (JS dialect) and window bounds.
# ---------------------------------------------------------------------------
LOOP = r"\bfor\b|\bwhile\b|\bforEach\b"
LOOP_BOUND = r"\bLIMIT\b|\bslice\b|\bsplice\b|\blength\s*<"
TEST_CALL = r"\b(?:it|test|describe|expect|beforeEach|afterEach)\s*\("
TEST_FILE = r"\.test\.|\.spec\."
FALLBACK = r"catch\s*\("
NULLISH = r"\?\?"
NULLISH_TEXT = "??"
RETRY = (r"retry|retryable|backoff", "i")
NOT_PRODUCTION = (r"\bdev\b|\btest\b|\bstaging\b", "i")
WINDOW_BEFORE, WINDOW_AFTER = 4, 5  # 1-based lines L-4 .. L+5
HEAD_CHARS, HEAD_LINES = 200, 3

CONTEXT_COLUMNS = ["in_loop", "loop_bounded", "in_test", "has_fallback", "has_retry", "in_production"]


def _rl(c: Column, pat, flags: str = "", needles=()) -> Column:
    """`rlike`, behind a cheap `contains` test when the pattern needs one of `needles`."""
    if isinstance(pat, tuple):
        pat, flags = pat
    test = c.rlike(to_java(pat, flags))
    if needles:
        src = F.lower(c) if "i" in flags else c
        any_of = None
        for n in needles:
            t = src.contains(n)
            any_of = t if any_of is None else (any_of | t)
        test = any_of & test
    return test


# Necessary literals of the context patterns (exact prefilters).
LOOP_NEEDLES = ("for", "while")
LOOP_BOUND_NEEDLES = ("LIMIT", "slice", "splice", "length")
FALLBACK_NEEDLES = ("catch",)
RETRY_NEEDLES = ("retry", "backoff")


def scan_in_context(df: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
                    rules: Sequence[Rule] | None = None, iterations_col: str | None = None,
                    min_severity: str | None = None) -> DataFrame:
    """Findings plus context flags, raw and adjusted severity, and a note.

    Editor path (C9): vulnerability rows get the context-adjusted severity,
    secrets are critical, the other domains keep their raw severity.
    `iterations_col` (optional, per text) feeds the loop-size rule.
    """
    id_cols = list(id_cols)
    chosen = rules_for(min_severity=min_severity, rules=rules)
    if not chosen:
        return empty_findings(df, id_cols)
    keep = [iterations_col] if iterations_col else []
    hits = with_hits(spread(df, id_cols, text_col), text_col, id_cols, chosen, keep=keep)
    text = F.col(TEXT)
    # Windows are whole lines of the text, so what matches in none of the text matches in no window (line breaks and
    # ends of a text are the same to the patterns' boundaries): one test a text saves one a finding.
    found = F.size(HITS) > 0
    anywhere = [
        (found & _rl(text, LOOP, needles=LOOP_NEEDLES)).alias("_loop"),
        (found & _rl(text, LOOP_BOUND, needles=LOOP_BOUND_NEEDLES)).alias("_bound"),
        (found & _rl(text, TEST_CALL)).alias("_test_call"),
        (found & _rl(text, FALLBACK, needles=FALLBACK_NEEDLES)).alias("_fallback"),
        (found & text.contains(NULLISH_TEXT)).alias("_nullish"),
        (found & _rl(text, RETRY, needles=RETRY_NEEDLES)).alias("_retry"),
    ]
    gates = ["_loop", "_bound", "_test_call", "_fallback", "_nullish", "_retry"]
    lines = F.when(F.size(HITS) > 0, F.split(text, "\n", -1))
    per_row = hits.select(
        *id_cols, *keep, HITS,
        lines.alias("_lines"),
        _rl(js_prefix(text, HEAD_CHARS), TEST_FILE).alias("_test_file"),
        (~_rl(F.array_join(F.slice(F.split(text, "\n", HEAD_LINES + 1), 1, HEAD_LINES), "\n"),
              NOT_PRODUCTION)).alias("in_production"),
        *anywhere,
    )

    def cut(h):
        ln = decode_line(h)
        return F.struct(
            h.alias("h"),
            line_window(F.col("_lines"), ln, WINDOW_BEFORE, WINDOW_AFTER).alias("win"),
            F.coalesce(F.get(F.col("_lines"), F.greatest(F.lit(0), ln - 1)), F.lit("")).alias("lt"),
        )

    with_ctx = per_row.select(*id_cols, *keep, "_test_file", "in_production", *gates,
                              F.transform(HITS, cut).alias("_ctx"))
    flat = (with_ctx.select(*id_cols, *keep, "_test_file", "in_production", *gates, F.explode_outer("_ctx").alias("c"))
            .filter(F.col("c").isNotNull()))
    win, lt = F.col("c.win"), F.col("c.lt")
    flagged = flat.select(
        *id_cols, *keep,
        *finding_columns(chosen, decode_rule(F.col("c.h")), decode_line(F.col("c.h"))),
        (F.col("_loop") & _rl(win, LOOP, needles=LOOP_NEEDLES)).alias("in_loop"),
        (F.col("_bound") & _rl(win, LOOP_BOUND, needles=LOOP_BOUND_NEEDLES)).alias("loop_bounded"),
        (F.col("_test_file") | (F.col("_test_call") & _rl(win, TEST_CALL))).alias("in_test"),
        ((F.col("_fallback") & _rl(win, FALLBACK, needles=FALLBACK_NEEDLES))
         | (F.col("_nullish") & lt.contains(NULLISH_TEXT))).alias("has_fallback"),
        (F.col("_retry") & _rl(win, RETRY, needles=RETRY_NEEDLES)).alias("has_retry"),
        "in_production",
    )
    return with_severity(flagged, iterations_col)


def with_severity(findings: DataFrame, iterations_col: str | None = None) -> DataFrame:
    """Add `severity_adjusted` (C7), `severity_effective` (C9) and `severity_note`."""
    c = F.col
    iters = c(iterations_col) if iterations_col else None
    flags = dict(in_test=c("in_test"), in_loop=c("in_loop"), loop_bounded=c("loop_bounded"),
                 iterations=iters, has_fallback=c("has_fallback"), has_retry=c("has_retry"))
    adjusted = sev.adjust(c("rule_id"), **flags)
    out = findings.withColumn("severity_adjusted", adjusted)
    out = out.withColumn(
        "severity_effective",
        F.when(c("kind") == "vulnerability", c("severity_adjusted"))
        .when(c("kind") == "secret", F.lit("critical"))
        .otherwise(c("severity")))
    return out.withColumn("severity_note", sev.explain(c("rule_id"), c("severity"), c("severity_adjusted"), **flags))
