"""Severity: normalisation (D11), id-based base severity (C6), context
adjustment (C7), explanation (C8). All column expressions; no UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import SEVERITY_RANK

# ---------------------------------------------------------------------------
# Id sets of the severity model. They name `XSS` and `EVAL_USE`
# although the rules emit `XSS_INNER_HTML` and `EVAL_USAGE`; kept as they are.
# ---------------------------------------------------------------------------
PINNED_SECURITY_IDS = [
    "SQL_INJECTION", "XSS", "EVAL_USE", "COMMAND_INJECTION", "PATH_TRAVERSAL",
    "JWT_INSECURE", "NOSQL_INJECTION", "SSRF", "PROTOTYPE_POLLUTION",
    "CORS_ALL_ORIGINS", "COOKIE_INSECURE", "OPEN_REDIRECT", "DANGEROUS_HTML",
]
HIGH_IDS = [
    "SEQUENTIAL_ASYNC", "N_PLUS_ONE", "SQL_INJECTION", "XSS", "EVAL_USE",
    "COMMAND_INJECTION", "PATH_TRAVERSAL", "UNHANDLED_PROMISE", "SYNC_FILE_IN_SERVER",
    "NO_INPUT_VALIDATION", "JWT_INSECURE", "NOSQL_INJECTION", "SSRF",
    "PROTOTYPE_POLLUTION", "DANGEROUS_HTML",
]
CRITICAL_IDS = ["SQL_INJECTION", "XSS", "COMMAND_INJECTION", "PATH_TRAVERSAL", "EVAL_USE"]
# External severity names: error->critical, warning->high, info->medium, own names kept.
NORMALISE = {"error": "critical", "warning": "high", "info": "medium",
             "critical": "critical", "high": "high", "medium": "medium", "low": "low"}
ITERATIONS_LIMIT = 1000


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def rank(sev: Column) -> Column:
    """0..3 for low..critical; unknown -> 0."""
    return F.coalesce(_map(SEVERITY_RANK)[sev], F.lit(0))


def normalise(raw: Column) -> Column:
    """Case-insensitive map of scanner severities, default medium."""
    return F.coalesce(_map(NORMALISE)[F.lower(raw)], F.lit("medium"))


def base_severity(rule_id: Column) -> Column:
    """From the id alone (the rule's own severity is not used)."""
    return (F.when(rule_id.isin(CRITICAL_IDS), "critical")
            .when(rule_id.isin(HIGH_IDS), "high")
            .otherwise("medium"))


def downgrade(sev: Column) -> Column:
    return (F.when(sev == "critical", "high")
            .when(sev == "high", "medium")
            .otherwise("low"))


def _b(c: Column | None) -> Column:
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


def adjust(rule_id: Column, in_test=None, in_loop=None, loop_bounded=None, iterations=None,
           has_fallback=None, has_retry=None) -> Column:
    """First applicable step wins; missing flags count as false."""
    base = base_severity(rule_id)
    unbounded = _b(in_loop) & ~_b(loop_bounded)
    iters = F.coalesce(iterations, F.lit(0)) if iterations is not None else F.lit(0)
    return (F.when(rule_id.isin(PINNED_SECURITY_IDS) & (base == "critical"), "critical")
            .when(_b(in_test), downgrade(base))
            .when(unbounded & (rule_id == "SEQUENTIAL_ASYNC"),
                  F.when(iters > ITERATIONS_LIMIT, "critical").otherwise("high"))
            .when(unbounded & (rule_id == "N_PLUS_ONE"), "critical")
            .when(_b(has_fallback) | _b(has_retry), downgrade(base))
            .otherwise(base))


def explain(rule_id: Column, original: Column, adjusted: Column, in_test=None, in_loop=None,
            loop_bounded=None, iterations=None, has_fallback=None, has_retry=None) -> Column:
    """Why the severity moved; reasons in a fixed order, joined by ', '."""
    iters = F.coalesce(iterations, F.lit(0)) if iterations is not None else F.lit(0)
    reasons = F.concat_ws(
        ", ",
        F.when(_b(in_test), F.lit("found in test code")),
        F.when(_b(in_loop) & ~_b(loop_bounded), F.lit("inside a loop with no bound")),
        F.when(iters > ITERATIONS_LIMIT, F.lit("loop may run more than 1000 times")),
        F.when(_b(has_fallback), F.lit("a fallback handles failure")),
        F.when(_b(has_retry), F.lit("retry logic present")),
    )
    direction = F.when(rank(adjusted) > rank(original), "Upgraded").otherwise("Downgraded")
    return (F.when(original == adjusted,
                   F.format_string("[%s] %s: no context adjustment", rule_id, original))
            .otherwise(F.format_string("%s from %s to %s because: %s.", direction, original, adjusted, reasons)))
