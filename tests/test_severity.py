"""Context flags and the severity model (exhaustive over ids x flags)."""

import itertools

from pyspark.sql import functions as F

from codesift.operators import severity as sev
from codesift.operators.context import scan_in_context
from codesift.rules import ALL_RULES
from conftest import code_df

CRIT = set(sev.CRITICAL_IDS)
HIGH = set(sev.HIGH_IDS)
PINNED = set(sev.PINNED_SECURITY_IDS)


def expected(rid, in_test, in_loop, bounded, iters, fallback, retry):
    base = "critical" if rid in CRIT else "high" if rid in HIGH else "medium"
    down = {"critical": "high", "high": "medium", "medium": "low", "low": "low"}
    if rid in PINNED and base == "critical":
        return "critical"
    if in_test:
        return down[base]
    if in_loop and not bounded:
        if rid == "SEQUENTIAL_ASYNC":
            return "critical" if (iters or 0) > 1000 else "high"
        if rid == "N_PLUS_ONE":
            return "critical"
    if fallback or retry:
        return down[base]
    return base


def test_adjust_exhaustive(spark):
    ids = sorted({r.rule_id for r in ALL_RULES} | CRIT | HIGH | PINNED | {"FOREIGN_ID"})
    rows = [(rid, *flags, iters) for rid in ids for flags in itertools.product([False, True], repeat=5)
            for iters in (None, 10, 5000)]
    df = spark.createDataFrame(rows, "rule_id string, t boolean, l boolean, b boolean, f boolean, r boolean, it int")
    c = F.col
    out = df.select("*", sev.adjust(c("rule_id"), c("t"), c("l"), c("b"), c("it"), c("f"), c("r")).alias("a")).collect()
    for x in out:
        assert x.a == expected(x.rule_id, x.t, x.l, x.b, x.it, x.f, x.r), x


def test_id_mismatch_gives_medium(spark):
    df = spark.createDataFrame([("EVAL_USAGE",), ("XSS_INNER_HTML",), ("EVAL_USE",)], "rule_id string")
    got = {r.rule_id: r.s for r in df.select("rule_id", sev.base_severity(F.col("rule_id")).alias("s")).collect()}
    assert got == {"EVAL_USAGE": "medium", "XSS_INNER_HTML": "medium", "EVAL_USE": "critical"}


def test_explain_texts(spark):
    df = spark.createDataFrame([("SQL_INJECTION", "critical", "critical", False, None),
                                ("SEQUENTIAL_ASYNC", "high", "medium", True, None),
                                ("SEQUENTIAL_ASYNC", "high", "critical", False, 2000)],
                               "id string, o string, a string, t boolean, it int")
    c = F.col
    notes = [r.n for r in df.select(sev.explain(c("id"), c("o"), c("a"), in_test=c("t"), in_loop=F.lit(True),
                                                iterations=c("it")).alias("n")).collect()]
    assert "no context adjustment" in notes[0]
    assert notes[1].startswith("Downgraded") and "test code" in notes[1]
    assert notes[2].startswith("Upgraded")


def test_normalise(spark):
    df = spark.createDataFrame([("ERROR",), ("warning",), ("Info",), ("LOW",), ("bogus",), (None,)], "s string")
    assert [r.n for r in df.select(sev.normalise(F.col("s")).alias("n")).collect()] == \
        ["critical", "high", "medium", "low", "medium", "medium"]


def test_context_flags(spark):
    code = 'describe("suite", () => {\n  it("t", () => {\n    eval(x);\n  });\n});'
    r = [x for x in scan_in_context(code_df(spark, code)).collect() if x.rule_id == "EVAL_USAGE"][0]
    assert r.in_test and r.severity_effective == "low"  # base medium, one step down
    loop = "for (const u of us) {\n  await db.q(u);\n}"
    rows = {x.rule_id: x for x in scan_in_context(code_df(spark, loop)).collect()}
    assert rows["N_PLUS_ONE"].in_loop and not rows["N_PLUS_ONE"].loop_bounded
    assert rows["N_PLUS_ONE"].severity_adjusted == "critical"
    assert rows["N_PLUS_ONE"].severity_effective == "high"  # editor path adjusts Security rows only
    fb = "try {\n  eval(x);\n} catch (e) { log(e); }"
    r = [x for x in scan_in_context(code_df(spark, fb)).collect() if x.rule_id == "EVAL_USAGE"][0]
    assert r.has_fallback and r.severity_effective == "low"


def test_iterations_column_feeds_loop_rule(spark):
    code = "while (queue.length) {\n  await step();\n}"
    df = spark.createDataFrame([(1, code, 5000), (2, code, 10), (3, code, None)], "file long, code string, it int")
    rows = {r.file: r for r in scan_in_context(df, iterations_col="it").collect() if r.rule_id == "SEQUENTIAL_ASYNC"}
    assert rows[1].severity_adjusted == "critical" and rows[2].severity_adjusted == "high"
    assert rows[3].severity_adjusted == "high"
    assert rows[1].severity_effective == "high"  # Scalability rows keep their raw severity on the editor path
    assert rows[1].severity_note.startswith("Upgraded") and "1000" in rows[1].severity_note
