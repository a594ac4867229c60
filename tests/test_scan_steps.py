"""The scan reads a text no more often than its rules need, with the same findings."""

import random
import re

from pyspark.sql import functions as F

from codesift.functions.dialect import java_pattern
from codesift.operators import fixes as fx
from codesift.operators.context import scan_in_context
from codesift.operators.scan import scan
from codesift.rules import ALL_RULES, RULES_BY_ID

from conftest import code_df


def test_fix_planning_scans_exactly_the_rules_with_a_fix(spark):
    rules = spark.createDataFrame([(r.rule_id, r.kind) for r in ALL_RULES], "rule_id string, kind string")
    template = fx.fix_template(F.col("rule_id"), F.col("kind"), F.lit(1))
    with_fix = {r[0] for r in rules.where(template.isNotNull()).select("rule_id").collect()}
    assert {r.rule_id for r in fx.fixable(ALL_RULES)} == with_fix
    df = code_df(spark, "console.log(1);\neval(x);\nconst token = 'abcdefgh1234';", "eval(x);", None)
    plan = fx.plan_fixes(df)
    # `eval` has no fix, so its rule is not run
    assert "eval" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.file, r.rule_id, r.line) for r in plan.collect()) == [(1, "CONSOLE_LOG", 1), (1, "GENERIC_SECRET", 3)]
    # rules without any fix: an empty plan, texts as they are
    only = [r for r in ALL_RULES if r.rule_id == "EVAL_USAGE"]
    assert fx.plan_fixes(df, rules=only).count() == 0
    assert [r.code_fixed for r in fx.fixed_texts(df, rules=only).orderBy("file").collect()] == [r.code for r in df.collect()]


def test_one_marking_pass_without_a_search_before_it(spark):
    df = code_df(spark, "eval(a);\neval(b); eval(c);", "evaluate(x)", None)
    found = scan(df, rules=[RULES_BY_ID["EVAL_USAGE"]])
    assert "RLIKE" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.file, r.line) for r in found.collect()) == [(1, 1), (1, 2)]


def test_context_is_tested_once_a_text_and_cut_to_the_window(spark):
    far = "\n" * 12
    near, away = "test(\n'x');\neval(a);", f"for (;;) retry(); catch (e) test\n('x');{far}eval(a);"
    ctx = scan_in_context(code_df(spark, near, away, "eval(a);"), rules=[RULES_BY_ID["EVAL_USAGE"]])
    assert "_test_call" in ctx._jdf.queryExecution().analyzed().toString()
    flags = {r.file: (r.in_test, r.in_loop, r.loop_bounded, r.has_fallback, r.has_retry) for r in ctx.collect()}
    assert flags == {1: (True,) + (False,) * 4, 2: (False,) * 5, 3: (False,) * 5}


def test_line_starts_and_line_skeletons_as_in_javascript(spark):
    """`^` and `.` of the translated rules against their JavaScript meaning, and the short way to a skeleton."""
    rng = random.Random(7)
    parts = [".then", ".catch", "(", " ", "x", "\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029", "        if (", "\t" * 5]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    ends, blank = r"\n\r\u2028\u2029", r"[ \t\n\r\u2028\u2029]"
    plain = {
        "UNHANDLED_PROMISE": rf"(?<![^{ends}])(?![^{ends}]*\.catch(?![A-Za-z0-9_]))[^{ends}]*\.then{blank}*\(",
        "DEEP_NESTING": rf"(?<![^{ends}])(?:\t| {{2}}){{4,}}(?:if|for|while|switch){blank}*\(",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file long, code string")
    for rule_id, pattern in plain.items():
        found = {(r.file, r.line) for r in scan(df, rules=[RULES_BY_ID[rule_id]]).collect()}
        want = {(i, t.count("\n", 0, m.start()) + 1) for i, t in enumerate(texts) for m in re.finditer(pattern, t)}
        assert found == want and len(want) > 50


def test_line_ends_are_a_range():
    """Single characters beyond Latin-1 make a class many times slower than a range of them."""
    assert "\\u2028\\u2029" not in java_pattern(RULES_BY_ID["UNHANDLED_PROMISE"]).split("then")[0]
