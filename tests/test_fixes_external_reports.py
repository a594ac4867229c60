"""Fixes, external results, reports and gates."""

import json

from pyspark.sql import functions as F

from codesift.operators import fixes as fx
from codesift.operators import gates as gt
from codesift.operators import reports as rp
from codesift.operators.scan import scan
from codesift.sources import external as ext
from conftest import code_df


def test_fix_plan_and_apply(spark):
    code = "\n".join([
        "console.log('x');",
        "// TODO: later",
        "try { a(); } catch (err) { }",
        'const token = "abcdefgh12345678";',
        "const cfg = { debug: true };",
        "keep();",
    ])
    df = code_df(spark, code)
    plan = {r.rule_id: r for r in fx.plan_fixes(df).collect()}
    assert plan["CONSOLE_LOG"].fix_type == "DELETE" and plan["CONSOLE_LOG"].fix_id == "fix-CONSOLE_LOG-1"
    assert plan["GENERIC_SECRET"].requires_confirmation and plan["GENERIC_SECRET"].applied
    fixed = fx.fixed_texts(df).collect()[0].code_fixed.split("\n")
    assert fixed == ["// TRACKED: later", "try { a(); } catch (err) { console.error(err); }",
                     'const token = "abcdefgh12345678";', "const cfg = { debug: process.env.NODE_ENV !== 'production' };",
                     "keep();"]
    approved = fx.fixed_texts(df, approve_all=True).collect()[0].code_fixed.split("\n")
    assert approved[2] == "const token = process.env.GENERIC_SECRET;"


def test_before_after(spark):
    df = code_df(spark, "console.log(1);\neval(x);")
    fixed = fx.fixed_texts(df).select("file", F.col("code_fixed").alias("code"))
    ba = {r.rule_id: r.status for r in fx.before_after(scan(df), scan(fixed), ["file"]).collect()}
    assert ba["CONSOLE_LOG"] == "fixed" and ba["EVAL_USAGE"] == "remaining"


def test_external_ingest_and_precedence(spark):
    api = json.dumps({"results": [{"rule_id": "X1", "severity": "ERROR", "line": 3}, {"message": "m"}]})
    cli = json.dumps({"results": [{"check_id": "C1", "extra": {"severity": "warning"}, "start": {"line": 2}}]})
    e = spark.createDataFrame([(1, api, None), (2, None, cli), (3, None, None), (4, '{"results": []}', None)],
                              "file long, api_json string, cli_json string")
    a = ext.ingest_api(e.filter("api_json is not null"), ["file"], "api_json").collect()
    assert [(r.rule_id, r.severity, r.line, r.message) for r in a if r.file == 1] == [
        ("X1", "critical", 3, "Vulnerability detected"), ("unknown", "medium", 0, "m")]
    c = ext.ingest_cli(e.filter("cli_json is not null"), ["file"], "cli_json").collect()
    assert [(r.rule_id, r.severity, r.line) for r in c] == [("C1", "high", 2)]
    built = scan(code_df(spark, "eval(a);", "eval(b);", "eval(c); console.log(1);", "eval(d);"))
    out = ext.with_precedence(built, e, ["file"]).collect()
    by_file = {}
    for r in out:
        by_file.setdefault(r.file, set()).add(r.rule_id)
    assert by_file[1] == {"X1", "unknown"} and by_file[2] == {"C1"}
    assert by_file[3] == {"EVAL_USAGE", "CONSOLE_LOG"} and 4 not in by_file  # covered, zero results


def test_reports(spark):
    f = scan(code_df(spark, "eval(a);\nconsole.log(b);", "let x = 1;"))
    assert rp.gate(f).collect()[0].exit_code == 1
    s = rp.summary(f).collect()[0]
    assert s.summary == f"{s.total} issue(s), {s.critical} critical."
    empty = f.filter("false")
    assert rp.summary(empty).collect()[0].summary == "No issues detected."
    assert rp.text_totals(empty).collect()[0].footer == "No issues found."
    block = {r.file: r.block for r in rp.text_report(f).collect()}[1]
    assert block.startswith("\n=== 1 (2 issue(s)) ===\n  [CRITICAL] L1: EVAL_USAGE")
    lab = rp.labels(f).filter("rule_id = 'EVAL_USAGE'").collect()[0]
    assert lab.label == "[L1]  EVAL_USAGE" and lab.description.startswith("[SEC]  ")
    groups = [r.severity for r in rp.severity_groups(f).orderBy("group_order").collect()]
    assert groups == ["critical", "low"]
    js = json.loads(rp.json_report(f).filter("file = 1").collect()[0].json)
    assert [i["id"] for i in js["issues"]] == ["EVAL_USAGE", "CONSOLE_LOG"]


def test_diagnostics(spark):
    d = rp.diagnostics(code_df(spark, "x\n  eval(a);", 'const password = "hunter22";')).collect()
    ev = [r for r in d if r.rule_id == "EVAL_USAGE"][0]
    assert (ev.line_index, ev.end_col, ev.level) == (1, 10, "Error")
    pw = [r for r in d if r.rule_id == "PASSWORD"][0]
    assert pw.level == "Error"


def test_prompt_gate(spark):
    df = spark.createDataFrame([("  short  ",), ("x" * 20,), ("y" * 1001,), (" " + "z" * 9 + "\n",)], "text string")
    got = [(r.ok, r.reason) for r in gt.prompt_gate(df).collect()]
    assert got == [(False, "too_short"), (True, None), (False, "too_long"), (False, "too_short")]


def test_apply_insert_delete_replace_and_multi_file(spark):
    fixes = [
        {"fix_id": "a", "rule_id": "X", "fix_type": "INSERT", "line": 2, "find": None, "replace": None,
         "insert_at": "ABOVE", "insert_content": "// above 2", "requires_confirmation": False, "description": ""},
        {"fix_id": "b", "rule_id": "X", "fix_type": "INSERT", "line": 2, "find": None, "replace": None,
         "insert_at": "END", "insert_content": "// below 2", "requires_confirmation": False, "description": ""},
        {"fix_id": "c", "rule_id": "X", "fix_type": "DELETE", "line": 3, "find": None, "replace": None,
         "insert_at": None, "insert_content": None, "requires_confirmation": False, "description": ""},
        {"fix_id": "d", "rule_id": "X", "fix_type": "REPLACE", "line": 9, "find": "(?s)\\A(.*?)x", "replace": "$1y",
         "insert_at": None, "insert_content": None, "requires_confirmation": False, "description": ""},
    ]
    schema = ("file long, code string, fx array<struct<fix_id string, rule_id string, fix_type string, line int, "
              "find string, replace string, insert_at string, insert_content string, requires_confirmation boolean, "
              "description string>>")
    df = spark.createDataFrame([(1, "l1\nl2\nl3\nl4", fixes)], schema)
    out = df.select(fx.apply_to_lines(F.split("code", "\n", -1), F.col("fx")).alias("t")).collect()[0].t
    assert out == "l1\n// above 2\nl2\n// below 2\nl4"  # line 9 is out of range: no-op


def test_fix_and_rescan_equals_two_scans(spark):
    df = code_df(spark, "console.log(1);\neval(x);\n// TODO a", "let q = 1;", "nothing here")
    fixed = fx.fixed_texts(df).select("file", F.col("code_fixed").alias("code"))
    two = {tuple(r) for r in fx.before_after(scan(df), scan(fixed), ["file"]).collect()}
    one = {tuple(r) for r in fx.fix_and_rescan(df).collect()}
    assert one == two and len(one) > 0
