"""Cases that once went wrong: scanner coverage, control characters, odd edge tables, units, clean scopes."""

import json

import pytest
from pyspark.sql import functions as F

from codesift.operators import fixes, gates, relations, reports
from codesift.operators.scan import SCAN_PARTITIONS, scan, spread
from codesift.sources import external

BAD = "eval(x)\nconsole.log(y)"


@pytest.fixture()
def covered(spark):
    api = lambda *r: json.dumps({"results": list(r)})
    cli = json.dumps({"results": [{"check_id": "C1", "extra": {"message": "m", "severity": "ERROR"}, "start": {"line": 3}}]})
    rows = [
        (1, "not json at all", None), (2, '{"results": [', cli), (3, api({"rule_id": "Z9", "line": 3000000000}, {"rule_id": "A1", "line": 2}), cli),
        (4, api(), None), (4, api(), None), (5, None, cli), (5, None, cli), (6, "", "   "), (7, None, None),
    ]
    return spark.createDataFrame(rows, "file long, api_json string, cli_json string")


def test_only_parsed_results_cover_a_file(spark, covered):
    builtin = scan(spark.createDataFrame([(i, BAD) for i in range(1, 9)], "file long, code string"))
    rows = external.with_precedence(builtin, covered, ["file"]).collect()
    found = {}
    for r in rows:
        found.setdefault(r.file, []).append((r.rule_id, r.line))
    log = ("CONSOLE_LOG", 2)
    for f in (1, 6, 7, 8):  # nothing parsed: the built-in rules
        assert sorted(found[f]) == [log, ("EVAL_USAGE", 1)]
    assert sorted(found[2]) == sorted(found[5]) == [("C1", 3), log]
    assert sorted(found[3]) == [("A1", 2), log, ("Z9", 2**31 - 1)]
    assert found[4] == [log]
    order = sorted((r.ext_pos, r.rule_id) for r in rows if r.file == 3 and r.ext_pos is not None)
    assert order == [(0, "Z9"), (1, "A1")]


def test_texts_come_back_as_they_were(spark):
    texts = ["a\x01b", "// TODO x\x01\nconsole.log(1)\x01\n\x02", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "file long, code string")
    got = {r.file: r.code_fixed for r in fixes.fixed_texts(df, approve_all=True).collect()}
    assert got[0] == "a\x01b" and got[2] == "" and got[3] is None
    assert "\x01" in got[1] and got[1].endswith("\x02") and got[1].count("\x02") == 1


def test_insert_out_of_range_is_not_applied(spark):
    fix = F.struct(
        F.lit("INSERT").alias("fix_type"), F.col("line"), F.lit("new").alias("insert_content"), F.lit("ABOVE").alias("insert_at"),
        F.lit(None).cast("string").alias("find"), F.lit(None).cast("string").alias("replace"),
    )
    df = spark.createDataFrame([(1,), (2,), (3,)], "line int").select("line", F.array(F.lit("a"), F.lit("b")).alias("lines"), fix.alias("f"))
    got = df.select("line", F.when(F.col("f.fix_type") == "INSERT", fixes._applied(F.col("lines"), F.col("f"))).alias("ok")).collect()
    assert [(r.line, r.ok) for r in got] == [(1, True), (2, True), (3, False)]


@pytest.mark.parametrize("edges", [[], [("A", "B", "RELATED", 1, "no order")]])
def test_fix_order_without_ordering_edges(spark, edges):
    ids = spark.createDataFrame([(1, "B", 1), (1, "A", 2), (2, "A", 1)], "file long, rule_id string, pos int")
    got = relations.fix_order(ids, ["file"], edges).collect()
    assert sorted((r.file, r["rank"], r.rule_id) for r in got) == [(1, 1, "B"), (1, 2, "A"), (2, 1, "A")]
    assert relations.order_report(ids, ["file"], edges).count() == 2


def test_long_chain_of_edges_needs_no_recursion():
    chain = [(f"N{i}", f"N{i + 1}", "BLOCKS", 1, "") for i in range(5000)]
    assert relations._rounds(chain) == 5000
    assert relations._rounds(chain[:3] + [("N3", "N0", "BLOCKS", 1, "")]) == 4


def test_lengths_in_utf16_units(spark):
    df = spark.createDataFrame([("😀" * 5,), ("a" * 9,)], "text string")
    assert [(r.trimmed_len, r.ok) for r in gates.prompt_gate(df).collect()] == [(10, True), (9, False)]
    code = spark.createDataFrame([(1, "eval(😀)")], "file long, code string")
    assert [r.end_col for r in reports.diagnostics(code).collect()] == [8]


def test_clean_scopes_pass_the_gate(spark):
    code = spark.createDataFrame([(1, "eval(x)"), (2, "fine")], "file long, code string")
    got = reports.gate(scan(code), ["file"], scopes=code).collect()
    assert sorted((r.file, r.exit_code) for r in got) == [(1, 1), (2, 0)]


def test_partitions_are_the_caller_s(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "SortKey long, code string").coalesce(1)
    assert spread(df, ["SortKey"], "code", partitions=4).rdd.getNumPartitions() == 4
    spark.conf.unset(SCAN_PARTITIONS)
    assert spread(df, ["SortKey"], "code").rdd.getNumPartitions() == 1


def test_a_null_scope_keeps_its_critical_finding(spark):
    scopes = spark.createDataFrame([(None, "a"), ("s", "a"), ("t", None)], "source string, file string")
    found = spark.createDataFrame([(None, "a", "critical"), ("t", None, "critical"), ("s", "a", "low")], "source string, file string, severity string")
    got = {(r.source, r.file): r.exit_code for r in reports.gate(found, ["source", "file"], scopes=scopes).collect()}
    assert got == {(None, "a"): 1, ("s", "a"): 0, ("t", None): 1}
    assert {(r.source, r.exit_code) for r in reports.gate(found, ["source"], scopes=scopes).collect()} == {(None, 1), ("s", 0), ("t", 1)}
