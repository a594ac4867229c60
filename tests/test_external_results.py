"""Which scanner results are usable."""

import json

import pytest

from codesift.operators.scan import scan
from codesift.sources import external as ext
from conftest import code_df

USABLE = {
    "{}": 0, "[]": 0, "5": 0, '"text"': 0, "true": 0, '{"results":null}': 0, '{"results":[]}': 0, ' {"results" : [ ] } \n': 0, '{"x":{"results":[1]}}': 0,
    '{"results":[{}]}': 1, '{"results":[{"rule_id":null,"severity":null}]}': 1, '{"results":[1,"a",[],true,{}]}': 5,
    '{"results":[{"message":{"a":1},"line":"x"}]}': 1,
}
UNUSABLE = [
    None, "", " ", "null", "not json", '{"results":[', '{"results":{}}', '{"results":"x"}', '{"results":7}', '{"results":false}', '{"results":[null]}',
    '{"results":[{},null]}', '{"results":[]} x', '{"results":[]}{}', '{"results":[]},{}', '{"results":[]}}', '{"results":[]},"end":1', '{"results":[]},"y":1',
    '{"results":[]}]', "[],[]",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file long, json string")


@pytest.mark.parametrize("paths,ingest", [(ext.API_PATHS, ext.ingest_api), (ext.CLI_PATHS, ext.ingest_cli)])
def test_usable_and_unusable_texts(spark, paths, ingest):
    df = rows(spark, [*USABLE, *UNUSABLE])
    got = df.select("file", ext.results(ext.one_value("json"), paths).isNotNull().alias("ok")).collect()
    assert [r.ok for r in sorted(got)] == [True] * len(USABLE) + [False] * len(UNUSABLE)
    counts = {r.file: r["count"] for r in ingest(df, ["file"], "json").groupBy("file").count().collect()}
    assert counts == {i: n for i, n in enumerate(USABLE.values()) if n}


def test_types_of_rule_and_severity(spark):
    api = [{"rule_id": x} for x in (5, True, {}, [])] + [{"severity": x} for x in (5, False, {}, ["high"])]
    cli = [{"check_id": 1}, {"extra": {"severity": 2}}]
    for items, paths in ((api, ext.API_PATHS), (cli, ext.CLI_PATHS)):
        df = rows(spark, [json.dumps({"results": [i]}) for i in items])
        assert df.where(ext.results(ext.one_value("json"), paths).isNotNull()).count() == 0
    # the other shape's fields are not looked at, and scalars in the place of objects have no fields
    df = rows(spark, [json.dumps({"results": [i]}) for i in ({"check_id": 1}, {"extra": "x", "start": 3}, {"extra": None})])
    assert df.where(ext.results(ext.one_value("json"), ext.API_PATHS).isNotNull()).count() == 3
    assert [r.rule_id for r in ext.ingest_cli(df.where("file > 0"), ["file"], "json").collect()] == ["unknown", "unknown"]


def test_lines_and_messages(spark):
    lines = [3, 3.9, -2, "12", "x", None, True, [], 1e30, 3000000000, -1e30]
    df = rows(spark, [json.dumps({"results": [{"rule_id": "R", "line": x, "message": x} for x in lines]})])
    got = sorted(ext.ingest_api(df, ["file"], "json").collect(), key=lambda r: r.ext_pos)
    top = 2**31 - 1
    assert [r.line for r in got][:6] == [3, 3, -2, 12, 0, 0] and [r.line for r in got][8:10] == [top, top]
    assert [r.message for r in got][:6] == ["3", "3.9", "-2", "12", "x", "Vulnerability detected"]
    assert [r.ext_pos for r in got] == list(range(len(lines)))


def test_results_of_the_wrong_shape_keep_the_built_in_findings(spark):
    shapes = ['{"results":{}}', '{"results":"x"}', "{}", '{"results":null}', '{"results":[null]}', None]
    good = '{"results":[{"check_id":"C1"}]}'
    e = spark.createDataFrame([(i + 1, s, good if i % 2 else None) for i, s in enumerate(shapes)], "file long, api_json string, cli_json string")
    found = ext.with_precedence(scan(code_df(spark, *["eval(x)"] * 7)), e, ["file"]).collect()
    assert sorted((r.file, r.rule_id) for r in found) == [(1, "EVAL_USAGE"), (2, "C1"), (5, "EVAL_USAGE"), (6, "C1"), (7, "EVAL_USAGE")]
