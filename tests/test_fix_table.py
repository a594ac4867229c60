"""Fixes from a table and approvals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesift.operators import fix_table as ft
from codesift.operators import fixes as fx
from conftest import code_df

SCHEMA = (
    "file long, fix_id string, fix_type string, line int, find string, find_kind string, replace string, insert_at string, "
    "insert_content string, requires_confirmation boolean, seq long"
)


def fix(file, fix_id, fix_type, line, find=None, replace=None, kind="literal", at=None, content=None, confirm=False, seq=None):
    return (file, fix_id, fix_type, line, find, kind, replace, at, content, confirm, seq)


def applied(spark, texts, fixes, approved=None):
    t = spark.createDataFrame(texts, "file long, code string")
    ok = None if approved is None else spark.createDataFrame(approved, "file long, fix_id string")
    done = ft.apply_fixes(t, spark.createDataFrame(fixes, SCHEMA), approved=ok)
    return sorted((str(r.file), r.code_fixed, r.n_applied) for r in done.texts.collect()), {
        (r.file, r.fix_id): r.status for r in done.statuses.collect()}


def test_each_type_and_status(spark):
    text = "a = 1;\nb = 2;\nc = 3;\nd = 4;"
    fixes = [
        fix(1, "r", "REPLACE", 1, "1", "one"), fix(1, "no", "REPLACE", 1, "zzz", "y"), fix(1, "same", "REPLACE", 1, "a", "a"),
        fix(1, "i1", "INSERT", 2, at="ABOVE", content="// up"), fix(1, "i2", "INSERT", 2, at="BEGINNING", content="// down"),
        fix(1, "d", "DELETE", 3), fix(1, "lost", "REPLACE", 3, "c", "x"), fix(1, "i3", "INSERT", 3, content="// stays"),
        fix(1, "far", "DELETE", 5), fix(1, "zero", "REPLACE", 0, "=", ":="), fix(1, "many", "MULTI_FILE", 1), fix(1, "odd", "MOVE", 1),
        fix(1, "none", None, 1), fix(1, "noline", "DELETE", None), fix(1, "nofind", "REPLACE", 1, None, "x"), fix(1, "empty", "INSERT", 1, content=""),
        fix(2, "lone", "DELETE", 1), fix(1, "ask", "REPLACE", 4, "4", "four", confirm=True), fix(1, "asked", "REPLACE", 4, "d", "D", confirm=True),
    ]
    texts, status = applied(spark, [(1, text), (3, "untouched")], fixes, [(1, "asked"), (2, "ask"), (1, "unknown")])
    assert texts == [("1", "a := one;\n// up\nb = 2;\n// down\n// stays\nD = 4;", 7), ("3", "untouched", 0)]
    assert {k[1]: v for k, v in status.items()} == {
        "r": "applied", "no": "unchanged", "same": "unchanged", "i1": "applied", "i2": "applied", "d": "applied", "lost": "overridden",
        "i3": "applied", "far": "out_of_range", "zero": "applied", "many": "refused", "odd": "refused", "none": "refused", "noline": "incomplete",
        "nofind": "incomplete", "empty": "incomplete", "lone": "no_text", "ask": "not_approved", "asked": "applied",
    }


@pytest.mark.parametrize("line,find,kind,replace,want", [
    ("a.b.c", ".", "literal", "-", "a-b.c"),
    ("f(x) f(x)", "f(x)", "literal", "[$&|$`|$'|$$|$1]", "[f(x)|| f(x)|$|$1] f(x)"),
    ("price: $5 +*?", "$5 +*?", "literal", "free", "price: free"),
    ("foo bar", r"(\w+) (\w+)", "regex", "$2 $1 $3 $0", "bar foo $3 $0"),
    ("aaa", "a", "regex", "", "aa"),
    ("x", "y*", "regex", "-", "-x"),
    ("😀 é key=1", r"(k\w+)=", "regex", "$`|$1", "😀 é 😀 é |key1"),
    ("ab", r"(x)?b", "regex", "[$1]", "a[]"),
    ("A(b)", r"\((?:b)\)", "regex", "$1", "A$1"),
    ("KEY", "(?i)key", "regex", "k", "k"),
    ("it's", "'", "literal", '"', 'it"s'),
    ("a$", r"[$(]", "regex", "$$$", "a$$"),
])
def test_replacements_are_javascript_s(spark, line, find, kind, replace, want):
    got, status = applied(spark, [(1, line)], [fix(1, "x", "REPLACE", 1, find, replace, kind)])
    assert got[0][1] == want and status == {(1, "x"): "applied"}


def test_no_fixes_nulls_and_equal_rows(spark):
    texts = [(1, None), (2, ""), (None, "a\nb"), (4, "a"), (4, "b\nc")]
    assert applied(spark, texts, [])[0] == sorted((str(k), t, 0) for k, t in texts)
    fixes = [fix(1, "d", "DELETE", 1), fix(2, "i", "INSERT", 1, content="new"), fix(None, "d", "DELETE", 2), fix(4, "d", "DELETE", 2),
             fix(4, "d", "DELETE", 2), fix(4, "r", "REPLACE", 1, "b", "B"), fix(4, None, "REPLACE", 1, "a", "A")]
    got, status = applied(spark, texts, fixes)
    assert got == sorted([("1", "", 1), ("2", "\nnew", 1), ("None", "a", 1), ("4", "A", 1), ("4", "B", 2)])
    assert applied(spark, [], fixes)[1] == dict.fromkeys(status, "no_text")


def test_columns_pass_and_may_be_few(spark):
    t = spark.createDataFrame([(1, 2, "x\ny", "z")], "a long, b long, body string, `odd.name` string")
    f = spark.createDataFrame([(1, 2, "k", "DELETE", 1)], "a long, b long, fix_id string, fix_type string, line int")
    done = ft.apply_fixes(t, f, "body", ["a", "b"])
    assert done.texts.columns == ["a", "b", "body", "odd.name", "code_fixed", "n_applied"]
    assert [tuple(r) for r in done.texts.collect()] == [(1, 2, "x\ny", "z", "y", 1)]


def test_many_fixes_against_a_plain_loop(spark):
    rng = random.Random(3)
    texts = [(i, "\n".join(rng.choice(["ab", "b(c)", "", "a=b", "cc"]) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    fixes, plain = [], {i: t.split("\n") for i, t in texts}
    for n in range(900):
        i, line = (0 if n % 3 == 0 else rng.randrange(40)), rng.randrange(0, 33)
        kind = rng.choice(["REPLACE", "REPLACE", "DELETE", "INSERT"]) if rng.random() < 0.7 else "REPLACE"
        if kind == "REPLACE":
            fixes.append(fix(i, f"f{n:04}", kind, line, rng.choice("abc="), rng.choice(["x", "ca", "$&$&"]), seq=rng.randrange(5)))
        else:
            fixes.append(fix(i, f"f{n:04}", kind, line, at=rng.choice(["ABOVE", "BELOW", None]), content=f"new{n}", seq=rng.randrange(5)))
    want = {}
    for i, lines in plain.items():
        out = []
        for at, text in enumerate(lines, 1):
            here = sorted((f for f in fixes if f[0] == i and max(1, f[3]) == at), key=lambda f: (f[10], f[1]))
            for f in here:
                if f[2] == "REPLACE":
                    text = text.replace(f[4], f[6].replace("$&", f[4]), 1)
            out += [f[8] for f in here if f[2] == "INSERT" and f[7] == "ABOVE"]
            out += [] if any(f[2] == "DELETE" for f in here) else [text]
            out += [f[8] for f in here if f[2] == "INSERT" and f[7] != "ABOVE"]
        want[str(i)] = "\n".join(out)
    got, status = applied(spark, texts, fixes)
    assert {k: t for k, t, _ in got} == want and len(status) == 900


def test_some_of_a_text_s_fixes_approved(spark):
    code = 'const token = "abcdefgh12345678";\nconsole.log(1);\nconst password = "Winter2024!";\nlogger.info(x);'
    df = code_df(spark, code, code)
    ok = spark.createDataFrame([(1, "fix-GENERIC_SECRET-1"), (2, "fix-PASSWORD-3"), (2, "fix-PASSWORD-99"), (2, "anything"), (2, None)], "file long, fix_id string")
    got = {r.file: r.code_fixed.split("\n") for r in fx.fixed_texts(df, approved=ok).collect()}
    assert got[1] == ["const token = process.env.GENERIC_SECRET;", 'const password = "Winter2024!";', "logger.info(x);"]
    assert got[2] == ['const token = "abcdefgh12345678";', "const password = process.env.PASSWORD;", "logger.info(x);"]
    none = fx.fixed_texts(df, approved=ok.limit(0)).orderBy("file").collect()
    assert none == fx.fixed_texts(df).orderBy("file").collect()


def test_planned_fixes_go_through_the_table_too(spark):
    code = 'const cfg = { debug: true };\nconst token = "abcdefgh12345678"; // TODO: x\ntry { a(); } catch (e) { }\nconsole.log(1);'
    df = code_df(spark, code)
    plan = fx.plan_fixes(df)
    done = ft.apply_fixes(df, plan, approved=plan.select("file", "fix_id"))
    assert [r.code_fixed for r in done.texts.collect()] == [r.code_fixed for r in fx.fixed_texts(df, approve_all=True).collect()]
    assert {r.status for r in done.statuses.collect()} == {"applied"}


def test_number_of_groups(spark):
    cases = {r"(a)(b)": 2, r"\(a\)": 0, r"[(](x)": 1, r"(?:a)(?<n>b)(?<!c)(?=d)": 1, r"\\(a)": 1, r"\Q(\E(a)": 1, "": 0}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, n int")
    assert [r for r in df.select("p", "n", ft.n_groups(F.col("p")).alias("got")).collect() if r.n != r.got] == []
    assert all(re.compile(k.replace("?<n>", "?P<n>").replace(r"\Q(\E", r"\(")).groups == v for k, v in cases.items())


def test_edits_are_made_once(spark):
    """The optimizer does not make every edit a second time to see whether there are any."""
    texts = spark.createDataFrame([(1, "a(b)")], "file long, code string")
    fixes = spark.createDataFrame([(1, "f", "REPLACE", 1, "(", "literal", "[$&")], "file long, fix_id string, fix_type string, line int, find string, find_kind string, replace string")
    statuses = ft.apply_fixes(texts, fixes).statuses
    assert [r.status for r in statuses.collect()] == ["applied"]
    plan = statuses._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_fixes_and_texts_are_shuffled_once(spark):
    """Texts that lie by ids stay where they are, and fixes that met the approvals meet line counts and texts without a further shuffle."""
    texts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "file long, code string")
    texts = texts.repartition(8, "file").groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("code")), "\n").alias("code"))
    fixes = spark.createDataFrame([fix(1, "x", "DELETE", 2), fix(2, "y", "REPLACE", 1, "c", "C", confirm=True), fix(None, "z", "DELETE", 2)], SCHEMA)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = ft.apply_fixes(texts, fixes, approved=fixes.select("file", "fix_id"))
        for out in done:
            plan = out._jdf.queryExecution().executedPlan().toString()
            # Spark's own shuffles are there for the texts and edits with a null among their ids, and for no others
            own = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE_REQUIREMENTS", plan)
            assert len(own) == 2 and all("isnull(file" in x for x in own), own
        assert {(r.file, r.fix_id): r.status for r in done.statuses.collect()} == {(1, "x"): "applied", (2, "y"): "applied", (None, "z"): "out_of_range"}
        assert {(r.file, r.code_fixed) for r in done.texts.collect()} == {(1, "a"), (2, "C"), (None, "d")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_ids_of_several_columns_some_null(spark):
    """Ids and fix_ids that are null, and an approval or a text alone, are told apart; the ids keep the fixes' type."""
    t = spark.createDataFrame([(1, "u", "a\nb"), (1, None, "a"), (None, None, "a"), (None, None, "a\nb"), (3, "u", "a")], "a int, b string, code string")
    rows = [
        (1, "u", None, "DELETE", 2, True), (1, None, None, "DELETE", 2, None), (None, None, "d", "DELETE", 2, True), (None, None, None, "DELETE", 1, True),
        (2, None, "d", "DELETE", 1, None), (1, "u", "d", "DELETE", 1, True), (1, None, "d", "MOVE", 1, None), (None, "u", "d", "DELETE", 1, None),
    ]
    f = spark.createDataFrame(rows, "a int, b string, fix_id string, fix_type string, line int, requires_confirmation boolean")
    ok = spark.createDataFrame([(1, "u", None), (None, None, "d"), (None, None, "d"), (9, None, "d"), (3, "u", None)], "a long, b string, fix_id string")
    done = ft.apply_fixes(t, f, id_cols=["a", "b"], approved=ok)
    assert dict(done.statuses.dtypes)["a"] == "int"
    assert {(r.a, r.b, r.fix_id): r.status for r in done.statuses.collect()} == {
        (1, "u", None): "applied", (1, None, None): "out_of_range", (None, None, "d"): "applied", (None, None, None): "not_approved",
        (2, None, "d"): "no_text", (1, "u", "d"): "not_approved", (1, None, "d"): "refused", (None, "u", "d"): "no_text",
    }
    got = sorted((str(r.a), str(r.b), r.code, r.code_fixed, r.n_applied) for r in done.texts.collect())
    assert got == sorted([("1", "u", "a\nb", "a", 1), ("1", "None", "a", "a", 0), ("None", "None", "a", "a", 0), ("None", "None", "a\nb", "a", 1), ("3", "u", "a", "a", 0)])
