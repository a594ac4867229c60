"""File-tree source (S1), streaming scan (S10) equals batch, oracle spot check."""

import os

import duckdb

from codesift.operators.scan import scan
from codesift.session import TABLES
from codesift.sources import files
from codesift.sources.files import read_source_tree
from codesift.streaming.scan_stream import start_findings_stream, stream_findings

SF = "/root/testdata/sf0.001"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_source_tree(spark, scratch):
    root = os.path.join(scratch, "src")
    _write(f"{root}/a.js", "eval(x);\nconsole.log(1);")
    _write(f"{root}/lib/b.ts", "let y = 1;")
    _write(f"{root}/lib/c.d.ts", "declare const z: number;")
    _write(f"{root}/node_modules/dep/index.js", "eval(dep);")
    _write(f"{root}/.git/hook.js", "eval(git);")
    _write(f"{root}/__tests__/t.test.js", "it('x', () => {});")
    _write(f"{root}/readme.md", "eval(doc)")
    _write(f"{root}/_private.js", "eval(p);")
    _write(f"{root}/lib/.hidden.ts", "eval(h);")
    _write(f"{root}/lib/.js", "eval(j);")
    _write(f"{root}/node_modules/_x.js", "eval(n);")
    rows = read_source_tree(spark, root).collect()
    assert sorted(r.file for r in rows) == ["__tests__/t.test.js", "_private.js", "a.js", "lib/.hidden.ts", "lib/.js", "lib/b.ts", "lib/c.d.ts"]
    assert {r.code for r in rows if r.file.endswith("_private.js")} == {"eval(p);"}
    assert read_source_tree(spark, os.path.join(scratch, "missing")).count() == 0


def test_source_tree_names_come_back_decoded(spark, scratch):
    root = os.path.join(scratch, "a root%20 é")
    names = ["my dir/a b.js", "p%2520q.js", "50%/x%.ts", "ñandú/漢字.tsx", "_h/.i/../k.js", "a#b?.js", "it's \"quoted\".jsx", "new\nline.js", "+&=.ts", "deep/" * 12 + "end.js"]
    for n in names:
        _write(f"{root}/{n}", f"// {n}")
    _write(f"{root}/x.JS", "wrong case")
    _write(f"{root}/js", "no ending")
    os.makedirs(f"{root}/folder.js")
    os.symlink(f"{root}/my dir", f"{root}/linked")
    os.symlink(f"{root}/p%2520q.js", f"{root}/link.js")
    os.symlink(root, f"{root}/my dir/loop")
    with open(os.fsencode(root) + b"/bad\xff.js", "wb") as fh:
        fh.write(b"// \xfe")
    want = {os.path.normpath(n): f"// {n}" for n in names} | {"bad\ufffd.js": "// \ufffd"}
    for given in (root, root + "/", "file://" + root, "file:" + root):
        assert {r.file: r.code for r in read_source_tree(spark, given).collect()} == want


def test_source_tree_lists_and_reads_in_tasks(spark, scratch, monkeypatch):
    root = os.path.join(scratch, "wide")
    for d in range(30):
        for f in range(12):
            _write(f"{root}/d{d}/e{f % 3}/f{f}.js", "x" * (1 + d))
    _write(f"{root}/empty/none.txt", "")
    plain = os.scandir

    def on_the_driver(path="."):
        assert not os.fsdecode(path).startswith(root)
        return plain(path)

    monkeypatch.setattr(os, "scandir", on_the_driver)  # tasks run in processes of their own
    monkeypatch.setattr(files, "READ_BYTES", 1000)
    got = read_source_tree(spark, root)
    assert got.rdd.getNumPartitions() == 6
    assert {r.file: len(r.code) for r in got.collect()} == {f"d{d}/e{f % 3}/f{f}.js": 1 + d for d in range(30) for f in range(12)}


def test_stream_equals_batch(spark, scratch):
    src = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    inbox = os.path.join(scratch, "inbox")
    src.repartition(3).write.parquet(inbox)
    s = stream_findings(spark, inbox, src.schema, "text", ["doc_id"], max_files_per_trigger=1)
    q = start_findings_stream(s, os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"), trigger_once=True)
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(scratch, "out"))
    batch = scan(src, "text", ["doc_id"])
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_oracle_spot_check(spark):
    import __spark_entry__ as E

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sqls = E.oracle_sql()
    for name in ["scan_full", "scan_in_context", "fix_plan", "order_report_per_file"]:
        df = E.queries()[name](spark, SF)
        cols = sorted(df.columns)
        a = sorted(tuple(r[c] for c in cols) for r in df.collect())
        rel = con.sql(sqls[name])
        idx = [rel.columns.index(c) for c in cols]
        b = sorted(tuple(r[i] for i in idx) for r in rel.fetchall())
        assert a == b, name


def test_entry_smoke(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0


def test_scan_tree(spark, scratch):
    from codesift.plans.tree_scan import scan_tree

    root = os.path.join(scratch, "proj")
    _write(f"{root}/a.js", "eval(x);\nconsole.log(1);")
    _write(f"{root}/b.ts", "let count = 1;")
    findings, body, extra, gate = scan_tree(spark, root, "text", "high")
    assert [r.rule_id for r in findings.collect()] == ["EVAL_USAGE"]
    assert gate.collect()[0].exit_code == 1
    assert extra.collect()[0].footer == "\nTotal: 1 issue(s) in 1 file(s)."
    assert "[CRITICAL] L1: EVAL_USAGE" in body.collect()[0].block
    _, _, _, gate_low = scan_tree(spark, root, "markdown", "bogus")
    assert gate_low.collect()[0].exit_code == 0
