"""Files that arrive again."""

import os

import pytest

from codesift.operators.scan import scan
from codesift.streaming import rescan

SCHEMA = "file string, code string, arrived long"


class Inbox:
    def __init__(self, spark, at):
        self.spark, self.at = spark, at
        self.store, self.n = f"{at}/store", 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.at}/inbox")

    def run(self, **args):
        texts = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/inbox")
        q = rescan.start_rescan_stream(texts, self.store, f"{self.at}/ckpt", trigger_once=True, **args)
        q.awaitTermination(300)
        assert q.exception() is None
        return self.now()

    def now(self, store=None):
        types = self.spark.createDataFrame([], SCHEMA)
        rows = rescan.current_findings(self.spark, store or self.store, types).collect()
        return sorted(((r.file, r.rule_id, r.line) for r in rows), key=str)


@pytest.fixture()
def inbox(spark, scratch):
    return Inbox(spark, scratch)


def test_new_content_replaces_old_findings_after_a_restart(inbox):
    inbox.put(("a", "eval(x)\neval(y)", 1), ("b", "eval(z)", 1), ("c", "fine", 1))
    assert inbox.run() == [("a", "EVAL_USAGE", 1), ("a", "EVAL_USAGE", 2), ("b", "EVAL_USAGE", 1)]
    inbox.put(("a", "ok\nconsole.log(1)", 2), ("c", "eval(c)", 2))
    assert inbox.run() == [("a", "CONSOLE_LOG", 2), ("b", "EVAL_USAGE", 1), ("c", "EVAL_USAGE", 1)]
    inbox.put(("a", "clean", 3), ("b", None, 3))
    assert inbox.run() == [("c", "EVAL_USAGE", 1)]
    inbox.put(("b", "eval(again)", 4))
    assert inbox.run() == [("b", "EVAL_USAGE", 1), ("c", "EVAL_USAGE", 1)]


def test_the_last_of_one_batch_counts_and_same_content_is_not_scanned(inbox, spark):
    inbox.put(("a", "eval(1)", 5), ("a", "console.log(1)", 7), ("a", None, 6), (None, "eval(n)", 1), ("gone", None, 1))
    first = inbox.run()
    assert first == [("a", "CONSOLE_LOG", 1), (None, "EVAL_USAGE", 1)]
    inbox.put(("a", "console.log(1)", 8), (None, "eval(n)", 2))
    assert inbox.run() == first
    batches = sorted(d for d in os.listdir(f"{inbox.store}/files") if d.startswith("batch="))
    rows = {d: spark.read.parquet(f"{inbox.store}/files/{d}").count() for d in batches}
    assert rows == {"batch=-1": 0, "batch=0": 2, "batch=1": 0}


def test_a_batch_that_runs_again_writes_the_same(inbox, spark):
    inbox.put(("a", "eval(1)", 1))
    inbox.run()
    inbox.put(("a", "console.log(1)", 2), ("b", "eval(2)", 2))
    want = inbox.run()
    rows = spark.createDataFrame([("a", "console.log(1)", 2), ("b", "eval(2)", 2)], SCHEMA)
    rescan.rescan_batch(inbox.store, "code", ["file"], "arrived")(rows, 1)
    assert inbox.now() == want


def test_compacted_store_goes_on(inbox, spark, scratch):
    inbox.put(("a", "eval(1)", 1), ("b", "eval(1)", 1), ("c", "eval(1)", 1))
    inbox.put(("b", "console.log(1)", 2), ("c", None, 2))
    want = inbox.run()
    other = Inbox(spark, os.path.join(scratch, "next"))
    rescan.compact(spark, inbox.store, other.store, spark.createDataFrame([], SCHEMA))
    assert other.now() == want == [("a", "EVAL_USAGE", 1), ("b", "CONSOLE_LOG", 1)]
    other.put(("a", "eval(1)", 3), ("b", "eval(1)\neval(2)", 3))
    assert other.run() == [("a", "EVAL_USAGE", 1), ("b", "EVAL_USAGE", 1), ("b", "EVAL_USAGE", 2)]


def test_many_files_end_as_a_scan_of_their_last_texts(inbox, spark):
    texts = ["eval(x)", "console.log(1)\n// TODO y", "", 'const password = "Winter2024!";', "fine"]
    last = {}
    for n in range(4):
        rows = [(f"f{i}", texts[(i * (n + 1)) % 5], n) for i in range(60) if (i + n) % 3]
        last.update({f: c for f, c, _ in rows})
        inbox.put(*rows)
    got = inbox.run(min_severity="low")
    df = spark.createDataFrame(list(last.items()), "file string, code string")
    assert got == sorted((r.file, r.rule_id, r.line) for r in scan(df).collect())
