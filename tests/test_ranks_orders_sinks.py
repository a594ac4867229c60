"""Ranks in hot groups (A1), orders over tables of edges (G1-G6) and report files."""

import json
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codesift.operators import knowledge, relations, reports, sinks
from codesift.operators.ranking import rank_in_groups
from codesift.operators.scan import scan
from conftest import code_df


def test_ranks_are_window_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, id int")
    got = rank_in_groups(df, ["g"], ["k", "id"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted(r[1:] for r in rows if r[0] == g), 1):
            want[r[1]] = n
    assert {r.id: r["rank"] for r in got} == want and len(got) == 3000
    assert [r.n for r in rank_in_groups(df, [], [F.col("k").desc(), "id"], "n").orderBy(F.desc("k"), "id").collect()] == list(range(1, 3001))
    assert rank_in_groups(df.limit(0), ["g"], ["k"]).count() == 0
    same = spark.createDataFrame([("x", 1)] * 500, "g string, k int")
    assert sorted(r["rank"] for r in rank_in_groups(same, ["g"], ["k"]).collect()) == list(range(1, 501))


def test_members_of_severity_groups(spark):
    f = scan(code_df(spark, "eval(a)\nconsole.log(b)", "console.log(1)\nconsole.log(2)", "fine"))
    got = [(r.severity, r["rank"], r.file, r.line) for r in reports.severity_members(f).orderBy("group_order", "rank").collect()]
    assert got == [("critical", 1, 1, 1), ("low", 1, 1, 2), ("low", 2, 2, 1), ("low", 3, 2, 2)]


# ------------------------------------------------------------------ orders


def kahn(ids, edges):
    left, after = dict.fromkeys(ids, 0), {i: [] for i in ids}
    for f, t, kind, *_ in edges:
        a, b = (f, t) if kind in ("BLOCKS", "DEPENDS_ON") else (t, f)
        if kind in ("BLOCKS", "DEPENDS_ON", "CAUSED_BY") and a in left and b in left:
            after[a].append(b)
            left[b] += 1
    queue, out = deque(i for i in ids if not left[i]), []
    while queue:
        n = queue.popleft()
        out.append(n)
        for m in after[n]:
            left[m] -= 1
            if not left[m]:
                queue.append(m)
    return out if len(out) == len(ids) else list(ids)


def random_edges(rng, n, names, acyclic=True):
    out = []
    for _ in range(n):
        a, b = rng.randrange(len(names)), rng.randrange(len(names))
        if acyclic and a == b:
            continue
        a, b = (min(a, b), max(a, b)) if acyclic else (a, b)
        kind = rng.choice(["BLOCKS", "DEPENDS_ON", "CAUSED_BY", "RELATED_TO", "CAUSES"])
        a, b = (b, a) if kind == "CAUSED_BY" else (a, b)
        out.append((names[a], names[b], kind, 1, "why"))
    return out


def edge_table(spark, edges):
    return relations.edges(spark, edges)


def test_orders_of_many_scopes_are_kahn_s(spark):
    rng = random.Random(5)
    names = [f"R{i}" for i in range(30)]
    edges = random_edges(rng, 60, names) + [("R3", "R28", "BLOCKS", 1, ""), ("R28", "R2", "BLOCKS", 1, ""), ("R2", "R3", "BLOCKS", 1, ""), ("R9", "R9", "BLOCKS", 1, "")]
    scopes = {s: rng.sample(names, rng.randrange(0, 25)) for s in [*range(25), None]}
    ids = spark.createDataFrame([(s, r, p) for s, rs in scopes.items() for p, r in enumerate(rs, 1)], "s int, rule_id string, pos int")
    got = relations.fix_order(ids, ["s"], edge_table(spark, edges)).collect()
    for s, rs in scopes.items():
        assert [r.rule_id for r in sorted((r for r in got if r.s == s), key=lambda r: r["rank"])] == kahn(rs, edges), s
    rel = relations.relationships_in_scope(ids, ["s"], edge_table(spark, edges)).collect()
    want = sorted((str(s), e[0], e[1], i) for s, rs in scopes.items() for i, e in enumerate(edges) if e[0] in rs and e[1] in rs)
    assert sorted((str(r.s), r.from_id, r.to_id, r.edge_idx) for r in rel) == want


def test_one_scope_of_everything_with_100000_edges(spark):
    rng = random.Random(8)
    names = [f"N{i:05}" for i in range(60_000)]
    edges = random_edges(rng, 100_000, names)
    order = names[:]
    rng.shuffle(order)
    ids = spark.createDataFrame([(r, p) for p, r in enumerate(order, 1)], "rule_id string, pos int").repartition(8)
    table = edge_table(spark, edges).repartition(8)
    got = relations.fix_order(ids, [], table)
    assert [r.rule_id for r in sorted(got.collect(), key=lambda r: r["rank"])] == kahn(order, edges)
    assert relations.relationships_in_scope(ids, [], table).count() == len(edges)
    cyclic = edges + [(names[1], names[0], "BLOCKS", 1, ""), (names[0], names[1], "BLOCKS", 1, "")]
    back = relations.fix_order(ids, [], edge_table(spark, cyclic)).where("rank <> pos").count()
    assert back == 0


def test_distinct_ids_of_everything_are_ranked_without_a_window_over_all(spark):
    found = spark.range(100_000).select(F.concat(F.lit("R"), (F.col("id") % 20_000).cast("string")).alias("rule_id"), F.col("id").alias("rule_seq"), F.lit(1).alias("line"))
    ids = relations.scope_ids(found, [])
    assert ids.where("CAST(substring(rule_id, 2, 9) AS INT) + 1 <> pos").count() == 0 and ids.count() == 20_000
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "_k" not in "".join(line for line in plan.split("\n") if "Window" in line)


def test_order_report_as_rows_and_as_one_text(spark, scratch):
    ids = spark.createDataFrame([(1, "N_PLUS_ONE", 1), (1, "SEQUENTIAL_ASYNC", 2), (1, "EVAL_USAGE", 3), (2, "EVAL_USAGE", 1)], "file int, rule_id string, pos int")
    by_windows = {r.file: r.report for r in relations.order_report(ids, ["file"]).collect()}
    by_tables = {r.file: r.report for r in relations.order_report(ids, ["file"], relations.edges(spark)).collect()}
    assert by_windows == by_tables and "1. **SEQUENTIAL_ASYNC**\n   - SEQUENTIAL_ASYNC blocks N_PLUS_ONE" in by_windows[1]
    rows = relations.order_report_rows(ids, ["file"])
    sinks.write_lines(sinks.order_report_lines(rows, ["file"]), f"{scratch}/o")
    assert text_of(f"{scratch}/o") == by_windows[1] + "\n" + by_windows[2] + "\n"
    alone = ids.where("file = 1").drop("file")
    assert relations.order_report(alone, []).collect()[0].report == by_windows[1]
    none = relations.order_report_rows(alone.limit(0), [])
    assert sinks.order_report_lines(none, []).count() == 0


def test_callers_edges_are_not_broadcast_by_hint(spark):
    ids = spark.createDataFrame([("A",), ("B",)], "rule_id string")
    table = edge_table(spark, [("A", "B", "BLOCKS", 1, "")])
    plan = relations.relationships_from(ids, edge_df=table)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()


# ------------------------------------------------------------------ report files


def text_of(path):
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return "".join(open(os.path.join(path, p), encoding="utf-8").read() for p in parts)


@pytest.fixture(scope="module")
def findings(spark):
    rng = random.Random(2)
    lines = ["eval(x)", "console.log(1)", "fine", 'const password = "Winter2024!";', "// TODO y", "process.exit(1);"]
    return scan(code_df(spark, *("\n".join(rng.choices(lines, k=rng.randrange(0, 9))) for _ in range(60)))).persist()


def by_file(findings):
    out = {}
    for r in sorted(findings.collect(), key=lambda r: (r.file, r.rule_seq, r.line)):
        out.setdefault(r.file, []).append(r)
    return out


def test_text_and_markdown_files(spark, findings, scratch):
    files = by_file(findings)
    total = sum(map(len, files.values()))
    want = []
    for f, rs in files.items():
        want.append(f"\n=== {f} ({len(rs)} issue(s)) ===")
        want += [f"  [{r.severity.upper()}] L{r.line}: {r.rule_id} — {r.message}" for r in rs]
    want.append(f"\nTotal: {total} issue(s) in {len(files)} file(s).")
    sinks.write_report(findings.repartition(7), f"{scratch}/t")
    assert text_of(f"{scratch}/t") == "\n".join(want) + "\n"
    want = ["# Scan report", "", f"**{total} issue(s)** across **{len(files)} file(s)**", ""]
    for f, rs in files.items():
        want += [f"## `{f}`", *(f"- **[{r.severity.upper()}] L{r.line}** `{r.rule_id}` — {r.message}" for r in rs), ""]
    sinks.write_report(findings.repartition(7), f"{scratch}/m", "markdown")
    assert text_of(f"{scratch}/m") == "\n".join(want) + "\n"
    back = sinks.merged(spark, f"{scratch}/m").orderBy("n").collect()
    assert [r.text for r in back] == want and [r.n for r in back] == list(range(1, len(want) + 1))


def test_json_listing_and_domain_files(spark, findings, scratch):
    files = by_file(findings)
    sinks.write_report(findings.repartition(5), f"{scratch}/j", "json")
    got = json.loads(text_of(f"{scratch}/j"))
    assert [(d["file"], [(i["id"], i["line"]) for i in d["issues"]]) for d in got] == [(f, [(r.rule_id, r.line) for r in rs]) for f, rs in files.items()]
    assert got[0]["issues"][0]["explanation"]["steps"]
    sinks.write_report(findings, f"{scratch}/l", "listing")
    flat = [r for rs in files.values() for r in rs]
    lines = text_of(f"{scratch}/l").split("\n")
    assert [x for x in lines if x.startswith("[")] == [f"[{r.domain}][{r.severity.upper()}] L{r.line}: {r.message} ({r.rule_id})" for r in flat]
    assert lines[-3:] == ["", f"Total: {len(flat)} issue(s).", ""]
    sinks.write_report(findings, f"{scratch}/d", "domain")
    text = text_of(f"{scratch}/d")
    heads = [x for x in text.split("\n") if x.startswith("---")]
    first = {}
    for r in sorted(flat, key=lambda r: r.rule_seq):
        first[r.domain] = first.get(r.domain, 0) + 1
    assert heads == [f"--- {d} ({n}) ---" for d, n in first.items()]


def test_empty_and_odd_reports(spark, findings, scratch):
    none = findings.limit(0)
    for fmt, want in (("text", "No issues found.\n"), ("listing", "No issues detected.\n"), ("json", "[\n]\n")):
        sinks.write_report(none, f"{scratch}/{fmt}", fmt)
        assert text_of(f"{scratch}/{fmt}") == want
    with pytest.raises(ValueError):
        sinks.report_lines(findings, "pdf")
    two = findings.where("file < 4").withColumn("repo", F.when(F.col("file") > 1, "r"))
    sinks.write_report(two, f"{scratch}/two", "json", ["repo", "file"])
    assert [(d.get("repo"), d["file"]) for d in json.loads(text_of(f"{scratch}/two"))] == sorted(
        {(r.repo, r.file) for r in two.collect()}, key=lambda x: (x[0] is not None, x))


# ------------------------------------------------------------------ issue sheets


def test_whole_issue_sheets(spark):
    rows = [(1, "SQL_INJECTION", "critical", "msg", 3, "Security"), (2, "API_KEY", "critical", "key", 1, "Security"), (3, "XSS", "high", "x", 2, "Security"),
            (4, "unheard-of", "low", "odd", 9, "Quality"), (5, "sql_injection", "low", "lower", 1, "Security")]
    got = {r.file: r for r in knowledge.issue_sheet(spark.createDataFrame(rows, "file int, rule_id string, severity string, message string, line int, domain string")).collect()}
    assert [got[i].sheet_source for i in range(1, 6)] == ["explanation", "guide", "guide", "none", "explanation"]
    e = next(x for x in knowledge.EXPLANATIONS if x["rule_id"] == "SQL_INJECTION")
    sheet = got[1].sheet
    parts = [e["what"], e["why"], *e["risks"], e["example"]["bad"], e["example"]["good"], *(s["title"] for s in e["steps"]), *(s["description"] for s in e["steps"]),
             *(s["example"] for s in e["steps"] if s["example"]), e["standard"]["name"], e["standard"]["cwe_name"], e["standard"]["url"],
             *(f"{r['name']}: {r['url']}" for r in e["refs"]), e["example"]["docs_url"], "HOW TO FIX (2 steps)", "  [CRITICAL]  SQL_INJECTION, line 3, Security"]
    assert [p for p in parts if p not in sheet] == []
    assert "Env var needed: API_KEY" in got[2].sheet and "    const api_key = process.env.API_KEY;\n    call(api_key);" in got[2].sheet
    assert "  1. Prefer textContent\n  2. Sanitise" in got[3].sheet and "Related: DANGEROUS_HTML, NO_INPUT_VALIDATION" in got[3].sheet
    assert 'No guide for "unheard-of".' in got[4].sheet


def test_gains_in_sheets(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "EXPLANATIONS", [])
    rows = [(i, r, "low", "m", 1, "Scalability") for i, r in enumerate(["N_PLUS_ONE", "SEQUENTIAL_ASYNC", "TODO_FIXME"])]
    got = [r.sheet for r in knowledge.issue_sheet(spark.createDataFrame(rows, "file int, rule_id string, severity string, message string, line int, domain string")).orderBy("file").collect()]
    assert "Performance gain: ~0.45ms" in got[0] and "Performance gain: ~200ms" in got[1] and "gain" not in got[2] and "Related" not in got[2]


def test_reading_a_report_back_moves_no_lines(spark, findings, scratch):
    sinks.write_report(findings.repartition(5), f"{scratch}/d", "domain")
    lines = [x for f in sorted(os.listdir(f"{scratch}/d")) if f.endswith(".txt")
             for x in open(f"{scratch}/d/{f}", encoding="utf-8").read().split("\n")[:-1]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")  # files are cut in the middle of their lines
    try:
        back = sinks.merged(spark, f"{scratch}/d")
        got = back.orderBy("n").collect()
        plan = back._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.n, r.text) for r in got] == list(enumerate(lines, 1))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
