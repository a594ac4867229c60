"""Relationships, fix order (Kahn, FIFO, cycle fallback), knowledge lookups."""

from pyspark.sql import functions as F

from codesift.operators import knowledge as kn
from codesift.operators import relations as rel


def ids_df(spark, scopes):
    rows = [(s, rid, i + 1) for s, ids in scopes.items() for i, rid in enumerate(ids)]
    return spark.createDataFrame(rows, "file long, rule_id string, pos int")


def order(spark, scopes, edges=None):
    out = rel.fix_order(ids_df(spark, scopes), ["file"], edges).collect()
    res = {}
    for r in sorted(out, key=lambda r: (r.file, r.rank)):
        res.setdefault(r.file, []).append(r.rule_id)
    return res


def kahn(ids, edges):
    """Plain reference implementation used to check the Spark plan."""
    ids = list(ids)
    present = set(ids)
    indeg = {i: 0 for i in ids}
    adj = {i: [] for i in ids}
    for f, t, typ, *_ in edges:
        if typ in ("BLOCKS", "DEPENDS_ON"):
            b, a = f, t
        elif typ == "CAUSED_BY":
            b, a = t, f
        else:
            continue
        if b in present and a in present:
            adj[b].append(a)
            indeg[a] += 1
    q = [i for i in ids if indeg[i] == 0]
    out = []
    while q:
        n = q.pop(0)
        out.append(n)
        for m in adj[n]:
            indeg[m] -= 1
            if indeg[m] == 0:
                q.append(m)
    return out if len(out) == len(ids) else ids


def test_shipped_order(spark):
    scopes = {1: ["N_PLUS_ONE", "CONSOLE_LOG", "SEQUENTIAL_ASYNC"],
              2: ["SQL_INJECTION", "EVAL_USAGE", "NO_INPUT_VALIDATION"],
              3: ["CONSOLE_LOG"]}
    got = order(spark, scopes)
    for s, ids in scopes.items():
        assert got[s] == kahn(ids, rel.EDGES)
    assert got[1] == ["CONSOLE_LOG", "SEQUENTIAL_ASYNC", "N_PLUS_ONE"]


def test_deeper_graph_and_cycle(spark):
    edges = [("A", "B", "BLOCKS", 1, ""), ("B", "C", "BLOCKS", 1, ""), ("D", "C", "DEPENDS_ON", 1, ""),
             ("X", "Y", "BLOCKS", 1, ""), ("Y", "X", "BLOCKS", 1, "")]
    scopes = {1: ["C", "B", "A", "D", "E"], 2: ["Y", "Q", "X"], 3: ["A", "C"]}
    got = order(spark, scopes, edges)
    for s, ids in scopes.items():
        assert got[s] == kahn(ids, edges), s
    assert got[2] == ["Y", "Q", "X"]  # cycle: input order


def test_relationships_in_scope_and_report(spark):
    ids = ids_df(spark, {1: ["SEQUENTIAL_ASYNC", "N_PLUS_ONE", "EVAL_USAGE"]})
    r = rel.relationships_in_scope(ids, ["file"]).collect()
    assert {(x.from_id, x.to_id) for x in r} == {("SEQUENTIAL_ASYNC", "N_PLUS_ONE"), ("N_PLUS_ONE", "SEQUENTIAL_ASYNC")}
    rep = rel.order_report(ids, ["file"]).collect()[0].report
    assert "1. **SEQUENTIAL_ASYNC**" in rep and "   - SEQUENTIAL_ASYNC blocks N_PLUS_ONE:" in rep
    assert rep.endswith("_3 issue(s) analysed._")


def test_explanation_lookup_is_case_insensitive(spark):
    f = spark.createDataFrame([("sql_injection",), ("API_KEY",), ("NOPE",)], "rule_id string")
    got = {r.rule_id: r.explanation is not None for r in kn.with_explanation(f).collect()}
    assert got == {"sql_injection": True, "API_KEY": False, "NOPE": False}


def test_guide_context_effects(spark):
    f = spark.createDataFrame([("N_PLUS_ONE", 1000, True), ("CONSOLE_LOG", None, True), ("sql_injection", None, False)],
                              "rule_id string, it int, t boolean")
    rows = {r.rule_id: r for r in kn.with_guide(f, iterations=F.col("it"), in_test=F.col("t")).collect()}
    assert abs(rows["N_PLUS_ONE"].gain_ms - 450.0) < 1e-9
    assert rows["N_PLUS_ONE"].fix_minutes == 8 and rows["CONSOLE_LOG"].fix_minutes == 1
    assert rows["sql_injection"].guide is None  # guides are case-sensitive


def test_guide_ids_by_domain(spark):
    assert len(kn.guides(spark).collect()) == 20
    dev = [r.rule_id for r in kn.guide_ids_for_domain(spark, "DevOps").orderBy("guide_pos").collect()]
    assert dev == ["UNHANDLED_PROMISE", "MISSING_TIMEOUT", "HARDCODED_IP", "SENSITIVE_DATA_LOG"]
    assert kn.guide_ids_for_domain(spark, "Nope").count() == 0


def test_shallow_window_path_equals_reference(spark):
    import random

    rng = random.Random(5)
    vocab = ["SEQUENTIAL_ASYNC", "N_PLUS_ONE", "SQL_INJECTION", "NO_INPUT_VALIDATION", "EVAL_USAGE", "CONSOLE_LOG",
             "A", "B"]
    edges = rel.EDGES + [("A", "N_PLUS_ONE", "DEPENDS_ON", 1, ""), ("B", "SQL_INJECTION", "BLOCKS", 1, "")]
    assert rel._shallow(edges) is not None
    scopes = {i: rng.sample(vocab, rng.randint(1, len(vocab))) for i in range(200)}
    got = order(spark, scopes, edges)
    for sc, ids in scopes.items():
        assert got[sc] == kahn(ids, edges), (ids, got[sc])


def test_order_report_deep_graph_path(spark):
    edges = [("A", "B", "BLOCKS", 1, "a first"), ("B", "C", "BLOCKS", 1, "b first"), ("C", "Z", "RELATED_TO", 2, "z")]
    assert rel._shallow(edges) is None
    rep = rel.order_report(ids_df(spark, {1: ["C", "Z", "B", "A"]}), ["file"], edges).collect()[0].report
    assert "1. **Z**\n2. **A**\n   - A blocks B: a first\n3. **B**\n   - B blocks C: b first\n4. **C**" in rep
    assert rep.endswith("_4 issue(s) analysed._")
