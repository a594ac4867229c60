"""Relationships between rule ids and the fix order.

Scope is a set of columns (a file, a repository, or nothing = whole corpus).
The shipped edge table is small and fixed-size, so it is broadcast. A caller's
edges may be a DataFrame of any size (columns as in EDGE_SCHEMA): they are
joined without a hint, so Spark broadcasts them only if they are small.
With the shipped edges and a given scope, windows over the scope do the work
(a scope holds at most the rule vocabulary); without a scope, or with a
DataFrame of edges, it is done by joins and by ranks over sorted partitions, so
no task holds a whole scope.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, stored
from .ranking import rank_in_groups

# ---------------------------------------------------------------------------
# Edges (from, to, type, priority) in table order; the reasons
# are our own wording. Verbs per type for the edge sentence.
# ---------------------------------------------------------------------------
EDGES = [
    ("SEQUENTIAL_ASYNC", "N_PLUS_ONE", "BLOCKS", 1, "fixing the serial awaits often removes the per-row queries"),
    ("N_PLUS_ONE", "SEQUENTIAL_ASYNC", "BLOCKED_BY", 2, "batching waits on the loop being made concurrent"),
    ("SQL_INJECTION", "NO_INPUT_VALIDATION", "CAUSED_BY", 1, "unchecked input is what reaches the query"),
    ("NO_INPUT_VALIDATION", "SQL_INJECTION", "CAUSES", 1, "unchecked input makes the injection possible"),
    ("XSS", "DANGEROUS_HTML", "RELATED_TO", 3, "both render unsafe markup"),
    ("DANGEROUS_HTML", "XSS", "RELATED_TO", 3, "raw HTML rendering is an XSS path"),
    ("CORS_ALL_ORIGINS", "COOKIE_INSECURE", "RELATED_TO", 2, "open CORS plus weak cookies widen exposure"),
    ("COOKIE_INSECURE", "CORS_ALL_ORIGINS", "RELATED_TO", 2, "weak cookies matter most with open CORS"),
    ("OPEN_REDIRECT", "SSRF", "RELATED_TO", 2, "both trust a caller-chosen URL"),
    ("EMPTY_CATCH", "UNHANDLED_PROMISE", "RELATED_TO", 2, "both hide failures"),
    ("MISSING_TIMEOUT", "SYNC_FILE_IN_SERVER", "RELATED_TO", 2, "both stall the event loop"),
    ("NO_PAGINATION", "N_PLUS_ONE", "RELATED_TO", 2, "both make database work grow with the data"),
    ("NESTED_LOOP", "STRING_CONCAT_LOOP", "RELATED_TO", 3, "both are quadratic loops"),
    ("MAGIC_NUMBER", "POOR_NAMING", "RELATED_TO", 3, "both are naming problems"),
    ("DEBUG_ENABLED", "SENSITIVE_DATA_LOG", "CAUSES", 1, "debug mode turns on verbose logs"),
    ("SENSITIVE_DATA_LOG", "DEBUG_ENABLED", "BLOCKED_BY", 1, "leaks are worst while debug is on"),
    ("PROTOTYPE_POLLUTION", "NOSQL_INJECTION", "RELATED_TO", 2, "both trust object-shaped input"),
    ("PROCESS_EXIT", "UNHANDLED_PROMISE", "RELATED_TO", 2, "exit is often a stand-in for rejection handling"),
    ("TOO_MANY_PARAMS", "LONG_FUNCTION", "RELATED_TO", 3, "long functions gather parameters"),
    ("LONG_FUNCTION", "DEEP_NESTING", "RELATED_TO", 3, "long functions tend to nest deeply"),
]
VERBS = {"BLOCKS": "blocks", "BLOCKED_BY": "is blocked by", "DEPENDS_ON": "depends on",
         "RELATED_TO": "is related to", "CAUSES": "causes", "CAUSED_BY": "is caused by"}

EDGE_SCHEMA = T.StructType([
    T.StructField("from_id", T.StringType(), False), T.StructField("to_id", T.StringType(), False),
    T.StructField("rel_type", T.StringType(), False), T.StructField("priority", T.IntegerType()),
    T.StructField("reason", T.StringType()), T.StructField("edge_idx", T.IntegerType(), False),
])


def edges(spark: SparkSession, rows=None) -> DataFrame:
    rows = EDGES if rows is None else rows
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGE_SCHEMA)


def sentence(from_id, to_id, rel_type, reason):
    """`from verb to: reason`; unknown types are printed as they are."""
    verbs = F.create_map(*[x for k, v in VERBS.items() for x in (F.lit(k), F.lit(v))])
    return F.format_string("%s %s %s: %s", from_id, F.coalesce(verbs[rel_type], rel_type), to_id, reason)


def relationships_from(ids: DataFrame, id_col: str = "rule_id", edge_df: DataFrame | None = None) -> DataFrame:
    """G1: outgoing edges of each id (inner join; the shipped edges are broadcast)."""
    e = edge_df if edge_df is not None else F.broadcast(edges(ids.sparkSession))
    return ids.join(e, ids[id_col] == e["from_id"], "inner")


def scope_ids(findings: DataFrame, scope: Sequence[str], order_cols=("rule_seq", "line")) -> DataFrame:
    """Distinct ids per scope with their first-seen position (input order)."""
    key = F.struct(*[F.col(c) for c in order_cols])
    if not scope:  # one scope of everything: its distinct ids are ranked over sorted partitions
        first = stored(findings.groupBy("rule_id").agg(F.min(key).alias("_k")))  # ranges are sampled: the scan runs once
        return rank_in_groups(first, [], ["_k", "rule_id"], "pos").select("rule_id", F.col("pos").cast("int").alias("pos"))
    return (findings.groupBy(*scope, "rule_id").agg(F.min(key).alias("_k"))
            # rule_id breaks ties (external ids share rule_seq) so retries rank the same way
            .withColumn("pos", F.row_number().over(Window.partitionBy(*scope).orderBy("_k", "rule_id")))
            .drop("_k"))


def relationships_in_scope(ids: DataFrame, scope: Sequence[str], edge_df: DataFrame | None = None,
                           materialized: bool = False) -> DataFrame:
    """Edges whose both ends are among the scope's ids, in edge-table order.

    With the shipped edges and a scope, the scope's id set rides along on each
    row (a window over the scope; at most the rule vocabulary), so `ids` is read
    once. Otherwise two joins: the edges of each id, then those whose other end
    is an id of the scope too; `ids` is written to the shared folder for that.
    """
    s = list(scope)
    if s and edge_df is None:
        withset = ids.select(*s, F.col("rule_id").alias("from_id"), F.col("pos").alias("from_pos"),
                             F.collect_set("rule_id").over(Window.partitionBy(*s)).alias("_present"))
        out = withset.join(F.broadcast(edges(ids.sparkSession)), "from_id")
        return out.filter(F.array_contains("_present", F.col("to_id"))).drop("_present")
    held = ids if materialized else stored(ids.select(*s, "rule_id", "pos"))
    e = edge_df if edge_df is not None else F.broadcast(edges(ids.sparkSession))
    out = held.select(*s, F.col("rule_id").alias("from_id"), F.col("pos").alias("from_pos")).join(e, "from_id")
    return out.alias("a").join(held.alias("b"), _in_scope(s, "to_id"), "left_semi")


def _in_scope(s: Sequence[str], id_col: str) -> Column:
    """Join condition: `a`'s id column is `b`'s rule id, in the same scope (a null scope is one of its own)."""
    out = F.col(f"a.{id_col}") == F.col("b.rule_id")
    for c in s:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def _ordering_edges(e: DataFrame) -> DataFrame:
    """BLOCKS/DEPENDS_ON give from->to, CAUSED_BY gives to->from; other types ignored."""
    return e.select(
        F.when(F.col("rel_type").isin("BLOCKS", "DEPENDS_ON"), F.col("from_id"))
        .when(F.col("rel_type") == "CAUSED_BY", F.col("to_id")).alias("before"),
        F.when(F.col("rel_type").isin("BLOCKS", "DEPENDS_ON"), F.col("to_id"))
        .when(F.col("rel_type") == "CAUSED_BY", F.col("from_id")).alias("after"),
        "edge_idx",
    ).filter(F.col("before").isNotNull())


def _rounds(rows) -> int:
    """Longest path in the (small, fixed) ordering graph; #nodes if it has a cycle."""
    succ: dict[str, list[str]] = {}
    for f, t, typ, *_ in rows:
        if typ in ("BLOCKS", "DEPENDS_ON"):
            succ.setdefault(f, []).append(t)
        elif typ == "CAUSED_BY":
            succ.setdefault(t, []).append(f)
    nodes = set(succ) | {t for v in succ.values() for t in v}
    waiting = {n: 0 for n in nodes}
    for targets in succ.values():
        for t in targets:
            waiting[t] += 1
    level, rounds, done = [n for n, k in waiting.items() if not k], 0, 0
    while level:  # one layer of the graph at a time: no recursion, whatever its depth
        done += len(level)
        after = []
        for n in level:
            for t in succ.get(n, []):
                waiting[t] -= 1
                if not waiting[t]:
                    after.append(t)
        level, rounds = after, rounds + bool(after)
    return rounds if done == len(nodes) else len(nodes)


def _shallow(rows) -> dict | None:
    """For an acyclic ordering graph of depth <= 1: {after: [(before, edge_idx), ...]}; else None."""
    preds: dict[str, list[tuple[str, int]]] = {}
    for i, (f, t, typ, *_) in enumerate(rows):
        if typ in ("BLOCKS", "DEPENDS_ON"):
            preds.setdefault(t, []).append((f, i))
        elif typ == "CAUSED_BY":
            preds.setdefault(f, []).append((t, i))
    befores = {b for v in preds.values() for b, _ in v}
    if any(a in befores for a in preds):  # a node that is both before and after: depth >= 2 or a cycle
        return None
    return preds


def _literal_map(entries: dict, empty: Column) -> Column:
    """A map literal; with no entries still a map of the right type."""
    if not entries:
        return F.map_from_arrays(F.array(F.lit("")), F.array(empty))
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def _fix_order_shallow(ids: DataFrame, scope: Sequence[str], preds: dict) -> DataFrame:
    return _fix_order_shallow_with(ids, scope, preds).select(*scope, "rule_id", "pos", "rank")


def _fix_order_shallow_with(ids: DataFrame, scope: Sequence[str], preds: dict) -> DataFrame:
    """Kahn order for depth-1 graphs with windows only (no join, no checkpoint).

    Level 0 = no predecessor present in the scope, in input order; level 1 after
    them, ordered by the rank of the last predecessor, then edge order.
    """
    s = list(scope)
    w = Window.partitionBy(*s) if s else Window.partitionBy(F.lit(0))
    empty = F.array().cast("array<struct<before:string,edge_idx:int>>")
    pred_map = _literal_map({a: F.array(*[F.struct(F.lit(b).alias("before"), F.lit(i).alias("edge_idx"))
                                          for b, i in v]) for a, v in preds.items()}, empty)
    x = ids if "_present" in ids.columns else ids.withColumn("_present", F.collect_set("rule_id").over(w))
    x = x.select(*s, "rule_id", "pos", "_present")
    x = x.withColumn("_pp", F.filter(F.coalesce(pred_map[F.col("rule_id")], empty),
                                     lambda p: F.array_contains(F.col("_present"), p["before"])))
    x = x.withColumn("_lvl", F.when(F.size("_pp") > 0, 1).otherwise(0))
    x = x.withColumn("_r0", F.when(F.col("_lvl") == 0, F.row_number().over(w.orderBy("_lvl", "pos"))))
    x = x.withColumn("_rmap", F.map_from_entries(F.collect_list(
        F.when(F.col("_lvl") == 0, F.struct("rule_id", "_r0"))).over(w)))
    x = x.withColumn("_last", F.array_max(F.transform(
        "_pp", lambda p: F.struct(F.col("_rmap")[p["before"]].alias("r"), p["edge_idx"].alias("e")))))
    rank = F.row_number().over(w.orderBy("_lvl", F.coalesce(F.col("_last.r"), F.lit(0)),
                                         F.coalesce(F.col("_last.e"), F.lit(0)), "pos"))
    return x.select(*s, "rule_id", "pos", "_present", rank.cast("int").alias("rank"))


def fix_order(ids: DataFrame, scope: Sequence[str], edge_rows=None, materialized: bool = False) -> DataFrame:
    """Topological order per scope, first in first out, ties by input order.

    Kahn's FIFO queue yields levels (longest path from a source) in order;
    inside a level, nodes come in the order their last predecessor was
    dequeued, then by edge order. Each round ranks one level with a join and
    a window; rounds = longest path of the fixed edge graph. A scope with
    unranked ids (a cycle) keeps its input order.
    Input: (scope..., rule_id, pos). Output adds `rank`. `edge_rows` is a list
    of edges or a DataFrame of them; a DataFrame, and no scope, take the way of
    `_fix_order_table`.
    """
    spark = ids.sparkSession
    if isinstance(edge_rows, DataFrame):
        return _fix_order_table(ids, scope, edge_rows, materialized)
    rows = EDGES if edge_rows is None else edge_rows
    if not scope:
        return _fix_order_table(ids, scope, edges(spark, rows), materialized)
    shallow = _shallow(rows)
    if shallow is not None:  # the shipped table: one window pass
        return _fix_order_shallow(ids, scope, shallow)
    oe = F.broadcast(_ordering_edges(edges(spark, rows)))
    s = list(scope)
    if not materialized:
        ids = materialize(ids)  # read several times below; the scan under it runs once
    # edges with both ends present in the scope
    pe = (ids.select(*s, F.col("rule_id").alias("before")).join(oe, "before")
          .join(ids.select(*s, F.col("rule_id").alias("after")), [*s, "after"], "left_semi"))
    indeg = pe.groupBy(*s, "after").agg(F.count(F.lit(1)).alias("indeg"))
    base = ids.join(indeg.withColumnRenamed("after", "rule_id"), [*s, "rule_id"], "left")
    ranked = (base.filter(F.col("indeg").isNull())
              .withColumn("rank", F.row_number().over(Window.partitionBy(*s).orderBy("pos")))
              .select(*s, "rule_id", "pos", "rank"))
    pending = base.filter(F.col("indeg").isNotNull()).select(*s, "rule_id", "pos", "indeg")
    # each round is checkpointed: the plan of round k would otherwise contain
    # every earlier round (exponential plan growth for long paths and cycles)
    rounds = _rounds(rows)
    deep = rounds > 2  # shallow graphs (the shipped table has 1 round) keep a small plan
    keep = materialize if deep else (lambda d: d)
    ranked, pending = keep(ranked), keep(pending)
    for _ in range(rounds):
        if deep and pending.isEmpty():
            break
        done = ranked.select(*s, F.col("rule_id").alias("before"), F.col("rank").alias("brank"))
        hits = (pe.join(done, [*s, "before"])
                .groupBy(*s, "after")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.max(F.struct("brank", "edge_idx")).alias("last")))
        unlocked = (pending.join(hits.withColumnRenamed("after", "rule_id"), [*s, "rule_id"])
                    .filter(F.col("n") == F.col("indeg")))
        offset = ranked.groupBy(*s).agg(F.max("rank").alias("off"))
        new = (unlocked.join(offset, s)
               .withColumn("rank", F.col("off") + F.row_number().over(
                   Window.partitionBy(*s).orderBy(F.col("last.brank"), F.col("last.edge_idx"))))
               .select(*s, "rule_id", "pos", "rank"))
        new = keep(new)
        if deep and new.isEmpty():
            break  # the rest is cyclic
        ranked = keep(ranked.unionByName(new))
        pending = keep(pending.join(new.select(*s, "rule_id"), [*s, "rule_id"], "left_anti"))
    # cyclic scopes: something left pending -> input order for the whole scope
    cyclic = pending.select(*s).distinct().withColumn("_cyc", F.lit(True))
    out = (ids.join(ranked.select(*s, "rule_id", "rank"), [*s, "rule_id"], "left")
           .join(cyclic, s, "left"))
    return out.select(*s, "rule_id", "pos",
                      F.when(F.col("_cyc").isNull(), F.col("rank")).otherwise(F.col("pos")).cast("int").alias("rank"))


def _fix_order_table(ids: DataFrame, scope: Sequence[str], edge_df: DataFrame, materialized: bool = False) -> DataFrame:
    """G4 with edges as a table of any size, and scopes of any size.

    Kahn's queue, a level at a time. A level's nodes are dequeued in an order
    `at`; each lowers the count of its successors. A successor that comes to 0
    joins the next level, placed by its last predecessor's `at` and that edge's
    index: the rows are sorted by them over range partitions, and the place in
    this sort is the new `at`. Levels follow each other, so (level, at) is the
    queue's order and is turned into ranks at the end. What never comes to 0
    lies on or behind a cycle: its scope keeps its input order. There is a round
    for each level, that is for each step of the longest path; every round's
    tables are written to the shared folder.
    """
    s = list(scope)
    ids = ids if materialized else stored(ids.select(*s, "rule_id", "pos"))
    out_of = ids.select(*s, F.col("rule_id").alias("before")).join(_ordering_edges(edge_df), "before")
    inner = stored(out_of.alias("a").join(ids.alias("b"), _in_scope(s, "after"), "left_semi"))
    blocked = inner.groupBy(*s, F.col("after").alias("rule_id")).agg(F.count(F.lit(1)).alias("left"))
    base = stored(ids.alias("a").join(blocked.alias("b"), _in_scope(s, "rule_id"), "left").select("a.*", "b.left"))
    at = F.col("pos").cast("long").alias("at")
    frontier = base.where("left IS NULL").select(*s, "rule_id", "pos", F.lit(0).alias("level"), at)
    waiting = base.where("left IS NOT NULL").select(*s, "rule_id", "pos", "left")
    levels, level = [frontier], 0
    while not (frontier.isEmpty() or waiting.isEmpty()):
        level += 1
        done = inner.alias("a").join(frontier.alias("b"), _in_scope(s, "before"))
        last = F.max(F.struct("b.at", "a.edge_idx")).alias("last")
        hits = done.groupBy(*(F.col(f"a.{c}") for c in s), F.col("a.after").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"), last)
        met = waiting.alias("a").join(hits.alias("b"), _in_scope(s, "rule_id"), "left")
        lowered = stored(met.select(*(F.col(f"a.{c}") for c in [*s, "rule_id", "pos"]),
                                         (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), "last"))
        # what comes to 0 in this round has its last predecessor in this round's frontier
        ready = lowered.where("left = 0").repartitionByRange(*s, "last").sortWithinPartitions(*s, "last")
        frontier = stored(ready.select(*s, "rule_id", "pos", F.lit(level).alias("level"), F.monotonically_increasing_id().alias("at")))
        waiting = lowered.where("left > 0").drop("last")
        levels.append(frontier)
    rows = waiting.select(*s, "rule_id", "pos", F.lit(level).alias("level"), at)  # on or behind a cycle
    cyclic = rows.select(*s).distinct().withColumn("_cyclic", F.lit(True)) if s else None
    as_given = F.col("_cyclic").isNotNull() if s else F.lit(not waiting.isEmpty())
    for f in levels:
        rows = rows.unionByName(f)
    if s:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in s]
        rows = rows.alias("a").join(cyclic.alias("b"), same, "left").select("a.*", "b._cyclic")
    placed = rows.select(*s, "rule_id", "pos", F.when(as_given, 0).otherwise(F.col("level")).alias("level"),
                           F.when(as_given, F.col("pos").cast("long")).otherwise(F.col("at")).alias("at"))
    ranked = rank_in_groups(placed, s, ["level", "at"], "rank")
    return ranked.select(*s, "rule_id", "pos", F.col("rank").cast("int").alias("rank"))


def order_report_rows(ids: DataFrame, scope: Sequence[str], edge_rows=None) -> DataFrame:
    """G6 as rows (scope..., rank, item): numbered ids with their in-scope edges, for scopes of any size.

    A scope's items in the order of `rank`, between the report's head and its
    count, are the report (`sinks.order_report_lines` writes them in order).
    """
    s = list(scope)
    table = edge_rows if isinstance(edge_rows, DataFrame) else edges(ids.sparkSession, edge_rows)
    held = stored(ids.select(*s, "rule_id", "pos"))
    ordered = _fix_order_table(held, s, table, materialized=True)
    rels = relationships_in_scope(held, s, table, materialized=True)
    text = sentence(F.col("from_id"), F.col("to_id"), F.col("rel_type"), F.col("reason"))
    lines = rels.groupBy(*s, F.col("from_id").alias("rule_id")).agg(
        F.array_sort(F.collect_list(F.struct("edge_idx", text.alias("txt")))).alias("rl"))
    met = ordered.alias("a").join(lines.alias("b"), _in_scope(s, "rule_id"), "left")
    below = F.transform("b.rl", lambda r: F.concat(F.lit("\n   - "), r["txt"]))
    item = F.concat(F.format_string("%d. **%s**", F.col("a.rank"), F.col("a.rule_id")), F.coalesce(F.array_join(below, ""), F.lit("")))
    return met.select(*(F.col(f"a.{c}") for c in s), F.col("a.rank"), item.alias("item"))


def order_report(ids: DataFrame, scope: Sequence[str], edge_rows=None) -> DataFrame:
    """One report text per scope: numbered ids with their in-scope edges and a count.

    A scope's text is one value, so scopes should be bounded; for a scope of
    everything `order_report_rows` gives the same as rows.
    """
    s = list(scope)
    if isinstance(edge_rows, DataFrame) or not s:
        return _assemble_report(order_report_rows(ids, s, edge_rows), s)
    spark = ids.sparkSession
    rows = EDGES if edge_rows is None else edge_rows
    shallow = _shallow(rows)
    if shallow is not None:
        # one read of `ids`: ranks and in-scope edges come from the same window pass
        out_map = {}
        for i, (f, t, typ, _prio, reason) in enumerate(rows):
            out_map.setdefault(f, []).append((i, t, typ, reason))
        empty = F.array().cast("array<struct<edge_idx:int,to_id:string,rel_type:string,reason:string>>")
        emap = _literal_map({f: F.array(*[F.struct(
            F.lit(i).alias("edge_idx"), F.lit(t).alias("to_id"), F.lit(typ).alias("rel_type"),
            F.lit(reason).alias("reason")) for i, t, typ, reason in v]) for f, v in out_map.items()}, empty)
        w = Window.partitionBy(*s) if s else Window.partitionBy(F.lit(0))
        present = ids.withColumn("_present", F.collect_set("rule_id").over(w))
        x = _fix_order_shallow_with(present, s, shallow)
        here = F.filter(F.coalesce(emap[F.col("rule_id")], empty),
                        lambda e: F.array_contains(F.col("_present"), e["to_id"]))
        rl = F.transform(here, lambda e: F.struct(e["edge_idx"].alias("edge_idx"), sentence(
            F.col("rule_id"), e["to_id"], e["rel_type"], e["reason"]).alias("txt")))
        items = x.select(*s, "rank", "rule_id", rl.alias("rl")).select(*s, "rank", F.concat_ws(
            "\n", F.format_string("%d. **%s**", F.col("rank"), F.col("rule_id")),
            F.array_join(F.transform("rl", lambda r: F.concat(F.lit("   - "), r["txt"])), "\n")).alias("item"))
        return _assemble_report(items, s)
    ids = materialize(ids)
    ordered = fix_order(ids, s, rows, materialized=True)
    rels = relationships_in_scope(ids, s, edges(spark, rows))
    rel_lines = (rels.groupBy(*s, "from_id")
                 .agg(F.array_sort(F.collect_list(F.struct(
                     "edge_idx", sentence(F.col("from_id"), F.col("to_id"), F.col("rel_type"), F.col("reason"))
                     .alias("txt")))).alias("rl")))
    items = (ordered.join(rel_lines.withColumnRenamed("from_id", "rule_id"), [*s, "rule_id"], "left")
             .select(*s, "rank", F.concat_ws(
                 "\n", F.format_string("%d. **%s**", F.col("rank"), F.col("rule_id")),
                 F.array_join(F.transform(F.coalesce(F.col("rl"), F.array()), lambda r: F.concat(F.lit("   - "), r["txt"])),
                              "\n")).alias("item")))
    return _assemble_report(items, s)


def _assemble_report(items: DataFrame, s: list[str]) -> DataFrame:
    items = items.select(*s, "rank", F.regexp_replace("item", "\n$", "").alias("item"))
    per_scope = items.groupBy(*s).agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("its"),
                                      F.count(F.lit(1)).alias("n_ids"))
    header = "## Fix order\n\n### Sequence\n\n"
    return per_scope.select(
        *s, F.col("n_ids").cast("bigint").alias("n_ids"),
        F.concat(F.lit(header), F.array_join(F.transform("its", lambda x: x["item"]), "\n"),
                 F.format_string("\n\n_%d issue(s) analysed._", F.col("n_ids"))).alias("report"))
