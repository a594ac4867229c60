"""Results of external scanners (S3, S4) and source precedence.

Two JSON shapes:
* API:  {"results": [{"rule_id", "message", "severity", "line"}]}
* CLI:  {"results": [{"check_id", "extra": {"message", "severity"}, "start": {"line"}}]}
Missing fields default to rule 'unknown', message 'Vulnerability detected',
severity normalised (default medium) and line 0.

A text is read as VARIANT, so every item keeps the types it has. It is a usable
result if the reference would map it without an error:

* it is one JSON value, with nothing behind it, and not `null`;
* `results` is an array, or null, or absent (`{}`, `[]` and bare scalars have no
  `results`): the last three cover the file with no findings;
* no item is null; an item's rule id and severity are strings, null or absent.
  Items that are no objects have no fields, so they count with all defaults.

Anything else (an object or a string as `results`, cut text, an error message) is
no result: the next source counts. Messages and lines may have any type; a line
that is no number counts as 0, a fraction loses its part after the point. Objects
that name a key twice are not accepted by the parser, so such a text is no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import once
from ..operators.severity import normalise
from ..session import materialize, read_table

# Defaults for absent fields.
DEFAULT_RULE = "unknown"
DEFAULT_MESSAGE = "Vulnerability detected"
MAX_LINE = 2**31 - 1

#: Where an item has its fields.
API_PATHS = {"rule": "$.rule_id", "message": "$.message", "severity": "$.severity", "line": "$.line"}
CLI_PATHS = {"rule": "$.check_id", "message": "$.extra.message", "severity": "$.extra.severity", "line": "$.start.line"}
#: The field that holds a text's value while it is parsed, and one behind it that shows where the text ends.
_HELD, _END = "held", "end"


def one_value(json_col: str | Column) -> Column:
    """The text's JSON value as VARIANT; null if it is not exactly one value.

    The parser ignores what stands behind a value, so the text is parsed as a field of an object with another field
    behind it: both are there, and no third one, only if the text is one value.
    """
    text = F.col(json_col) if isinstance(json_col, str) else json_col
    whole = F.try_parse_json(F.concat(F.lit(f'{{"{_HELD}":'), text, F.lit(f',"{_END}":0}}')))
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    return once(fields, lambda f: F.when((F.size(f) == 2) & F.map_contains_key(f, _END), F.try_element_at(f, F.lit(_HELD))))


def _none(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _text_or_none(item: Column, path: str) -> Column:
    """The field is a string, null or absent."""
    v = F.try_variant_get(item, path, "variant")
    return _none(v) | F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def results(value: Column, paths: dict[str, str]) -> Column:
    """The items of a result as array<variant>: empty if it has none, null if the value is no usable result."""
    def items_of(v):
        found = F.try_variant_get(v, "$.results", "variant")
        good = lambda items: F.when(
            F.forall(items, lambda i: ~_none(i) & _text_or_none(i, paths["rule"]) & _text_or_none(i, paths["severity"])), items)
        told = F.when(_none(found), F.array().cast("array<variant>")).otherwise(
            once(F.try_variant_get(v, "$.results", "array<variant>"), good))
        return F.when(~_none(v), told)

    return once(value, items_of)


def _as_findings(rows: DataFrame, id_cols, rule, message, severity, line) -> DataFrame:
    return rows.select(
        *id_cols,
        F.lit("vulnerability").alias("kind"), F.lit("Security").alias("domain"),
        F.coalesce(rule, F.lit(DEFAULT_RULE)).alias("rule_id"),
        normalise(severity).alias("severity"),
        F.coalesce(message, F.lit(DEFAULT_MESSAGE)).alias("message"),
        # line numbers beyond an int stop at its largest value
        F.least(F.greatest(F.coalesce(line, F.lit(0)), F.lit(-MAX_LINE)), F.lit(MAX_LINE)).cast("int").alias("line"),
        F.lit(-1).alias("rule_seq"),
        F.col("_pos").cast("int").alias("ext_pos"),
    )


def _ingest(df: DataFrame, id_cols: Sequence[str], items: Column, paths: dict[str, str]) -> DataFrame:
    e = df.select(*id_cols, F.posexplode(items).alias("_pos", "r"))
    field = lambda name, kind: F.try_variant_get("r", paths[name], kind)
    line = F.coalesce(field("line", "bigint"), F.when(field("line", "double") > 0, F.lit(MAX_LINE)))  # beyond a long
    return _as_findings(e, id_cols, field("rule", "string"), field("message", "string"), field("severity", "string"), line)


def ingest_api(df: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """S3: one finding row per API result; texts that are no usable result give none."""
    return _ingest(df, id_cols, results(one_value(json_col), API_PATHS), API_PATHS)


def ingest_cli(df: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """The process shape, nested fields."""
    return _ingest(df, id_cols, results(one_value(json_col), CLI_PATHS), CLI_PATHS)


def coverage(external: DataFrame, id_cols: Sequence[str], api_col: str = "api_json",
             cli_col: str = "cli_json") -> DataFrame:
    """One row per file that an external scanner covers: its ids, and the API text or else the CLI text.

    A text that is no usable result covers nothing, so the next source counts.
    Of several usable results of one source for a file, the first in text order
    counts, whatever the order of rows.
    """
    usable = [F.min(F.when(results(one_value(c), p).isNotNull(), F.col(c))).alias(c)
              for c, p in ((api_col, API_PATHS), (cli_col, CLI_PATHS))]
    best = external.groupBy(*id_cols).agg(*usable)
    return (best.filter(F.col(api_col).isNotNull() | F.col(cli_col).isNotNull())
            .withColumn(cli_col, F.when(F.col(api_col).isNull(), F.col(cli_col))))


def with_precedence(builtin: DataFrame, external: DataFrame, id_cols: Sequence[str],
                    api_col: str = "api_json", cli_col: str = "cli_json") -> DataFrame:
    """D10, whole-file: a usable API result, else a usable CLI result, else built-in Security rows.

    `external` has rows (ids, api_json, cli_json). A covered file may have zero
    results, so coverage comes from the files, not the findings. Non-Security
    built-in findings are always kept. `external` is read once:
    its one row per covered file is checkpointed.
    """
    ids = list(id_cols)
    covered = materialize(coverage(external, ids, api_col, cli_col))
    cols = builtin.columns
    vulnerability = F.col("kind") == "vulnerability"
    marked = builtin.join(covered.select(*ids, F.lit(True).alias("_covered")), ids, "left")
    kept = marked.filter(~vulnerability | F.col("_covered").isNull()).select(
        *cols, F.lit(None).cast("int").alias("ext_pos"))
    ext = ingest_api(covered, ids, api_col).unionByName(ingest_cli(covered, ids, cli_col))
    return kept.unionByName(ext.select(*cols, "ext_pos"))


# ---------------------------------------------------------------------------
# Fixture: external results derived from lineitem/orders, so they grow with
# the data. API results for priorities 1-2, CLI results for 3, none otherwise;
# one result per line item with quantity below 25 (so some covered files have
# an empty result list).
# ---------------------------------------------------------------------------
FIXTURE_IDS = ["SQL_INJECTION", "javascript.express.xss", "EVAL_USAGE", None, "ssrf-check"]
FIXTURE_SEVERITIES = ["ERROR", "warning", "Info", "high", None, "bogus", "LOW"]
FIXTURE_MESSAGES = ["tainted input reaches a sink", None, "unsafe call"]


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (idx % len(values)).cast("int") + 1)


def external_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                      "l_linenumber", "l_quantity")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    res = F.when(F.col("l_quantity") < 25, F.struct(
        F.col("l_linenumber").alias("ord"),
        F.col("l_partkey").alias("ord2"),
        _pick(FIXTURE_IDS, F.col("l_partkey")).alias("rid"),
        _pick(FIXTURE_MESSAGES, F.col("l_suppkey")).alias("msg"),
        _pick(FIXTURE_SEVERITIES, F.col("l_partkey") + F.col("l_suppkey")).alias("sev"),
        F.col("l_linenumber").cast("long").alias("line"),
    ))
    per_file = (rows.groupBy(F.col("l_orderkey").alias("file"), "o_orderpriority")
                .agg(F.array_sort(F.collect_list(res)).alias("rs")))
    api = F.to_json(F.struct(F.transform("rs", lambda x: F.struct(
        x["rid"].alias("rule_id"), x["msg"].alias("message"), x["sev"].alias("severity"),
        x["line"].alias("line"))).alias("results")))
    cli = F.to_json(F.struct(F.transform("rs", lambda x: F.struct(
        x["rid"].alias("check_id"),
        F.struct(x["msg"].alias("message"), x["sev"].alias("severity")).alias("extra"),
        F.struct(x["line"].alias("line")).alias("start"))).alias("results")))
    prio = F.col("o_orderpriority")
    return per_file.select(
        "file",
        F.when(prio.isin("1-URGENT", "2-HIGH"), api).alias("api_json"),
        F.when(prio == "3-MEDIUM", cli).alias("cli_json"),
    )


# Texts of odd shapes, (API text, CLI text), dealt over the orders by their key.
_GOOD_CLI = '{"results":[{"check_id":"C1","extra":{"message":"m","severity":"WARNING"},"start":{"line":2}}]}'
ODD_TEXTS = [
    ('{"results":{}}', _GOOD_CLI),
    ('{"results":"x"}', '{"results":null,"errors":[]}'),
    ("{}", _GOOD_CLI),
    ("[]", None),
    ('{"results":[null]}', None),
    ('{"results":[]} and more', _GOOD_CLI),
    ('{"results":[{"rule_id":5}]}', None),
    ('{"results":[{"severity":3}]}', '{"results":[{"check_id":"C2","extra":null,"start":{"line":"7"}}]}'),
    ('{"results":[5,"x",{"rule_id":null,"line":3.9,"message":12}]}', None),
    ("null", "null"),
    ('{"results":[{"rule_id":"A","line":-4},{"rule_id":"B","severity":"ERROR","line":1e30}]}', _GOOD_CLI),
    (None, None),
    ("error: no such host", '{"results":[{"check_id":"C3","extra":{"severity":[]}}]}'),
]


def odd_external_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, api_json, cli_json) for every order: a text of one of the odd shapes."""
    which = (F.col("o_orderkey") % len(ODD_TEXTS)).cast("int")
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("file"), *(
        _pick([t[i] for t in ODD_TEXTS], which).alias(c) for i, c in enumerate(("api_json", "cli_json"))))
