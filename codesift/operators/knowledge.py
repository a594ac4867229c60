"""Knowledge lookups (K1-K8): explanation and remediation-guide dimensions.

Both dimensions are keyed by rule id and have a fixed number of rows (44 and
20), so joining them by broadcast is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..knowledge_data import EXPLANATIONS, GUIDES

STEP = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("title", T.StringType()),
                     T.StructField("description", T.StringType()), T.StructField("example", T.StringType())])
REF = T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])
EXPLANATION_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("what", T.StringType()),
    T.StructField("why", T.StringType()),
    T.StructField("risks", T.ArrayType(T.StringType())),
    T.StructField("standard", T.StructType([T.StructField("name", T.StringType()),
                                            T.StructField("cwe_name", T.StringType()),
                                            T.StructField("url", T.StringType())])),
    T.StructField("example", T.StructType([T.StructField("bad", T.StringType()),
                                           T.StructField("good", T.StringType()),
                                           T.StructField("docs_url", T.StringType())])),
    T.StructField("steps", T.ArrayType(STEP)),
    T.StructField("refs", T.ArrayType(REF)),
])
GUIDE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("guide_domain", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("bad", T.StringType()),
    T.StructField("good", T.StringType()),
    T.StructField("steps", T.ArrayType(T.StringType())),
    T.StructField("minutes", T.IntegerType()),
    T.StructField("gain_ms", T.DoubleType()),
    T.StructField("gain_percent", T.IntegerType()),
    T.StructField("env_var", T.StringType()),
    T.StructField("related", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.StringType()),
    T.StructField("guide_pos", T.IntegerType()),
])


def explanations(spark: SparkSession) -> DataFrame:
    """K2: one dimension table; ids are unique so nothing is overridden."""
    return spark.createDataFrame(EXPLANATIONS, EXPLANATION_SCHEMA)


def guides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([dict(g, guide_pos=i) for i, g in enumerate(GUIDES)], GUIDE_SCHEMA)


def with_explanation(findings: DataFrame, id_col: str = "rule_id") -> DataFrame:
    """K1: left join on the upper-cased id; no entry -> null `explanation`."""
    ex = explanations(findings.sparkSession)
    dim = F.broadcast(ex.select(F.col("rule_id").alias("_ex_id"),
                                F.struct(*[c for c in ex.columns if c != "rule_id"]).alias("explanation")))
    return (findings.join(dim, F.upper(F.col(id_col)) == F.col("_ex_id"), "left")
            .drop("_ex_id"))


def with_guide(findings: DataFrame, id_col: str = "rule_id", iterations: Column | None = None,
               in_test: Column | None = None) -> DataFrame:
    """K3 + K4: case-sensitive id join; gain scales with iterations, test code saves 2 minutes."""
    g = guides(findings.sparkSession)
    dim = F.broadcast(g.select(F.col("rule_id").alias("_g_id"),
                               F.struct(*[c for c in g.columns if c != "rule_id"]).alias("guide")))
    out = findings.join(dim, F.col(id_col) == F.col("_g_id"), "left").drop("_g_id")
    gain = F.col("guide.gain_ms")
    if iterations is not None:
        gain = F.when(iterations.isNotNull() & gain.isNotNull(), iterations * gain).otherwise(gain)
    minutes = F.col("guide.minutes")
    if in_test is not None:
        minutes = F.when(F.coalesce(in_test, F.lit(False)), F.greatest(F.lit(1), minutes - 2)).otherwise(minutes)
    return (out.withColumn("fix_minutes", F.when(F.col("guide").isNotNull(), minutes))
            .withColumn("gain_ms", F.when(F.col("guide").isNotNull(), gain)))


def guide_ids_for_domain(spark: SparkSession, domain: str) -> DataFrame:
    """K6 (K5 with domain=None): guide ids of a domain, in guide order; unknown -> empty."""
    g = guides(spark)
    if domain is not None:
        g = g.filter(F.col("guide_domain") == domain)
    return g.select("rule_id", "guide_domain", "guide_pos")


def guide_coverage(findings: DataFrame) -> DataFrame:
    """K5: all guide ids in guide order, with the number of findings of each (0 if none)."""
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return (guide_ids_for_domain(findings.sparkSession, None).join(counts, "rule_id", "left")
            .select("rule_id", "guide_domain", "guide_pos", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_findings")))


def explanation_detail_rows(rule_ids: DataFrame, id_col: str = "rule_id") -> DataFrame:
    """K7: (rule_id, section, pos, label, detail) rows of the explanation of each id.

    The detail rows are cut from the 44-row dimension first; the found ids are
    computed once and semi-joined (the findings under them are scanned once).
    """
    e = explanations(rule_ids.sparkSession)
    single = [
        e.select("rule_id", F.lit("what").alias("section"), F.lit(0).alias("pos"),
                 F.lit("What").alias("label"), F.col("what").alias("detail")),
        e.select("rule_id", F.lit("why").alias("section"), F.lit(0).alias("pos"),
                 F.lit("Why").alias("label"), F.col("why").alias("detail")),
        e.select("rule_id", F.lit("standard").alias("section"), F.lit(0).alias("pos"),
                 F.col("standard.name").alias("label"), F.col("standard.cwe_name").alias("detail")),
        e.select("rule_id", F.lit("example").alias("section"), F.lit(0).alias("pos"),
                 F.lit("bad").alias("label"), F.col("example.bad").alias("detail")),
        e.select("rule_id", F.lit("example").alias("section"), F.lit(1).alias("pos"),
                 F.lit("good").alias("label"), F.col("example.good").alias("detail")),
    ]
    # rows that only some explanations have: the standard's page and the documentation link
    single += [
        e.where(F.length("standard.url") > 0).select(
            "rule_id", F.lit("standard_url").alias("section"), F.lit(0).alias("pos"),
            F.col("standard.name").alias("label"), F.col("standard.url").alias("detail")),
        e.where(F.col("example.docs_url").isNotNull()).select(
            "rule_id", F.lit("docs").alias("section"), F.lit(0).alias("pos"),
            F.lit("Docs").alias("label"), F.col("example.docs_url").alias("detail")),
    ]
    examples = e.select("rule_id", F.explode("steps").alias("s")).where(F.length("s.example") > 0).select(
        "rule_id", F.lit("step_example").alias("section"), F.col("s.order").alias("pos"),
        F.col("s.title").alias("label"), F.col("s.example").alias("detail"))
    risks = e.select("rule_id", F.posexplode("risks").alias("pos", "detail")).select(
        "rule_id", F.lit("risk").alias("section"), "pos", F.lit("Risk").alias("label"), "detail")
    steps = e.select("rule_id", F.explode("steps").alias("s")).select(
        "rule_id", F.lit("step").alias("section"), F.col("s.order").alias("pos"),
        F.col("s.title").alias("label"), F.col("s.description").alias("detail"))
    refs = e.select("rule_id", F.posexplode("refs").alias("pos", "r")).select(
        "rule_id", F.lit("ref").alias("section"), "pos", F.col("r.name").alias("label"), F.col("r.url").alias("detail"))
    details = single[0]
    for d in single[1:] + [risks, steps, examples, refs]:
        details = details.unionByName(d)
    details = details.select("rule_id", "section", F.col("pos").cast("int").alias("pos"), "label", "detail")
    ids = rule_ids.select(F.upper(F.col(id_col)).alias("rule_id")).distinct()
    # ids has at most one row per distinct rule id; the details side is the fixed dimension
    return F.broadcast(details).join(ids, "rule_id", "inner")


# Rulers and headings of the issue sheet.
EDGE, BAR = "=" * 66, "-" * 66
SHEET_TITLE, SHEET_FOOT = "ISSUE DETAIL", "Apply the planned fix, or follow the steps above."


def _indented(text: Column, by: int) -> Column:
    """Every line of a text, pushed in by `by` blanks."""
    pad = " " * by
    return F.concat(F.lit(pad), F.replace(text, F.lit("\n"), F.lit("\n" + pad)))


def _section(title: str, body: Column, ruled: bool = False) -> Column:
    """A heading, its lines and a blank line, after a ruler if asked for; null if the body is null."""
    head = ([BAR, ""] if ruled else []) + [f"  {title}"]
    return F.concat(F.lit("\n".join(head) + "\n"), body, F.lit("\n"))


def _joined(items: Column, one) -> Column:
    """The items of a list as lines; null for an empty or missing list."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, one), "\n"))


def _given(text: Column, shown: Column) -> Column:
    """`shown` if `text` is neither null nor empty."""
    return F.when(F.length(text) > 0, shown)


def _number(x: Column) -> Column:
    """A number without a fraction that is zero."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _explained(ex: Column, message: Column) -> list[Column]:
    step = lambda s: F.concat_ws(
        "\n", F.format_string("  %d. %s", s["order"], s["title"]), F.concat(F.lit("     "), s["description"]),
        _given(s["example"], F.concat(F.lit("     > "), s["example"])), F.lit(""))
    standard = F.concat_ws("\n", F.concat(F.lit("  "), ex["standard"]["name"]), F.concat(F.lit("  "), ex["standard"]["cwe_name"]),
                           _given(ex["standard"]["url"], F.concat(F.lit("  "), ex["standard"]["url"])))
    n_steps = F.size(ex["steps"]).cast("string")
    return [
        _section("PROBLEM", F.concat(F.lit("  "), message)),
        _section("WHAT IS IT", _indented(ex["what"], 2)),
        _section("WHY IT MATTERS", _indented(ex["why"], 2)),
        _section("RISKS", _joined(ex["risks"], lambda r: F.concat(F.lit("  * "), r))),
        _section("VULNERABLE CODE", _indented(ex["example"]["bad"], 4), ruled=True),
        _section("SECURE ALTERNATIVE", _indented(ex["example"]["good"], 4)),
        F.when(F.size(ex["steps"]) > 0, F.concat(
            F.lit(f"{BAR}\n\n  HOW TO FIX ("), n_steps, F.lit(" steps)\n\n"), _joined(ex["steps"], step))),
        _section("STANDARD", standard, ruled=True),
        _section("REFERENCES", _joined(ex["refs"], lambda r: F.concat(F.lit("  * "), r["name"], F.lit(": "), r["url"]))),
        _section("OFFICIAL DOCS", _given(ex["example"]["docs_url"], F.concat(F.lit("  "), ex["example"]["docs_url"]))),
    ]


def _guided(g: Column) -> list[Column]:
    numbered = F.transform(g["steps"], lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s))
    facts = F.concat_ws(
        "\n", F.format_string("  Est. fix time: %d min, confidence: %s", g["minutes"], g["confidence"]),
        _given(g["env_var"], F.concat(F.lit("  Env var needed: "), g["env_var"])),
        F.when(g["gain_ms"] != 0, F.concat(F.lit("  Performance gain: ~"), _number(g["gain_ms"]), F.lit("ms"))),
        F.when(F.size(g["related"]) > 0, F.concat(F.lit("  Related: "), F.array_join(g["related"], ", "))))
    return [
        _section("PROBLEM", F.concat(_indented(g["problem"], 2), F.lit("\n\n"), _indented(g["explanation"], 2))),
        _section("VULNERABLE CODE", _given(g["bad"], _indented(g["bad"], 4)), ruled=True),
        _section("SECURE ALTERNATIVE", _given(g["good"], _indented(g["good"], 4))),
        F.when(F.size(g["steps"]) > 0, F.concat(F.lit(f"{BAR}\n\n  HOW TO FIX\n\n"), F.array_join(numbered, "\n"), F.lit("\n"))),
        F.concat(F.lit(f"{BAR}\n\n"), facts, F.lit("\n")),
    ]


def issue_sheet(findings: DataFrame) -> DataFrame:
    """K8: one text per finding: its explanation if there is one, else its guide, else a generic line.

    The whole of the explanation: what, why, risks, bad and good code, every
    step with its example, standard, references and documentation; or of the
    guide: problem, code pair, numbered steps, time, confidence, environment
    variable, gain and related ids. Lists and links that are empty have no section.
    """
    f = with_guide(with_explanation(findings))
    ex, g = F.col("explanation"), F.col("guide")
    head = F.concat(F.lit(f"{EDGE}\n  {SHEET_TITLE}\n{EDGE}\n\n"), F.format_string(
        "  [%s]  %s, line %d, %s\n", F.upper(F.col("severity")), F.col("rule_id"), F.col("line"), F.col("domain")))
    generic = _section("PROBLEM", F.concat(F.lit("  "), F.col("message"), F.format_string(
        "\n\n  No guide for \"%s\".\n  Look the issue type up in a public security guide.", F.col("rule_id"))))
    foot = F.lit(f"{EDGE}\n  {SHEET_FOOT}\n{EDGE}")
    source = F.when(ex.isNotNull(), "explanation").when(g.isNotNull(), "guide").otherwise("none")
    body = (F.when(ex.isNotNull(), F.concat_ws("\n", *_explained(ex, F.col("message"))))
            .when(g.isNotNull(), F.concat_ws("\n", *_guided(g))).otherwise(generic))
    return f.select(*[c for c in findings.columns], source.alias("sheet_source"), F.concat_ws("\n", head, body, foot).alias("sheet"))
