"""Line dedup by distinct-site spread.

A line is boilerplate when it stands on at least `min_sites` distinct sites. One HyperLogLog sketch a line hash holds
its sites; partial sketches merge in the aggregation, so a line of a third of all documents costs one sketch a task.
Lines whose estimate is within the sketch's error of the threshold get an exact distinct count. Boilerplate lines are
removed wherever they stand but in their first place (smallest document key, then position), so that no content is
lost and a text copied to many sites stays once.

Lines are the parts between line feeds, compared by a 64-bit hash of the whole line. Defined cases: a null text stays
null; an empty text has one line, the empty one; blank lines (white space only) are never boilerplate; a null site is
no site; a null key comes last among first places; rows with equal key, text and site lose the same lines (all keep
a first place that one of them has); an empty table gives an empty result. A document may become empty; no row goes.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import apart, stored

MIN_SITES = 10
#: Registers of a sketch as a power of two, and the relative standard error (two-sided 95 % is twice that).
LG_K = 8
REL_ERROR = 1.04 / (1 << LG_K) ** 0.5
#: Estimates within so many standard errors of the threshold are counted exactly.
MARGIN = 5.0


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`lines` (line, site, at) -> (line, sites, first) of lines on `min_sites` sites or more; first: smallest `at`."""
    sketched = stored(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("at").alias("first"))
        .select("line", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= min_sites * (1 - MARGIN * REL_ERROR))
    )
    near = F.col("estimate") <= min_sites * (1 + MARGIN * REL_ERROR)
    exact = (
        lines.join(sketched.where(near).select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("exact"))
    )
    sites = F.coalesce("exact", "estimate")
    return (
        sketched.join(exact, "line", "left")
        .where(~near | (F.col("exact") >= min_sites))
        .select("line", sites.alias("sites"), "first")
    )


@apart
def dedup_lines(
    docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES
) -> DataFrame:
    """`docs` with its text column cleaned, and `__lines`, a struct of n_lines and n_removed."""
    body = docs.select(
        F.col(key).alias("k"), F.xxhash64(key, text).alias("row"), F.col(site).cast("string").alias("site"), F.split(text, "\n").alias("l")
    )
    lines = body.select("k", "row", "site", F.posexplode("l").alias("pos", "text")).where(F.col("text").rlike(r"\S"))
    at = F.struct(F.col("k").isNull().alias("none"), "k", "row", "pos")
    lines = stored(lines.select(F.xxhash64("text").alias("line"), "site", at.alias("at")))
    gone = (
        lines.join(stored(spread_lines(lines, min_sites)), "line")
        .where(F.col("at") != F.col("first"))
        .groupBy(F.col("at.row").alias("__row"))
        .agg(F.collect_set("at.pos").alias("__gone"))
    )
    joined = docs.withColumn("__row", F.xxhash64(key, text)).join(gone, "__row", "left")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda _, i: ~F.array_contains("__gone", i))
    return joined.select(
        *(
            F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"`{c}`")
            for c in docs.columns
        ),
        F.struct(
            F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
            F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"),
        ).alias("__lines"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "__lines.n_lines", "__lines.n_removed", "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
  GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line)
SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (WHERE gone)::INTEGER AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
