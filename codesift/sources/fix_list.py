"""A list of fixes derived from `lineitem`, one a row, for the queries of the fix table.

Ten kinds in turn: literal and regex replacements with JavaScript's `$` forms, deletions, insertions, refused rows and
rows that lack something. Some name lines or texts that are not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Fixed values: (fix_type, find_kind, find, replace, insert_at, insert_content) of each kind.
KINDS = [
    ("REPLACE", "literal", "(", "[$&$$", None, None),
    ("REPLACE", "literal", "const ", "let $1 ", None, None),
    ("REPLACE", "regex", r"(\w+)\.(\w+)", "$2:$1$3", None, None),
    ("DELETE", None, None, None, None, None),
    ("INSERT", None, None, None, "ABOVE", "// above"),
    ("INSERT", None, None, None, "BELOW", "// below"),
    ("INSERT", None, None, None, "END", "// end"),
    ("MULTI_FILE", None, None, None, None, None),
    ("REPLACE", "regex", r"\d{19}", "-", None, None),
    ("REPLACE", "literal", "=", "{$`|$'}", None, None),
    ("REPLACE", "literal", "", "nothing to find", None, None),
]
FAR = 10**12  # added to the id of a text that is not there


def fix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    fields = ("fix_type", "find_kind", "find", "replace", "insert_at", "insert_content")
    kinds = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(fields, k))) for k in KINDS))
    rows = li.select(
        (F.col("l_orderkey") + F.when(F.col("l_suppkey") % 41 == 0, FAR).otherwise(0)).alias("file"),
        F.concat(F.lit("t-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
                 F.lit("-"), F.col("l_suppkey").cast("string")).alias("fix_id"),
        F.when(F.col("l_suppkey") % 37 != 0, F.col("l_linenumber") * 2 - F.col("l_suppkey") % 3).cast("int").alias("line"),
        (F.col("l_suppkey") % 4 == 0).alias("requires_confirmation"),
        F.element_at(kinds, (F.col("l_partkey") % len(KINDS)).cast("int") + 1).alias("k"),
    )
    return rows.select("file", "fix_id", "line", "requires_confirmation", "k.*")


def approvals_of(fixes: DataFrame) -> DataFrame:
    """The approved ones, as a reviewer might have listed them: every other text's."""
    return fixes.where(F.col("requires_confirmation") & (F.col("file") % 2 == 0)).select("file", "fix_id")
