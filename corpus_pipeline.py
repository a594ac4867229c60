"""The corpus pipeline: five stages over the `documents` table, each one of the operators in `codesift.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import linededup, mixing, neardup, toxicity, wfst
from codesift.llm.common import stored, table

#: A document is rejected as toxic at this score, the one at which op4_toxicity predicts 1.
REJECT = toxicity.THRESHOLD


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity models reject. A row whose key is null is judged by its text as well."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), REJECT)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of many sources removed but in their first place; `n_chars` follows the text."""
    cleaned = linededup.dedup_lines(docs)
    cleaned = cleaned.select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, their number, and whether they decode to its text."""
    coded = wfst.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("__ids").cast("long").alias("n_tokens"),
        F.col("__ids").alias("ids"),
        F.col("__decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: The toxicity models and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
