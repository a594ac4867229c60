"""Mixing sources to target weights: capped water-filling and seeded repetitions (native).

`targets` spreads the mix's total over the sources by weight. A source whose share exceeds `max_epochs` times its
size is clamped there, the excess goes to the others in proportion to their weights, and so on until no source is
above. Each round is one aggregate to one row; a round clamps at least one more source or ends.

`mix` turns a source's target into repetitions of its documents: `floor(target / size)` whole ones for each, and one
more for the documents that come first in a seeded order until the rest of the target is met. The order's running
sums are taken in two levels, seeded buckets of a source and documents of a bucket, so no task holds a source.

Defined cases: a null text has size 0, as an empty one; a null source is a source of its own, the last in order;
documents of size 0 take 0 words; equal rows are told apart by nothing, so which of them is repeated does not show;
an empty table gives an empty mix; other columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.llm.common import WORD, apart, stored

SEED = 20240
MAX_EPOCHS = 3
#: Seeded buckets of a source; a window holds one bucket's documents.
BUCKETS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., `cycle`, repeating, for sources in the order of `key`.

    One row a source, so the window's single task holds the mixture's recipe, not documents.
    """
    return sources.withColumn("weight", ((F.row_number().over(Window.orderBy("key")) - 1) % cycle + 1).cast("double"))


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sources` (key, source_size, weight) -> the same with `target`, by capped water-filling."""
    sources = stored(sources)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words for each unit of weight
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        full, free = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))
        ).first()
        # Rounding may leave `level` a last digit lower than before; the set of clamped sources must only grow.
        risen = max(level, (total - (full or 0.0)) / free) if free else level
        if risen == level:
            break
        level = risen
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


@apart
def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """`docs` with `__mix`, a struct of size, source_size, target, repeats and taken (words, repeats counted).

    A source's `taken` sum differs from its target by at most half of one document's size.
    """
    sized = docs.withColumn(
        "__m",
        F.struct(
            source_key(F.col(source)).alias("key"),
            size_of(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("at"),
        ),
    )
    bucket = F.pmod("__m.at", F.lit(buckets))
    by_bucket = stored(
        sized.groupBy(F.col("__m.key").alias("key"), bucket.alias("bucket")).agg(F.sum("__m.size").alias("words"))
    )
    sources = targets(cyclic_weights(by_bucket.groupBy("key").agg(F.sum("words").alias("source_size"))), max_epochs)
    # Words of a source's earlier buckets: at most `buckets` rows in a window partition, whatever the source holds.
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        by_bucket.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(sources, "key")
        .select(
            F.col("key").alias("__k"),
            F.col("bucket").alias("__b"),
            F.struct("before", "source_size", "target").alias("__p"),
        )
    )
    joined = sized.withColumns({"__k": F.col("__m.key"), "__b": bucket}).join(plan, ["__k", "__b"])
    inside = Window.partitionBy("__k", "__b").orderBy("__m.at", F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    size, target = F.col("__m.size"), F.col("__p.target")
    whole = F.coalesce(F.floor(F.try_divide(target, "__p.source_size")), F.lit(0))
    # A document is taken once more if at least half of it lies within what whole repetitions leave of the target.
    start = F.col("__p.before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    once_more = (start + size / F.lit(2.0) <= target - whole * F.col("__p.source_size")) & (whole < max_epochs)
    repeats = F.when(size > 0, whole + once_more.cast("int")).otherwise(0).cast("int")
    return joined.withColumn("__r", repeats).select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.struct(
            size.alias("size"),
            F.col("__p.source_size").alias("source_size"),
            target.alias("target"),
            F.col("__r").alias("repeats"),
            (size * F.col("__r")).cast("long").alias("taken"),
        ).alias("__mix"),
    )


@apart
def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of `docs`."""
    out = mix(docs, **options)
    return out.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("__mix.repeats")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken", "__mix.repeats")
