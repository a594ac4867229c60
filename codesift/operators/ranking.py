"""Row numbers within groups of any size.

A window per group puts a whole group into one task, so a group that holds a third of all rows, or everything, does not
scale. Here the rows are range-partitioned by group and order and sorted; a row's place in its partition plus the rows
that its group has in earlier partitions is its number. The driver collects nothing; the only thing that grows with the
number of partitions is the table of a group's counts, one row for each partition that the group reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def rank_in_groups(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """`rows` with `name` (long, from 1): the row's number in its group, by `order`.

    Nulls are a group of their own and come first in an order. Rows that are equal in group and order are numbered in
    some order. Without groups all rows are one. The sorted rows are written to the shared folder, so that numbers stay
    as they are.
    """
    groups, keys = list(groups), [F.col(c) if isinstance(c, str) else c for c in order]
    by = [*(F.col(c) for c in groups), *keys]
    # the last key keeps many equal rows from going to one partition
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    held = stored(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("a._part") == F.col("b._part")
    for c in groups:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    number = F.col("a._at") - F.col("b._first") + F.col("b._before") + 1
    return held.alias("a").join(starts.alias("b"), same).select(*(F.col(f"a.`{c}`") for c in rows.columns), number.alias(name))
