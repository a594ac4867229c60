"""A stated query set against all vectors, in blocks of bounded size.

Candidates are folded to one vector an id, dealt into groups by a hash of the id and packed, some 8,192 a group, into
one row a group. Queries are packed the same way, 512 a block, and each block meets each group once: the query blocks
(a hundredth of the rows) are repeated for the groups, the candidates are shuffled once. Every task holds one group
and one block of queries at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.llm.common import stored

GROUP, QUERIES = 8192, 512


def usable(vector: Column) -> Column:
    """True for a vector without nulls, NaN and infinities; false for null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def one_per_id(rows: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """(id, v) with one usable vector an id; of several, the first in array order. Rows without an id go."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return v.groupBy("id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, n: int, size: int) -> DataFrame:
    """(id, v) -> (g, ids, data, dim): about `size` vectors a row as bytes of int64 and float64, shorter ones padded with 0."""
    groups = max(1, math.ceil(n / size))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        dim = int(pdf["v"].map(len).max())
        data = np.zeros((len(pdf), dim))
        for i, v in enumerate(pdf["v"]):
            data[i, : len(v)] = v
        return pd.DataFrame({"g": [key[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()], "dim": [dim]})

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInPandas(pack, "g int, ids binary, data binary, dim int")


def unpack(ids: bytes, data: bytes, dim: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    out = np.zeros((len(own), to))
    out[:, :dim] = np.frombuffer(data).reshape(len(own), dim)
    return own, out


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search(vectors: DataFrame, is_query: Column, find: Search, score_type: str, k: int, ascending: bool) -> DataFrame:
    """(id, v) -> (query_id, rank, vec_id, score), the best `k` of each query, ties to the smaller id.

    `find(query ids, queries, ids, vectors)` returns arrays (query id, id, score) with each query's best `k` of the group.
    """
    vectors = stored(vectors)
    queries = vectors.where(is_query)
    n, n_queries = vectors.count(), queries.count()
    groups = packed(vectors, n, GROUP)
    spread = max(1, math.ceil(n / GROUP))
    blocks = packed(queries, n_queries, QUERIES).select(
        F.col("g").alias("b"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim")
    )
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    pairs = groups.hint("shuffle_merge").join(blocks, "g")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in pdf.itertuples():
            dim = max(r.dim, r.q_dim)
            parts.append(find(*unpack(r.q_ids, r.q_data, r.q_dim, dim), *unpack(r.ids, r.data, r.dim, dim)))
        q, i, s = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    # One group meets one block in each call; the join has already dealt the rows by group.
    found = pairs.groupBy("g", "b").applyInPandas(meet, f"query_id long, vec_id long, score {score_type}")
    score = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
