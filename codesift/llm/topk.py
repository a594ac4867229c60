"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

A group of vectors keeps one list a dimension, sorted by component. For a query, the lists of its positive components
are read from the top and those of its negative ones from the bottom, all to the same depth. At a depth, a component
that has been read counts with its value; one not yet read lies between the frontier (upper bound) and the list's end
(lower bound). Vectors whose upper bound is below the k-th best lower bound cannot qualify; when few are left, or the
lists are read through, the scores of those left are resolved exactly. As lists are read in lockstep, the bounds of
all queries of a block are four matrix products a depth. Every group returns its exact best k, and the best k of
these are the result, so no bound of one group is needed in another.

Scores are integer inner products of integer components, exact in 64 bits. Defined cases: vectors null, or holding
null or non-finite components, take no part; shorter vectors are padded with 0; an empty vector scores 0 with all;
of rows with the same id, the first in array order counts; rows without id take no part; ties go to the smaller id;
fewer than k candidates give them all; components saturate at +-2^27 after scaling; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.blocks import one_per_id, search, usable

LIMIT = float(1 << 27)
#: Parts of the lists that are read before the bounds are compared.
DEPTHS = (0.125, 0.5, 1.0)


def _bounds(q: np.ndarray, x: np.ndarray, depth: int, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores after reading `depth` entries of each list (columns of `lists`, ascending)."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low_end, high_end = lists[0], lists[-1]
    from_top, from_bottom = lists[-depth], lists[depth - 1]
    lower = up @ np.where(x >= from_top, x, low_end).T + down @ np.where(x <= from_bottom, x, high_end).T
    upper = up @ np.maximum(x, from_top).T + down @ np.minimum(x, from_bottom).T
    return lower, upper


def nra(k: int):
    def find(q_ids, queries, ids, x):
        n, dim = x.shape
        lists = np.sort(x, axis=0)
        slack = float(np.abs(queries).max(initial=0) * np.abs(x).max(initial=0) * dim) * dim * 2.0**-50
        whole = x.astype(np.int64)
        active, out = np.arange(len(q_ids)), []
        for depth in dict.fromkeys(max(1, round(n * part)) for part in DEPTHS):
            if not len(active):
                break
            lower, upper = _bounds(queries[active], x, depth, lists)
            own = q_ids[active][:, None] == ids[None, :]
            lower[own] = upper[own] = -np.inf
            worst = np.partition(lower, -k, axis=1)[:, -k] if n > k else np.full(len(active), -np.inf)
            left = (upper + slack >= worst[:, None] - slack) & ~own
            done = (left.sum(axis=1) <= 8 * k) | (depth == n)
            for row in np.flatnonzero(done):
                sel = np.flatnonzero(left[row])
                score = whole[sel] @ queries[active[row]].astype(np.int64)
                best = np.lexsort((ids[sel], -score))[:k]
                out.append((np.full(len(best), q_ids[active[row]]), ids[sel][best], score[best]))
            active = active[~done]
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate([empty, *x]) for x in zip(*out)) if out else (empty, empty, empty)

    return find


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as a double that holds the integer."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * scale).cast("double"))))


def top_k(rows: DataFrame, vector: Column, id_col: str = "vec_id", k: int = 10, every: int = 100) -> DataFrame:
    """The `k` best other rows of each row whose id is divisible by `every`, by inner product of integer `vector`s."""
    return search(one_per_id(rows, id_col, vector), F.col("id") % every == 0, nra(k), "long", k, ascending=False)


def op1(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(usable(F.col("embedding")))
    return top_k(rows, scaled(F.col("embedding")))


ORACLE = """
WITH raw AS (
  SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
parts AS (
  SELECT vec_id, i, floor(1024 * x)::BIGINT AS c FROM raw
  WHERE vec_id NOT IN (SELECT vec_id FROM raw WHERE x IS NULL OR NOT isfinite(x))),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.c * c.c)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
