"""Approximate nearest neighbours by randomly rotated one-bit codes.

A group's vectors are centred, scaled to unit length and rotated by a seeded random orthogonal matrix; a vector keeps
the signs of its rotated components as packed bits, its distance from the centre and the inner product of its unit
vector with its code (the correction). The bits estimate the inner product with a rotated query without bias; the
error is at most `ERROR` standard deviations of the bound sqrt((1 - c^2) / c^2 / (dim - 1)) times the query's length.
The best k by estimate are measured exactly; every vector whose lower bound is not beyond the k-th of these distances
is measured too. Every vector of every group is in the index. Recall is limited by the error bound only; it is
measured against brute force in the tests.

Scores are Euclidean distances of the original vectors in double precision, summed in the order of components.
Defined cases: vectors null, zero, empty, or holding null or non-finite components, take no part; shorter vectors are
padded with 0; of rows with the same id, the first in array order counts; rows without id take no part; ties go to
the smaller id; fewer than k candidates give them all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.blocks import one_per_id, search, usable

SEED = 7
ERROR = 3.0


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, packed sign bits, distances from the centre and corrections of the rows of `x`."""
    centre = x.mean(axis=0)
    off = x - centre
    length = np.sqrt((off * off).sum(axis=1))
    v = (off / np.where(length > 0, length, 1)[:, None]) @ turn
    fit = np.abs(v).sum(axis=1) / np.sqrt(x.shape[1])
    return centre, np.packbits(v > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def one_bit(k: int, error: float = ERROR, seed: int = SEED):
    def find(q_ids, queries, ids, x):
        n, dim = x.shape
        turn = rotation(dim, seed)
        centre, bits, length, fit = encode(x, turn)
        signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        off = queries - centre
        q_length = np.sqrt((off * off).sum(axis=1))
        inner = ((off @ turn).astype(np.float32) @ signs.T) / fit.astype(np.float32)
        spread = error * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, dim - 1))
        by_dim = np.ascontiguousarray(x.T)

        def measure(row, sel):
            total = np.zeros(len(sel))
            for d in range(dim):
                gap = by_dim[d, sel] - queries[row, d]
                total += gap * gap
            return np.sqrt(total)

        out = []
        for row in range(len(q_ids)):
            square = length * length + q_length[row] ** 2 - 2 * length * inner[row]
            square[ids == q_ids[row]] = np.inf
            first = np.argpartition(square, k - 1)[:k] if n > k else np.arange(n)
            reach = np.inf
            if n > k:
                reach = measure(row, first[np.isfinite(square[first])]).max(initial=0.0) ** 2
            lower = square - 2 * length * q_length[row] * spread
            sel = np.flatnonzero((lower <= reach * (1 + 1e-5) + 1e-9) & np.isfinite(square))
            score = measure(row, sel)
            best = np.lexsort((ids[sel], score))[:k]
            out.append((np.full(len(best), q_ids[row]), ids[sel][best], score[best]))
        q, i, s = zip(*out)
        return np.concatenate(q), np.concatenate(i), np.concatenate(s)

    return find


def nearest(rows: DataFrame, vector: Column, id_col: str = "vec_id", k: int = 10, every: int = 100, error: float = ERROR) -> DataFrame:
    """The `k` nearest other rows found for each row whose id is divisible by `every`."""
    nonzero = F.exists(vector, lambda x: x != 0)
    vectors = one_per_id(rows.where(usable(vector)).where(nonzero), id_col, vector)
    return search(vectors, F.col("id") % every == 0, one_bit(k, error), "double", k, ascending=True)


def op10(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("embedding"))


ORACLE = """
WITH raw AS (
  SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings),
parts AS (
  SELECT * FROM raw
  WHERE vec_id NOT IN (SELECT vec_id FROM raw WHERE c IS NULL OR NOT isfinite(c))
    AND vec_id IN (SELECT vec_id FROM raw WHERE c <> 0)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(sum((q.c - c.c) * (q.c - c.c) ORDER BY q.i)) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
