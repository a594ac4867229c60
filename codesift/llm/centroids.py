"""Centroid clustering over a VA-file: exact k-means rounds on integer vectors, decided by few-bit codes.

Each dimension is divided into 2^BITS cells at quantiles of all vectors. A vector's code names its cells; the code and
the vector's exact squared norm (about a middle point) are the approximation file, a table of its own. For a set of
centroids a lookup table holds, for each dimension, cell and centroid, the least and the greatest of c^2 - 2 c x over
the cell. Added up over the dimensions, with the norm, they give an interval that holds the exact squared distance. A
centroid whose interval begins behind the end of another's is out. What is left is compared with the centroid whose
interval ends first, by the interval of the difference of the two distances (linear in x, so its ends lie at the ends
of the cells), which is narrower than the two apart. A vector with one centroid left is decided by its code alone, and
only the others have their full vectors fetched, for the exact distance to the centroids left.

A round needs the sums of each cluster's vectors. The first one reads all vectors. Later rounds read the codes, look
which vectors are decided alike for the old and the new centroids, and fetch the others by a join on the row number:
those move the sums. If few are fetched, Spark broadcasts their numbers (it knows the written table's size) and the
vectors are not shuffled. No assignment is kept between rounds, so a lost executor costs a re-read of stored tables.
The last pass reads all vectors, as every one's distance is asked for, and computes it for the centroids left only.

All sums are integers, so partitions and order make no difference. Each batch of rows adds up its clusters before the
shuffle; what the driver collects is one row a cluster, and one row of quantiles.

Defined cases: a vector takes part if it has exactly `dims` components, none null or non-finite, and none that exceeds
2^26 when scaled (a long could not hold its distance); others are left out. Every row is a vector, so repeated rows
count as often as they stand there; a null id takes part, and comes last among the first centroids. Ties go to the
smaller centroid. With fewer vectors than centroids all are centroids; without vectors the result is empty. Equal
vectors give equal centroids, of which the larger ones stay empty and where they are. An inertia that exceeds a long is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.blocks import usable
from codesift.llm.common import stored

#: Centroids, rounds, bits of a cell (at most 8), and the relative error of a cell's quantile as 1 / ACCURACY.
CENTROIDS, ROUNDS, BITS, ACCURACY = 40, 5, 7, 1000
#: Components of a vector, the scale of its integers, and the largest integer.
DIMS, SCALE, LARGEST = 64, 256, 1 << 26

_SUMS = "cluster int, n long, total array<long>"


@dataclass(frozen=True)
class Cells:
    """Of each dimension: the cells' upper ends (all but the last), the least and the greatest value, a middle one."""

    ends: list[np.ndarray]
    least: np.ndarray
    greatest: np.ndarray
    middle: np.ndarray
    bits: int

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, d]) for d, e in enumerate(self.ends)], axis=1).astype(np.uint8)

    def norms(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.middle) ** 2).sum(axis=1)

    def ends_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest vector with these codes, about the middle."""
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for d, ends in enumerate(self.ends):
            low[:, d] = np.append(self.least[d], ends + 1)[codes[:, d]] - self.middle[d]
            high[:, d] = np.append(ends, self.greatest[d])[codes[:, d]] - self.middle[d]
        return low, high

    def table(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, centroid) -> the least and the greatest of c^2 - 2 c x over the cell, about the middle."""
        n = 1 << self.bits
        low, high = np.zeros((2, len(self.ends), n, len(centroids)), np.int64)
        for d, ends in enumerate(self.ends):
            c = (centroids[:, d] - self.middle[d])[None, :]
            first = (np.append(self.least[d], ends + 1) - self.middle[d])[:, None]
            last = (np.append(ends, self.greatest[d]) - self.middle[d])[:, None]
            sides = np.sort(np.stack([c * c - 2 * c * first, c * c - 2 * c * last]), axis=0)
            low[d, : len(ends) + 1], high[d, : len(ends) + 1] = sides
        return low, high


def packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of `bits` bits each, a row of bytes for a row of codes."""
    return np.packbits(np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(codes), -1), axis=1)


def unpacked(rows: np.ndarray, dims: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(rows), dims, 8), np.uint8)
    wide[:, :, 8 - bits :] = np.unpackbits(rows, axis=1, count=dims * bits).reshape(len(rows), dims, bits)
    return np.packbits(wide, axis=2)[:, :, 0]


def left(codes: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, centroid) -> True for the centroids that no other's interval excludes; and whose interval ends first."""
    least = np.repeat(norms[:, None], low.shape[2], axis=1)
    most = least.copy()
    for d in range(codes.shape[1]):
        least += low[d, codes[:, d]]
        most += high[d, codes[:, d]]
    return least <= most.min(axis=1, keepdims=True), most.argmin(axis=1)


def closer(cells: Cells, codes: np.ndarray, some: np.ndarray, best: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """`some` without the centroids that are farther than `best` wherever in its cells a vector lies."""
    row, c = np.nonzero(some & (some.sum(axis=1) > 1)[:, None])
    other = c != best[row]
    row, c = row[other], c[other]
    about = centroids - cells.middle
    low, high = cells.ends_of(codes[row])
    slope = -2 * (about[c] - about[best[row]])
    square = (about**2).sum(axis=1)
    nearer = np.minimum(slope * low, slope * high).sum(axis=1) + square[c] - square[best[row]] <= 0
    out = some.copy()
    out[row[~nearer], c[~nearer]] = False
    return out


def candidates(cells: Cells, centroids: np.ndarray):
    """A function of codes and norms: (vector, centroid) -> whether the centroid may be the vector's nearest."""
    low, high = cells.table(centroids)
    return lambda codes, norms: closer(cells, codes, *left(codes, norms, low, high), centroids)


def nearest_of(v: np.ndarray, centroids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid among `some`, the smaller number of equal ones, and its squared distance."""
    row, c = np.nonzero(some)
    exact = ((v[row] - centroids[c]) ** 2).sum(axis=1)
    all_of = np.full(some.shape, np.iinfo(np.int64).max)
    all_of[row, c] = exact
    best = all_of.argmin(axis=1)
    return best, all_of[np.arange(len(v)), best]


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _pieces(batches, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _total(clusters: np.ndarray, v: np.ndarray, sign: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the vectors of each cluster, times `sign`."""
    n, total = np.zeros(k, np.int64), np.zeros((k, v.shape[1]), np.int64)
    np.add.at(n, clusters, sign)
    np.add.at(total, clusters, sign * v)
    return n, total


def _sums(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(n | total.any(axis=1))
    ends = np.arange(len(some) + 1, dtype=np.int32) * total.shape[1]
    totals = pa.ListArray.from_arrays(pa.array(ends), pa.array(total[some].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), totals], ["cluster", "n", "total"])


def integers(rows: DataFrame, id_col: str, vector: Column, dims: int, scale: int) -> DataFrame:
    """(r, id, v): the vectors that take part, as integers, with a row number that stays."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("x"), whole.alias("v")).where(
        usable(F.col("x")) & (F.size("x") == dims) & ~F.exists("v", lambda c: F.abs(c) > LARGEST)
    )
    return stored(kept.select(F.monotonically_increasing_id().alias("r"), "id", F.col("v").cast("array<int>").alias("v")))


def cells_of(vectors: DataFrame, dims: int, bits: int) -> Cells:
    """Cells at quantiles of every vector's components: one aggregation to one row."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    of = [F.col("v")[d] for d in range(dims)]
    row = vectors.agg(
        F.array(*(F.min(x) for x in of)), F.array(*(F.max(x) for x in of)), F.array(*(F.percentile_approx(x, shares, ACCURACY) for x in of))
    ).first()
    least, greatest = np.array(row[0], np.int64), np.array(row[1], np.int64)
    ends = [np.unique([q for q in row[2][d] if q < greatest[d]]).astype(np.int64) for d in range(dims)]
    middle = np.array([q[len(q) // 2] for q in row[2]], np.int64)
    return Cells(ends, least, greatest, middle, bits)


def approximations(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(r, code, norm): the VA-file."""

    def run(batches):
        for b in _pieces(batches):
            v = _matrix(b.column(1), b.num_rows, np.int64)
            codes = packed(cells.codes(v), cells.bits)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cells.norms(v))], ["r", "code", "norm"]
            )

    return stored(vectors.select("r", "v").mapInArrow(run, "r long, code binary, norm long"))


def to_fetch(approx: DataFrame, cells: Cells, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """(r, was, now): the vectors that the codes do not put into one cluster before and after, with the centroids left."""
    dims = before.shape[1]

    def run(batches):
        old, new = candidates(cells, before), candidates(cells, after)
        for b in _pieces(batches):
            codes = unpacked(_matrix(b.column(1), b.num_rows, np.uint8), dims, cells.bits)
            norms = b.column(2).to_numpy()
            was, now = old(codes, norms), new(codes, norms)
            at = np.flatnonzero((was.sum(axis=1) > 1) | (now != was).any(axis=1))
            masks = [pa.array([m.tobytes() for m in np.packbits(x[at], axis=1)], pa.binary()) for x in (was, now)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *masks], ["r", "was", "now"])

    return stored(approx.mapInArrow(run, "r long, was binary, now binary"))


def moved(fetched: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """Sums over the fetched vectors (v, was, now): added to the new cluster, taken from the old one."""
    k = len(before)

    def run(batches):
        for b in _pieces(batches):
            v = _matrix(b.column(0), b.num_rows, np.int64)
            was, now = (np.unpackbits(_matrix(c, b.num_rows, np.uint8), axis=1, count=k).astype(bool) for c in b.columns[1:])
            old, new = nearest_of(v, before, was)[0], nearest_of(v, after, now)[0]
            at = np.flatnonzero(old != new)
            (n, total), (m, less) = _total(new[at], v[at], 1, k), _total(old[at], v[at], -1, k)
            yield _sums(n + m, total + less)

    return fetched.select("v", "was", "now").mapInArrow(run, _SUMS)


def first_sums(vectors: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        some = candidates(cells, centroids)
        for b in _pieces(batches):
            v = _matrix(b.column(0), b.num_rows, np.int64)
            near, _ = nearest_of(v, centroids, some(cells.codes(v), cells.norms(v)))
            yield _sums(*_total(near, v, 1, len(centroids)))

    return vectors.select("v").mapInArrow(run, _SUMS)


def assigned(vectors: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches):
        some = candidates(cells, centroids)
        for b in _pieces(batches):
            v = _matrix(b.column(1), b.num_rows, np.int64)
            near, distance = nearest_of(v, centroids, some(cells.codes(v), cells.norms(v)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.select("id", "v").mapInArrow(run, "id long, cluster int, distance long")


def _collected(sums: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """One row a cluster, at most `k`."""
    n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    each = F.array(*(F.sum(F.col("total")[d]) for d in range(dims))).alias("total")
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), each).collect():
        n[r["cluster"]], total[r["cluster"]] = r["n"], r["total"]
    return n, total


def clusters(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    bits: int = BITS,
    seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, written to the shared folder, and the last centroids.

    The first centroids are the vectors with the smallest sha256 of `<seed>:<id>`.
    """
    vectors = integers(rows, id_col, F.col(vector), dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    drawn = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not drawn:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.empty((0, dims), np.int64)
    centroids = np.array([r["v"] for r in drawn], np.int64)
    cells = cells_of(vectors, dims, bits)
    approx = approximations(vectors, cells)
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    before = None
    for _ in range(rounds):
        if before is None:
            sums = first_sums(vectors, cells, centroids)
        else:
            sums = moved(to_fetch(approx, cells, before, centroids).join(vectors, "r"), before, centroids)
        n_more, more = _collected(sums, len(centroids), dims)
        n, total, before = n + n_more, total + more, centroids
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
    return stored(assigned(vectors, cells, centroids)), centroids


def summary(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, cluster_inertia, inertia, centroid_sha256) for each centroid that has vectors: one row each."""
    by = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    known = [r["cluster_inertia"] for r in by]
    whole = None if None in known or sum(known) >= 1 << 63 else sum(known)
    rows = [
        (r["cluster"], r["cluster_inertia"], whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in by
    ]
    return found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def op12(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    # As many rows as there are centroids.
    return found.join(F.broadcast(summary(found, centroids)), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


_ROUND = r"""
d{i} AS (
  SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{i} c ON v.j = c.j GROUP BY ALL),
a{i} AS (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{i} GROUP BY r),"""
_UPDATE = r"""
c{n} AS (
  SELECT old.c, old.j, CASE WHEN s.n IS NULL THEN old.x ELSE (s.total - ((s.total % s.n) + s.n) % s.n) // s.n END AS x
  FROM c{i} old LEFT JOIN (SELECT a.c, v.j, sum(v.x) AS total, count(*) AS n FROM a{i} a JOIN v USING (r) GROUP BY ALL) s
    ON s.c = old.c AND s.j = old.j),"""
ORACLE = (
    r"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(CAST(y AS DOUBLE)))) = 64),
v AS (SELECT r, j, CAST(floor(CAST(e[j] AS DOUBLE) * 256) AS BIGINT) AS x FROM (SELECT r, e, unnest(range(1, 65)) AS j FROM kept)),
starts AS (
  SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c FROM kept
  QUALIFY c < 40),
c0 AS (SELECT s.c, v.j, v.x FROM starts s JOIN v USING (r)),"""
    + "".join(_ROUND.format(i=i) + _UPDATE.format(i=i, n=i + 1) for i in range(5))
    + _ROUND.format(i=5)
    + r"""
hashes AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j)) AS h FROM c5 GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM kept k JOIN a5 a USING (r) JOIN hashes h ON h.c = a.c
"""
)
