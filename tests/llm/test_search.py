"""Exact top-k and nearest neighbours against brute force, with odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import ann, blocks, topk
from codesift.llm.ann import encode, nearest, one_bit, rotation
from codesift.llm.topk import nra, scaled, top_k

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 12)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(600)]
    odd = [(1000, None, "n"), (1001, [1.0, None], "n"), (1100, [NAN] * 12, "n"), (1200, [INF] + [0.0] * 11, "n"), (None, [1.0] * 12, "n"), (1300, [0.0] * 12, "z")]
    return x, frame(spark, rows + odd + rows[:3])


def distance(a, b):
    total = 0.0
    for u, v in zip(a, b):  # in order, without the compensation that sum() adds
        gap = float(u) - float(v)
        total += gap * gap
    return math.sqrt(total)


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_top_k_is_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP", 100)
    monkeypatch.setattr(blocks, "QUERIES", 2)
    x, df = vectors
    got = ranked(top_k(df.where(blocks.usable(F.col("embedding"))), scaled(F.col("embedding"))))
    codes = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    codes = {i: codes[i] for i in range(600)} | {1300: np.zeros(12, np.int64)}
    assert sorted(got) == [0, 100, 200, 300, 400, 500, 1300]
    for q, found in got.items():
        best = sorted(((-int(codes[q] @ codes[i]), i) for i in codes if i != q))[:10]
        assert found == [(i, -s) for s, i in best]


def test_bounds_hold_and_stop_early():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((400, 4)) * 100)
    q = np.floor(rng.standard_normal((5, 4)) * 100)
    exact = q @ x.T
    lists = np.sort(x, axis=0)
    width = None
    for depth in (10, 100, 200, 400):
        low, high = topk._bounds(q, x, depth, lists)
        assert (low <= exact).all() and (exact <= high).all()
        assert width is None or ((high - low) <= width).all()
        width = high - low
    assert (width == 0).all()


def test_top_k_small_and_empty(spark):
    df = frame(spark, [(0, [1.0, 2.0], "a"), (7, [0.5], "b"), (9, [], "c"), (100, [-1.0, 0.0], "d")])
    got = ranked(top_k(df, scaled(F.col("embedding"))))
    assert got[0] == [(7, 524288), (9, 0), (100, -1048576)]  # shorter vectors are padded with zeros
    assert len(got[100]) == 3
    assert top_k(frame(spark, []), scaled(F.col("embedding"))).collect() == []


def test_nearest_recall_and_scores(vectors, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP", 150)
    x, df = vectors
    got = ranked(nearest(df, F.col("embedding")))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]  # the zero vector takes no part
    hit = total = 0
    for q, found in got.items():
        d = {i: distance(x[q], x[i]) for i in range(600) if i != q}
        best = sorted((s, i) for i, s in d.items())[:10]
        assert all(s == d[i] for i, s in found)
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        hit += len({i for _, i in best} & {i for i, _ in found})
        total += 10
    assert hit / total >= 0.9


def test_codes_estimate_inner_products():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    turn = rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    centre, bits, length, fit = encode(x, turn)
    signs = (np.unpackbits(bits, axis=1, count=64) * 2.0 - 1) / 8
    estimate = ((q - centre) @ turn) @ signs.T / fit * length
    exact = (x - centre) @ (q - centre)
    bound = ann.ERROR * np.linalg.norm(q - centre) * length * np.sqrt((1 - fit**2) / fit**2 / 63)
    assert (np.abs(estimate - exact) <= bound).mean() > 0.99
    assert abs((estimate - exact).mean()) < 0.2


def test_nearest_fewer_candidates_and_equal_vectors(spark):
    df = frame(spark, [(0, [1.0, 1.0], "a"), (5, [1.0, 1.0], "b"), (3, [1.0, 1.0], "b"), (8, [2.0], "c")])
    assert ranked(nearest(df, F.col("embedding")))[0] == [(3, 0.0), (5, 0.0), (8, math.sqrt(2.0))]
    assert nearest(frame(spark, []), F.col("embedding")).collect() == []
    alone = (np.array([1]), np.ones((1, 2)), np.array([1]), np.ones((1, 2)))  # a query and itself
    assert nra(3)(*alone)[0].size == one_bit(3)(*alone)[0].size == 0
