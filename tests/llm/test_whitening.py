"""Whitening against dense linear algebra and exact integers."""

import numpy as np
import pytest

from tidemark.llm import whitening as w

SF = "/root/testdata/sf0.01"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "matrix",
    [
        symmetric(np.linspace(1, 9, 24)),
        symmetric([5.0] * 6 + [1.0] * 6),
        symmetric([1e9, 1e9 - 1e-3, 3.0, 2.0, 1e-9, 0.0, 0.0]),
        np.diag([3.0, 1.0, 2.0, 2.0]),
        np.array([[2.0, 1.0], [1.0, 2.0]]),
        np.array([[4.0]]),
        np.zeros((5, 5)),
        np.cov(np.random.default_rng(1).standard_normal((64, 5000))),
        np.diag([2.0] * 21) + np.diag([1.0] * 20, 1) + np.diag([1.0] * 20, -1),
        np.diag(np.abs(np.arange(-10.0, 11))) + np.diag([1.0] * 20, 1) + np.diag([1.0] * 20, -1),
    ],
)
def test_eigenpairs_equal_dense_ones(matrix):
    k = min(len(matrix), 20)
    values, vectors = w.leading_eigenpairs(matrix, k)
    norm = max(np.abs(matrix).sum(1).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=0, atol=1e-13 * norm)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * norm
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def brute(vectors, k=w.COMPONENTS):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    z = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, z @ q / np.sqrt(e), e / (z**2).sum() * n


def test_query_equals_brute_force(spark):
    found = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, white, explained = brute([v for _, v in found])
    rows = w.op12_whitening(spark, SF).orderBy("vec_id", "component").collect()
    assert len(rows) == n * w.COMPONENTS
    got = np.array([r.whitened for r in rows]).reshape(n, -1)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-7
    assert [r.deviation for r in rows[:: w.COMPONENTS]] == deviation and {r.n for r in rows} == {n}
    assert np.allclose([r.explained for r in rows[: w.COMPONENTS]], explained, rtol=1e-10)
    assert max(r.identity_error for r in rows) < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((40, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1.0, 2.0]]
    rows = [(i, v, 7, "x") for i, v in enumerate([*good, *bad, good[0]])] + [(None, good[1], 7, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened string")
    n, deviation, white, _ = brute([*good, good[0], good[1]])
    got = w.whiten(df).collect()
    assert len(got) == n == 42 and sum(r.vec_id is None for r in got) == 1
    assert sorted(int(r.deviation) for r in got) == sorted(deviation)
    assert all(len(r.whitened) == 3 and r.identity_error < 1e-9 for r in got)
    assert w.whiten(df.filter("false")).count() == 0
    same = w.whiten(df.filter("vec_id = 0 or vec_id = 46")).collect()
    assert [(int(r.deviation), r.whitened, r.identity_error) for r in same] == [(0, [], 0.0)] * 2


def test_far_off_mean_and_large_entries(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((50, 4)) + 1e9).tolist()
    got = w.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    n, deviation, white, explained = brute(vectors)
    assert [int(r.deviation) for r in got] == deviation
    assert np.allclose(got[0].explained, explained, rtol=1e-6) and got[0].identity_error < 1e-9
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert w.whiten(huge).count() == 2
