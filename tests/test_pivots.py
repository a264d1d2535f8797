"""Feature search by pivot distances against comparing all pairs, and what it leaves out on clustered vectors."""

import numpy as np
import pytest

from cloudloom.operators import knn, pivots, pruned, pyramid

SCHEMA = "batch long, idx long, pos array<float>"


def frame(spark, x, batches=1):
    return spark.createDataFrame([(i % batches, i, [float(v) for v in p]) for i, p in enumerate(x)], SCHEMA)


def clusters(rng, n, width, count):
    centre = rng.normal(0, 10, (count, width))
    return (centre[rng.integers(0, count, n)] + rng.normal(0, 0.3, (n, width))).astype(np.float32)


def want(x, y, k, batches=1):
    d = pyramid.distances(x, y, 2)
    same = np.arange(len(x))[:, None] % batches == np.arange(len(y))[None] % batches
    out = set()
    for i, row in enumerate(d):
        own = np.flatnonzero(same[i] & np.isfinite(row))
        order = own[np.lexsort((own, row[own]))][:k]
        out |= {(i % batches, i, s, int(j), float(np.sqrt(row[j]))) for s, j in enumerate(order)}
    return out


@pytest.mark.parametrize(("width", "k", "batches"), [(12, 3, 1), (64, 5, 3), (5, 300, 2)])
def test_same_rows_as_all_pairs(spark, monkeypatch, width, k, batches):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pruned, "SCAN", 0)
    rng = np.random.default_rng(width)
    y = np.concatenate([clusters(rng, 250, width, 6), rng.integers(-2, 3, (120, width)).astype(np.float32)])
    y[40:80] = y[7]
    x = np.concatenate([y[:60], rng.normal(0, 30, (40, width)).astype(np.float32)])
    got = {tuple(r) for r in knn.knn(frame(spark, x, batches), frame(spark, y, batches), k, width).collect()}
    assert got == want(x, y, k, batches)


def test_odd_vectors(spark):
    rows = [(0, 0, [0.0] * 9), (0, 1, [float("nan")] + [0.0] * 8), (0, 2, [float("inf")] + [0.0] * 8), (0, 3, [3e38] * 9), (None, 4, [0.0] * 9), (1, 5, [1.0] * 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["q"], r["ref"]) for r in knn.knn(df, df, 4, 9).collect()}
    assert got == {(0, 0), (3, 3), (5, 5)}
    assert knn.knn(df.where("false"), df, 4, 9).count() == 0 == knn.knn(df, df.where("false"), 4, 9).count()


def test_compared_share_falls_on_clusters(spark):
    rng = np.random.default_rng(4)
    share = []
    for n in (2_000, 8_000):
        df = frame(spark, clusters(rng, n, 32, n // 250))
        share.append(pyramid.mean_compared(pivots.nearest(df, df, 4, 32, count=True)) / n)
    assert share[0] < 0.7 and share[1] < 0.5 * share[0], share
