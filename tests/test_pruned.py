"""Pruned searches against comparing all pairs, over clouds that are dense, sparse, repeated or not finite in places."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import metric as m
from cloudloom.operators import knn, pruned, pyramid


def cloud(spark, rng, n, first=0, odd=()):
    rows = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            p = [rng.uniform(-100, 100) for _ in range(3)]
        elif kind == 1:
            p = [rng.gauss(7, 1e-3) for _ in range(3)]
        elif kind == 2:
            p = [1.5, -2.5, 3.5]
        else:
            p = [float(rng.randrange(-3, 4)) for _ in range(3)]
        rows.append((rng.randrange(2), first + i, p))
    rows += [(0, first + n + k, list(p)) for k, p in enumerate(odd)]
    return spark.createDataFrame(rows, "batch long, idx long, pos array<float>")


@pytest.mark.parametrize(("k", "dim", "norm"), [(1, 3, 2), (4, 3, 2), (3, 2, 2), (2, 1, 2), (1, 3, 1)])
def test_candidates_hold_the_nearest(spark, monkeypatch, k, dim, norm):
    monkeypatch.setattr(pruned, "SCAN", 0)
    rng = random.Random(k)
    nan, inf = float("nan"), float("inf")
    odd = [(nan, 0.0, 0.0), (inf, 0.0, 0.0), (3e38, 0.0, 0.0), (0.0, -inf, 1.0)]
    x, y = cloud(spark, rng, 300, odd=odd), cloud(spark, rng, 400, odd=odd)
    top = lambda df: {tuple(r) for r in knn.smallest(df.where(~F.isnan("d")), k).collect()}
    every = pruned.pairs(x, y, dim, m.d2 if norm == 2 else m.l1)
    found = pruned.candidates(x, y, k, dim, norm)
    assert top(found) == top(every)
    assert not found.groupBy("batch", "q", "ref").count().where("count > 1").count()
    turned = {tuple(r) for r in knn.smallest(every.where(~F.isnan("d") & m.finite(F.col("d"))).withColumn("ref", -F.col("ref")), k).collect()}
    other = pruned.candidates(x, y, k, dim, norm, rank=-F.col("idx"), infinite=False).where(m.finite(F.col("d")))
    assert {tuple(r) for r in knn.smallest(other.withColumn("ref", -F.col("ref")), k).collect()} == turned


def uniform(spark, n, seed, shift=0.0, batches=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i % batches, i, [shift + rng.random(), rng.random(), rng.random()]) for i in range(n)], "batch long, idx long, pos array<float>")


@pytest.mark.parametrize("shift", [0.0, 20.0])
def test_compared_points_do_not_grow(spark, shift):
    """Queries in the cloud, and twenty extents away: exact rows, and about as many comparisons at each size."""
    per = []
    for n in (1_000, 8_000):
        x, y = (pyramid.Pyramid.build(pyramid.finite_points(uniform(spark, n, s, t), 3), 3, 4) for s, t in ((1, shift), (2, 0.0)))
        per.append(pyramid.compared(x, y, 4))
        if n == 1_000:
            every = knn.smallest(pruned.pairs(uniform(spark, n, 1, shift), uniform(spark, n, 2), 3), 4).drop("slot")
            assert {tuple(r) for r in pyramid.nearest(x, y, 4).collect()} == {tuple(r) for r in every.collect()}
    assert per[1] < 1.6 * per[0] + 100 and per[1] < 0.1 * 8_000


def test_repeated_places_and_many_batches(spark, monkeypatch):
    """A third of all points at one place, clouds of few points, clouds without references, and more asked than there are."""
    monkeypatch.setattr(pruned, "SCAN", 0)
    rng = random.Random(5)
    rows = [(0, i, [0.5, 0.5, 0.5]) for i in range(700)] + [(0, 700 + i, [rng.random() for _ in range(3)]) for i in range(1300)]
    rows += [(1 + i % 60, 2000 + i, [float(rng.randrange(3)) for _ in range(3)]) for i in range(240)]
    y = spark.createDataFrame(rows, "batch long, idx long, pos array<float>")
    x = spark.createDataFrame([(r[0] + r[1] % 2, r[1], r[2]) for r in rows[::3]] + [(99, 1, [0.0, 0.0, 0.0]), (None, 2, [0.0, 0.0, 0.0])], "batch long, idx long, pos array<float>")
    for k in (1, 7, 80):
        want = {tuple(r) for r in knn.smallest(pruned.pairs(x, y, 3), k).collect()}
        assert {tuple(r) for r in knn.smallest(pruned.candidates(x, y, k, 3), k).collect()} == want
    own = {tuple(r) for r in knn.smallest(pruned.pairs(y, y, 3), 3).collect()}
    assert {tuple(r) for r in knn.smallest(pruned.candidates(y, y, 3, 3), 3).collect()} == own


def test_margin_is_the_greatest_difference():
    """The closed form against a fine grid of places in the box of queries."""
    rng = np.random.default_rng(0)
    for norm in (1, 2):
        for _ in range(60):
            q, b = (np.sort(rng.normal(0, 2, (2, 2)), axis=0) for _ in range(2))
            r = np.sort(rng.normal(0, 2, (5, 2, 2)), axis=1)
            got = pyramid.margin(q, b, r, norm)
            axis = [np.linspace(q[0, i], q[1, i], 300) for i in range(2)]
            power = (lambda v: v * v) if norm == 2 else (lambda v: v)
            for j in range(5):
                best = sum((power(np.maximum(t - b[0, i], b[1, i] - t)) - power(np.maximum(np.maximum(r[j, 0, i] - t, t - r[j, 1, i]), 0))).max() for i, t in enumerate(axis))
                assert best - 1e-3 <= got[j] <= best + 0.2
