"""k-nearest neighbours by rings of grid cells."""

import random

import pytest

from cloudloom import ingest
from cloudloom.operators.knn import knn
from cloudloom.operators.rings import grid_knn


def cloud(spark, rng, n, shift=0.0, spread=10.0, odd=()):
    rows = [(b, i, [shift + rng.choice((rng.random() * spread, float(rng.randrange(int(spread))))) for _ in range(3)]) for b in (0, 1) for i in range(n)]
    return ingest.points(spark, rows + [(0, n + i, p) for i, p in enumerate(odd)])


def rows(df):
    return sorted(tuple(r) for r in df.select("batch", "q", "slot", "ref", "dist").collect())


def test_rings_equal_all_pairs(spark):
    rng = random.Random(25)
    odd = [[float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    ref = cloud(spark, rng, 120, odd=odd)
    inside, outside = cloud(spark, rng, 60, odd=odd), cloud(spark, rng, 30, shift=5000.0)
    for q, size, rings in ((inside, 2.0, None), (outside, 2.0, None), (inside, 0.5, ((0, 1),)), (inside, 50.0, None)):
        got = grid_knn(q, ref, 5, size, **({"rings": rings} if rings else {}))
        assert rows(got) == rows(knn(q, ref, 5, drop_nonfinite=True))
    few = ref.where("idx < 3")
    assert rows(grid_knn(inside, few, 5, 1.0)) == rows(knn(inside, few, 5, drop_nonfinite=True))


def test_rings_of_nothing(spark):
    ref = cloud(spark, random.Random(1), 5)
    assert grid_knn(ref.where("idx < 0"), ref, 2, 1.0).count() == 0
    assert grid_knn(ref, ref.where("idx < 0"), 2, 1.0).count() == 0
    with pytest.raises(ValueError):
        grid_knn(ref, ref, 2, 0.0)
    with pytest.raises(ValueError):
        grid_knn(ref, ref, 2, 1e-9)
