"""Copies of points are not searched for, nor among, one by one."""

import random

import pytest
from pyspark.sql import functions as F

from cloudloom import ingest
from cloudloom.operators import index, knn, loss, pruned, pyramid


def test_searches_ask_once_per_place(spark, monkeypatch):
    sizes = []
    nearest = pyramid.nearest
    spy = lambda q, r, *rest, **named: sizes.append((q.size, r.size)) or nearest(q, r, *rest, **named)
    rng = random.Random(12)
    rows = [(0, i, [float(rng.randrange(3)), float(rng.randrange(2)), 0.5]) for i in range(240)]
    pts, ref = ingest.points(spark, rows), ingest.points(spark, [(0, i, [1.25 + i % 5, 0.5, 0.0]) for i in range(40)])
    size = lambda df: df.groupBy("batch").agg(F.count("*").alias("n"))
    plain = sorted(tuple(r) for r in knn.knn(pts, ref, 3).collect())
    d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    there, back = ([min(d2(p, q) for q in qs) for p in ps] for ps, qs in (([p for *_, p in rows], [[1.25 + i, 0.5, 0.0] for i in range(5)]), ([[1.25 + i % 5, 0.5, 0.0] for i in range(40)], [p for *_, p in rows])))
    monkeypatch.setattr(pruned, "SCAN", 0)
    monkeypatch.setattr(pruned, "nearest", spy)
    monkeypatch.setattr(pyramid, "nearest", spy)
    for got in (knn.knn(pts, ref, 3), index.SpatialIndex.build(ref, "blocks").knn(pts, 3)):
        assert sorted(tuple(r) for r in got.select("batch", "q", "slot", "ref", "dist").collect()) == plain
    assert [q for q, _ in sizes] == [6, 6]
    sizes.clear()
    got = loss.chamfer_distance(pts, ref, size(pts), size(ref)).first()[0]
    assert got == pytest.approx(sum(there) / 240 + sum(back) / 40, abs=1e-6) and sizes == [(6, 5), (5, 6)]
