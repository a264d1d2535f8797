"""Queries far outside a grid."""

import random

from cloudloom import ingest
from cloudloom.operators import rings
from cloudloom.operators.knn import knn


def test_far_queries_meet_no_rings(spark, monkeypatch):
    """To a query far away one ring holds the whole cloud, so its cells are never joined."""
    asked = []
    around = rings._around
    monkeypatch.setattr(rings, "_around", lambda active, *rest: asked.append(active.count()) or around(active, *rest))
    rng = random.Random(6)
    ref = ingest.points(spark, [(0, i, [float(rng.randrange(8)) for _ in range(3)]) for i in range(90)])
    far = [(0, i, [500.0 + rng.randrange(9), -500.0, float(rng.randrange(8))]) for i in range(20)]
    near = [(0, 100 + i, [float(rng.randrange(8)) for _ in range(3)]) for i in range(5)]
    for rows, met in ((far, 0), (far + near, 5)):
        asked.clear()
        q = ingest.points(spark, rows)
        got = sorted(tuple(r) for r in rings.grid_knn(q, ref, 3, 2.0).select("batch", "q", "slot", "ref", "dist").collect())
        assert got == sorted(tuple(r) for r in knn(q, ref, 3, drop_nonfinite=True).collect()) and max(asked, default=0) == met
