"""Farthest points by boxes, and clouds with many points in a place."""

import numpy as np

from cloudloom import ingest
from cloudloom.operators import sampling


def test_boxes_give_the_plain_sample():
    rng = np.random.default_rng(4)
    for p in (rng.random((6000, 3)), rng.integers(0, 9, (6000, 3)) / 8, np.repeat(rng.integers(0, 3, (40, 3)), 50, axis=0), np.zeros((500, 3))):
        for skip, start in ((False, 0), (True, 7)):
            got, compared = sampling.farthest_in_boxes(p, 300, start, skip)
            assert got.tolist() == sampling.farthest(p, 300, start, skip).tolist()
            assert compared < 0.35 * 300 * len(p)


def test_copies_stay_out_of_the_sampling_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 4, (900, 3)).astype(float)
    pts = ingest.points(spark, [(b, 10 * i + b, row.tolist()) for b in (0, 1) for i, row in enumerate(p)])
    for start in (0, 333, 901):
        got = {(r["batch"], r["slot"]): r["idx"] for r in sampling.furthest_point_sample(pts, 80, start).collect()}
        assert got == {(b, s): 10 * i + b for b in (0, 1) for s, i in enumerate(sampling.farthest(p, 80, start % 900).tolist())}
    plan = sampling.furthest_point_sample(pts, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [batch" in plan
