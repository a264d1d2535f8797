"""Distributed farthest points: the sample of one task, with fewer passes than samples."""

import random

import numpy as np
import pytest

from cloudloom.operators import sampling


def cloud(spark, rng, n, kind):
    p = {
        "uniform": lambda: [rng.random() for _ in range(3)],
        "lattice": lambda: [float(rng.randrange(6)) for _ in range(3)],
        "clusters": lambda: [rng.choice((0.0, 5.0, 50.0)) + rng.gauss(0, 0.1) for _ in range(3)],
        "line": lambda: [rng.random(), 0.0, 0.0],
    }[kind]
    return spark.createDataFrame([(i % 2, i // 2, p()) for i in range(n)], "batch long, idx long, pos array<float>")


@pytest.mark.parametrize("kind", ["uniform", "lattice", "clusters", "line"])
def test_identical_samples(spark, monkeypatch, kind):
    passes, plain = [], sampling.certain_picks
    monkeypatch.setattr(sampling, "certain_picks", lambda *a: passes.append(plain(*a)) or passes[-1])
    points = cloud(spark, random.Random(kind), 2_000, kind)
    got = {(r["batch"], r["slot"]): r["idx"] for r in sampling.distributed(points, 60, 3).collect()}
    want = {(r["batch"], r["slot"]): r["idx"] for r in sampling.furthest_point_sample(points, 60, 3).collect()}
    assert got == want
    if kind in ("uniform", "clusters"):  # many equal distances are seldom certain, and a line has few cells
        assert len(passes) / 2 < 60 / 4, len(passes)


def test_few_points_and_none(spark):
    points = cloud(spark, random.Random(0), 6, "uniform")
    want = {tuple(r) for r in sampling.furthest_point_sample(points, 5).collect()}
    assert {tuple(r) for r in sampling.distributed(points, 5).collect()} == want
    assert sampling.distributed(points, 0).count() == 0 and sampling.distributed(points, 1).count() == 2
    assert sampling.distributed(points.where("false"), 4).count() == 0


def test_a_pick_is_certain_only_beyond_all_bounds():
    """Against the whole cloud: every prefix of certain picks is the greedy one."""
    import pandas as pd

    rng = np.random.default_rng(3)
    for _ in range(30):
        p = rng.random((200, 3)).astype(np.float32)
        first = sampling.farthest(p, 6)
        least = np.min([sampling._squared(p, p[i]) for i in first], axis=0)
        cells = (p[:, 0] * 3).astype(int)
        box = pd.DataFrame([{"cell": c, "n": int((cells == c).sum()), **{f"{a}{s}": f(p[cells == c, k]) for k, a in enumerate("xyz") for s, f in ((0, np.min), (1, np.max))}} for c in range(3)])
        tops = np.concatenate([np.flatnonzero(cells == c)[np.lexsort((np.flatnonzero(cells == c), -least[cells == c]))][: sampling.TOPS] for c in range(3)])
        cand = pd.DataFrame({"cell": cells[tops], "idx": tops, "x": p[tops, 0], "y": p[tops, 1], "z": p[tops, 2], "least": least[tops]})
        picks = [int(cand.loc[r, "idx"]) for r in sampling.certain_picks(cand, box, 20)]
        assert picks == sampling.farthest(p, 6 + len(picks))[6:].tolist()
