"""Blocks of references are sent to many blocks of queries at once."""

import numpy as np

from cloudloom import ingest
from cloudloom.operators import pivots, pyramid


def test_tiles_find_the_same_and_send_less(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    pts = ingest.points(spark, [(i % 2, i, row.tolist()) for i, row in enumerate(x)])
    monkeypatch.setattr(pivots, "BLOCK", 16)
    vectors = pyramid.finite_points(pts, 12)
    p = pivots.choose(x[:200].astype(float))
    tree = pivots.build(vectors, 12, p, 4)
    pairs = pyramid.cut(pyramid.descend(tree, tree, True, lambda a, b, n: pivots.reachable(a, b, n, 4, 12)).select("batch", "q", "r", "near"))
    make = lambda ids, pos: pivots.PivotNearest(ids, pos, 4, p)
    got = [sorted(tuple(r) for r in pyramid.searched(tree, tree, pairs, make, tile=tile).collect()) for tile in (0, 3)]
    assert got[0] == got[1] and len(got[0]) == 3600
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2)
    d[(np.arange(900)[:, None] - np.arange(900)) % 2 == 1] = np.inf
    assert {(q, r) for _, q, r, _ in got[1]} == {(int(q), int(r)) for q in range(900) for r in np.argsort(d[q], kind="stable")[:4]}
    blocks = tree.blocks.count()
    assert pyramid._tiles(pairs, tree, tree, 3).count() - blocks < pairs.count() / 3
