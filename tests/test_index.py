"""The lasting index: written once, opened by path, searched in part; its searches against comparing all pairs."""

import random
import tempfile

import pytest

from cloudloom.operators import index, knn, pruned, pyramid, radius


def points(spark, n, seed, lo=0.0, hi=1.0, batches=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(i % batches, i, [rng.uniform(lo, hi) for _ in range(3)]) for i in range(n)], "batch long, idx long, pos array<float>")




def rows(df):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


def test_written_index_serves_many_searches(spark, monkeypatch):
    monkeypatch.setattr(pruned, "SCAN", 0)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    cloud, asked = points(spark, 3_000, 1), points(spark, 400, 2, -0.5, 1.5)
    built = index.SpatialIndex.build(cloud, path=path, block=16)
    again = index.SpatialIndex.open(spark, path)
    assert again.size == built.size == 3_000 and rows(again.points) == rows(cloud)
    want = rows(knn.knn(asked, cloud, 3))
    assert rows(built.knn(asked, 3)) == want and rows(again.knn(asked, 3)) == want
    assert rows(again.knn(asked, 40)) == rows(knn.knn(asked, cloud, 40))  # more than ``front``
    balls = index.SpatialIndex.open(spark, path, "blocks")
    for r, k in ((0.12, 5), (0.3, 200)):
        assert rows(balls.ball_query(asked, r, k)) == rows(radius.ball_query(asked, cloud, r, k)) == rows(again.ball_query(asked, r, k))
    with pytest.raises(ValueError):
        index.SpatialIndex.open(spark, path, "tree")


def test_local_search_reads_few_row_groups(spark, monkeypatch):
    """Of a table of many row groups, a search in a corner reads the ones it needs."""
    monkeypatch.setattr(pruned, "SCAN", 0)
    monkeypatch.setattr(pyramid, "GROUP", 4_096)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    built = index.SpatialIndex.build(points(spark, 40_000, 3, batches=1), path=path)
    asked = points(spark, 200, 4, 0.0, 0.1, batches=1)
    tree, q = built.tree, pyramid.Pyramid.build(pyramid.finite_points(asked, 3), 3, 1)
    pairs = pyramid.needed_pairs(q, tree, pyramid.block_pairs(q, tree, 4), lambda ids, pos: pyramid.Nearest(ids, pos, 4, 2))
    part = tree.read(pairs, index.LOCAL).select("xyz")
    plan = part._jdf.queryExecution().executedPlan()
    part._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().head()
    scanned = leaf.metrics().get("numOutputRows").get().value()
    total = tree.blocks.count()
    assert 0 < part.count() <= scanned < 0.5 * total
    assert rows(built.knn(asked, 4)) == rows(knn.smallest(pruned.pairs(asked, built.points, 3), 4).selectExpr("batch", "q", "slot", "ref", "cast(sqrt(d) as float)"))


def test_empty_and_odd_clouds(spark, monkeypatch):
    monkeypatch.setattr(pruned, "SCAN", 0)
    nan, inf = float("nan"), float("inf")
    cloud = spark.createDataFrame([(0, 0, [0.0, 0.0, 0.0]), (0, 1, [nan, 0.0, 0.0]), (0, 2, [inf, 0.0, 0.0]), (0, 3, [3e38, 0.0, 0.0]), (None, 4, [0.0, 0.0, 0.0])], "batch long, idx long, pos array<float>")
    none = cloud.where("false")
    built = index.SpatialIndex.build(cloud, "blocks")
    assert built.size == 2
    assert {(r["q"], r["ref"], r["slot"]) for r in built.knn(cloud, 2).collect()} == {(0, 0, 0), (0, 3, 1), (3, 3, 0), (3, 0, 1)}
    assert built.knn(none, 2).count() == 0 and index.SpatialIndex.build(none, "blocks").knn(cloud, 2).count() == 0
    assert built.ball_query(none, 1.0, 2).count() == 0 and index.SpatialIndex.build(none, "blocks").ball_query(cloud, 1.0, 2).count() == 0
