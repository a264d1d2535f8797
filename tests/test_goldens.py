"""Contract literals of the operators, and NumPy oracles on small clouds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom import ingest
from cloudloom.functions import metric as m
from cloudloom.functions import morton
from cloudloom.operators import gather, graph, index, knn, loss, radius, sampling, sparse, voxel

INF, NAN = float("inf"), float("nan")


def axis(spark, *clouds):
    """Points on the x axis: (batch, values); indices run on over the batches."""
    rows, i = [], 0
    for batch, xs in clouds:
        for x in xs:
            rows.append((batch, i, [float(x), 0.0, 0.0]))
            i += 1
    return ingest.points(spark, rows)


def cloud(spark, rows, batch=0):
    return ingest.points(spark, [(batch, i, [float(v) for v in p]) for i, p in enumerate(rows)])


def lists(df, *cols, by):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(*by).collect()]


SQUARE = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]


def test_square(spark):
    pts = cloud(spark, SQUARE)
    assert lists(sampling.furthest_point_sample(pts, 2), "idx", by=["slot"]) == [0, 3]
    centres = ingest.points(spark, [(0, 0, [0.0, 0.0, 0.0]), (0, 1, [1.0, 1.0, 0.0])])
    assert lists(knn.knn(centres, pts, 2), "ref", by=["q", "slot"]) == [0, 1, 3, 1]
    assert lists(radius.ball_query(centres, pts, 1.1, 2), "ref", by=["q", "slot"]) == [0, 1, 1, 2]


def test_ratio_sampling(spark):
    pts = axis(spark, (0, [0, 2, 5]), (2, [10, 12]))
    assert lists(sampling.ratio_fps(pts, 0.5), "idx", by=["batch", "slot"]) == [0, 2, 3]
    assert sampling.ratio_fps(pts, 0.0).count() == 0
    assert sampling.ratio_fps(pts, 1.1).count() == 4 + 3
    assert lists(sampling.ratio_fps(axis(spark, (0, [0, 1, 4])), None), "idx", by=["slot"]) == [0, 2]
    assert sampling.ratio_fps(axis(spark, (0, range(25))), 0.6).count() == 16
    with pytest.raises(ValueError):
        sampling.ratio_fps(pts, -1.0)


def test_flat_knn(spark):
    ref = axis(spark, (0, [0, 2, 5]), (2, [10, 12]))
    q = ingest.points(spark, [(0, 0, [1.0, 0.0, 0.0]), (1, 1, [0.0, 0.0, 0.0]), (2, 2, [11.0, 0.0, 0.0]), (2, 3, [15.0, 0.0, 0.0])])
    assert lists(knn.flat_knn(q, ref, 2), "q", "ref", by=["q", "slot"]) == [(0, 0), (0, 1), (2, 3), (2, 4), (3, 4), (3, 3)]
    assert knn.flat_knn(q, ref, 5).count() == 7
    bad = cloud(spark, [(0, 0, 0), (NAN, 0, 0), (INF, 0, 0)])
    assert lists(knn.flat_knn(cloud(spark, [(0, 0, 0), (NAN, 0, 0)]), bad, 3), "q", "ref", by=["q"]) == [(0, 0)]
    with pytest.raises(NotImplementedError):
        knn.flat_knn(q, ref, 1, cosine=True)


def test_flat_radius(spark):
    ref = axis(spark, (0, [0, 2, 5]), (2, [10, 12]))
    q = ingest.points(spark, [(0, 0, [1.0, 0.0, 0.0]), (1, 1, [0.0, 0.0, 0.0]), (2, 2, [11.0, 0.0, 0.0]), (2, 3, [15.0, 0.0, 0.0])])
    assert lists(radius.flat_radius(q, ref, 1.1, 2), "q", "ref", by=["q", "slot"]) == [(0, 0), (0, 1), (2, 3), (2, 4)]
    assert lists(radius.flat_radius(q, ref, 100.0, 1), "q", "ref", by=["q"]) == [(0, 0), (2, 3), (3, 3)]
    one = axis(spark, (0, [0.0]))
    assert radius.flat_radius(one, one, 0.0, 4).count() == 0
    near = axis(spark, (0, [0, 0.1, 0.2]))
    assert lists(radius.flat_radius(one, near, 1.0, 1, ignore_same_index=True), "q", "ref", by=["q"]) == [(0, 1)]
    assert m.dense_threshold(0.21) < m.flat_threshold(0.21)


def test_graphs(spark):
    pts = axis(spark, (0, [0, 1, 2]))
    assert lists(knn.knn_graph(pts, 1), "src", "dst", by=["dst"]) == [(1, 0), (0, 1), (1, 2)]
    assert lists(radius.radius_graph(pts, 1.1, 1), "src", "dst", by=["dst", "src"])[:2] == [(1, 0), (0, 1)]
    assert knn.knn_graph(pts, 1, loop=True).count() == 3
    assert lists(knn.knn_graph(pts, 1, flow="target_to_source"), "dst", "src", by=["src"]) == [(1, 0), (0, 1), (1, 2)]


def test_repeat_first(spark):
    ref = cloud(spark, [(5, 0, 0), (0.1, 0, 0), (9, 9, 9), (0.2, 0, 0)])
    q = cloud(spark, [(0, 0, 0), (50, 50, 50)])
    assert lists(radius.repeat_first_ball_query(q, ref, 0.5, 4), "ref", by=["q", "slot"]) == [1, 3, 1, 1, 0, 0, 0, 0]


def test_sampling_edges(spark):
    assert lists(sampling.sampled_from_origin_free(cloud(spark, [(0, 0, 0)] * 50), 5), "idx", by=["slot"]) == [0] * 5
    pts = axis(spark, (0, [0, 1, 4, 9]), (1, [10, 11, 15]))
    counts = spark.createDataFrame([(0, 2), (1, 2)], "batch long, m long")
    assert lists(sampling.offset_fps(pts, counts), "idx", by=["batch", "slot"]) == [0, 3, 4, 6]
    with pytest.raises(ValueError):
        sampling.offset_fps(pts, spark.createDataFrame([(0, 9), (1, 2)], "batch long, m long"))
    p = np.random.default_rng(3).integers(-64, 64, (300, 3)) / 16
    df = cloud(spark, p)
    one = lists(sampling.furthest_point_sample(df, 20), "idx", by=["slot"])
    assert lists(sampling.distributed(df, 20), "idx", by=["slot"]) == one == sampling.farthest(p, 20).tolist()


def test_three_nn(spark):
    found = knn.three_nn(cloud(spark, [(0, 0, 0), (2, 0, 0)]), cloud(spark, [(1, 0, 0), (-1, 0, 0), (0, 2, 0), (1, 0, 0)]))
    assert lists(found, "ref", by=["q", "slot"]) == [0, 1, 3, 0, 3, 2]
    assert lists(found, "dist", by=["q", "slot"]) == [1, 1, 1, 1, 1, np.float32(math.sqrt(8))]
    with pytest.raises(ValueError):
        knn.three_nn(cloud(spark, [(0, 0, 0)]), cloud(spark, [(0, 0, 0)]))


def test_nearest(spark):
    one = lambda xs: ingest.points(spark, [(0, i, [float(x)]) for i, x in enumerate(xs)])
    assert lists(knn.nearest(one([0, 2, 9]), one([-1, 1, 10]), 1), "nearest", by=["idx"]) == [0, 1, 2]
    assert lists(knn.nearest(one([0, 1e20, NAN, INF]), one([2, 3]), 1), "nearest", by=["idx"]) == [0, 0, 0, 0]
    refs = [10.0] * 1030
    refs[1] = refs[1024] = 0.0
    assert lists(knn.nearest(one([0]), one(refs), 1), "nearest", by=["idx"]) == [1024]
    with pytest.raises(ValueError):
        knn.nearest(one([0]), ingest.points(spark, [(1, 0, [0.0])]), 1)


def test_offset_knn(spark):
    ref = axis(spark, (0, [0, 2]), (1, [10, 12, 14]))
    q = ingest.points(spark, [(0, 0, [0.5, 0.0, 0.0]), (1, 1, [11.0, 0.0, 0.0])])
    found = knn.offset_knn(q, ref, 4)
    assert lists(found, "ref", by=["q", "slot"]) == [0, 1, -1, -1, 2, 3, 4, -1]
    assert lists(found, "dist", by=["q", "slot"]) == [0.5, 1.5, 1e5, 1e5, 1, 1, 3, 1e5]
    far = knn.offset_knn(axis(spark, (0, [0])), axis(spark, (0, [99999, 100000, 100001])), 3)
    assert lists(far, "ref", by=["slot"]) == [0, -1, -1]
    steps = knn.offset_knn(axis(spark, (0, [0.5])), axis(spark, (0, [i * 0.25 for i in range(16)])), 8)
    assert lists(steps, "ref", by=["slot"]) == [2, 1, 3, 0, 4, 5, 6, 7]


def test_voxels(spark):
    rows = [(2, 0, [0.0, 0.0]), (0, 1, [-1.0, 0.0]), (0, 2, [0.0, 0.0]), (2, 3, [1.0, 1.0]), (0, 4, [-1.0, 0.0]), (2, 5, [0.5, -0.5])]
    v = voxel.voxelize(ingest.points(spark, rows), 1.0, 2)
    assert lists(v.voxel, "batch", "c0", "c1", "count", "ptr_lo", by=["voxel_id"]) == [(0, -1, 0, 2, 0), (0, 0, 0, 1, 2), (2, 0, -1, 1, 3), (2, 0, 0, 1, 4), (2, 1, 1, 1, 5)]
    assert lists(v.point, "voxel_id", by=["idx"]) == [3, 0, 1, 4, 0, 2]
    assert lists(v.point, "idx", by=["pos_in_order"]) == [1, 4, 2, 5, 0, 3]
    line = ingest.points(spark, [(0, i, [x]) for i, x in enumerate((-2.0, -1.5, 0.0, 1.5))])
    assert lists(voxel.cells(line, 0.5, 1, -2.0, 2.0), "c0", by=["idx"]) == [0, 1, 4, 7]
    with pytest.raises(ValueError):
        voxel.cells(ingest.points(spark, [(0, 0, [2.0])]), 0.5, 1, -2.0, 2.0)


def test_downsample(spark):
    rows = [(0, i, [x], [float(a), float(b)]) for i, (x, a, b) in enumerate([(0.0, 2, 4), (0.5, 6, 8), (2.0, 10, 12), (2.5, 14, 16)])]
    df = spark.createDataFrame(rows, "batch long, idx long, pos array<float>, feat array<float>")
    assert lists(voxel.voxel_downsample(df, 1.0, 1, channels=2), "pos", "feat", by=["c0"]) == [([0.25], [4, 6]), ([2.25], [12, 14])]
    assert lists(voxel.voxel_downsample(df, 1.0, 1, feature_reduce="sum", channels=2), "feat", by=["c0"]) == [[8, 12], [24, 28]]
    v = voxel.voxelize(df, 1.0, 1)
    g = v.voxel.select("voxel_id", F.array(((F.col("voxel_id") + 1) * 2).cast("float")).alias("feat"))
    assert lists(voxel.voxel_pool_grad(g, v), "feat", by=["idx"]) == [[1], [1], [2], [2]]


def test_grid_cluster(spark):
    pts = cloud(spark, [(0, 0, 0), (11, 9, 0), (2, 8, 0), (2, 2, 0), (8, 3, 0)])
    assert lists(voxel.grid_cluster(pts, (5.0, 5.0, 1.0)), "cluster", by=["idx"]) == [0, 5, 3, 0, 1]
    rows = [(0, 0, [0.0, 0.0]), (0, 1, [0.2, 0.0]), (0, 2, [1.0, 1.0]), (2, 3, [0.0, 0.0]), (2, 4, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, [float(2 * i), float(2 * i + 1)]) for i, r in enumerate(rows)], "batch long, idx long, pos array<float>, feat array<float>")
    ids = voxel.voxel_grid(df, 1.0, 2, 0.0, 2.0)
    assert lists(ids, "cluster", by=["idx"]) == [0, 0, 4, 18, 19]
    pooled = df.join(ids, "idx")
    assert lists(voxel.avg_pool_x(pooled, 2), "feat", "batch", by=["cluster"]) == [([1, 2], 0), ([4, 5], 0), ([6, 7], 2), ([8, 9], 2)]
    fixed = voxel.avg_pool_x_fixed(pooled, 2, 27)
    assert fixed.count() == 27 and fixed.where("feat[0] = 0 and feat[1] = 0").count() == 23


def test_scatter(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (2, 2, 5.0), (0, 3, 3.0)], "dst long, row long, value double")
    want = {"sum": [7, 0, 5], "mean": [7 / 3, 0, 5], "max": [3, 0, 5], "min": [1, 0, 5], "argmax": [1, -1, 2], "argmin": [0, -1, 2]}
    for how, values in want.items():
        assert lists(voxel.scatter(df, how, 3), "value", by=["dst"]) == values


def test_chamfer(spark):
    x, y = cloud(spark, [(0, 0, 0), (2, 0, 0)]), cloud(spark, [(1, 0, 0)])
    n = lambda df: ingest.clouds(df)
    assert loss.chamfer_distance(x, y, n(x), n(y), batch_reduction="sum").first()[0] == 2.0
    fwd = loss.point_losses(x, y).withColumn("g", F.lit(0.5))
    back = loss.point_losses(y, x).withColumn("g", F.lit(1.0))
    gx, gy = loss.pair_gradients(fwd, x, y)
    gy2, gx2 = loss.pair_gradients(back, y, x)
    total = {r["idx"]: r["v"] for r in gx.unionByName(gx2).groupBy("idx").agg(F.sum(F.col("feat")[0]).alias("v")).collect()}
    assert total == {0: -3.0, 1: 1.0}
    assert gy.unionByName(gy2).agg(F.sum(F.col("feat")[0])).first()[0] == 2.0
    zeros = ingest.points(spark, [(b, 0, [0.0, 0.0, 0.0]) for b in (0, 1)])
    far = ingest.points(spark, [(0, 0, [1.0, 0.0, 0.0]), (1, 0, [2.0, 0.0, 0.0])])
    w = spark.createDataFrame([(0, 0.1), (1, 0.2)], "batch long, w double")
    assert loss.chamfer_distance(zeros, far, n(zeros), n(far), weights=w).first()[0] == pytest.approx(6.0)
    assert loss.chamfer_distance(zeros, far, n(zeros), n(far), point_reduction="sum", batch_reduction="sum", weights=w).first()[0] == pytest.approx(1.8)
    assert lists(loss.chamfer_distance(zeros, far, n(zeros), n(far), point_reduction="max", batch_reduction=None), "loss", by=["batch"]) == [1, 4]
    assert loss.zero_weight_anchor(n(zeros)).count() == 4


def test_interpolate(spark):
    f = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [3.0]), (0, 2, [5.0])], "batch long, idx long, feat array<float>")
    pts = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 4, 0)])
    out = gather.interpolation(pts, cloud(spark, [(0, 0, 0)]), f, 1)
    assert out.first()["feat"][0] == pytest.approx(1.0, abs=1e-6)
    grouped = gather.query_and_group(f, pts, cloud(spark, [(1, 0, 0)]), 4, 1)
    assert lists(grouped, "feat", by=["slot"]) == [[0, 0, 0, 3], [-1, 0, 0, 1], [-1, 4, 0, 5], [0, 0, 0, 0]]


def test_rulebooks(spark):
    rows = [(0, 0, 2, 1, 1, [1.0]), (1, 0, 1, 1, 1, [2.0]), (2, 1, 2, 1, 1, [3.0])]
    schema = "row long, b int, a0 int, a1 int, a2 int, features array<float>"
    sites = spark.createDataFrame(rows, schema)
    assert lists(sparse.subm_rulebook(sites), "offset", "in_row", "out_row", by=["offset", "out_row"]) == [(4, 1, 0), (13, 0, 0), (13, 1, 1), (13, 2, 2), (22, 0, 1)]
    two = spark.createDataFrame([(0, 0, 3, 0, 0, [1.0]), (1, 0, 1, 0, 0, [1.0])], schema)
    assert lists(sparse.subm_rulebook(two, (3, 1, 1), (2, 1, 1)), "offset", "in_row", "out_row", by=["offset", "out_row"]) == [(0, 1, 0), (1, 0, 0), (1, 1, 1), (2, 0, 1)]
    four = spark.createDataFrame([(i, 0, a, 0, 0, [1.0]) for i, a in enumerate((4, 1, 0, 2))], schema)
    outs, rules, shape = sparse.conv_rulebook(four, (5, 1, 1), (3, 1, 1), (2, 1, 1), (1, 0, 0))
    assert shape == (3, 1, 1) and lists(outs, "a0", by=["row"]) == [0, 1, 2]
    assert lists(rules, "offset", "in_row", "out_row", by=["offset", "out_row", "in_row"]) == [(0, 1, 1), (1, 2, 0), (1, 3, 1), (1, 0, 2), (2, 1, 0)]
    with pytest.raises(ValueError):
        sparse.validate_sites(sites.union(sites), (3, 3, 3), 2)
    x = sparse.SparseConvTensor(sites, (3, 3, 3), 2)
    assert x.dense(1).count() == 54 and x.dense(1).where("features[0] <> 0").count() == 3


def test_graclus(spark):
    coo = lambda rows: spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], ingest.COO)
    pairs = coo([(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, 1), (4, 4, 1)])
    for weighted in (False, True):
        assert lists(graph.graclus(pairs, 6, weighted), "label", by=["node"]) == [0, 0, 2, 2, 4, 5]
    assert lists(graph.mutual_matching(pairs, 6), "label", by=["node"]) == [0, 0, 2, 2, 4, 5]
    signed = coo([(0, 1, -1), (0, 2, 0), (1, 0, -1), (2, 0, 0)])
    assert lists(graph.graclus(signed, 3, True, seed=None), "label", by=["node"]) == [0, 1, 0]
    tie = coo([(0, 1, 2), (0, 2, 2)])
    assert lists(graph.graclus(tie, 3, True, seed=None), "label", by=["node"]) == [0, 1, 0]
    rng = np.random.default_rng(5)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2)) if a != b}
    e |= {(b, a) for a, b in e}
    df = coo([(a, b, 1 + (a * b) % 7) for a, b in sorted(e)])
    for label in (lists(graph.graclus(df, 40, True), "label", by=["node"]), lists(graph.mutual_matching(df, 40), "label", by=["node"])):
        groups = {k: [i for i, x in enumerate(label) if x == k] for k in set(label)}
        assert all(len(g) <= 2 and min(g) == k and (len(g) == 1 or tuple(g) in e) for k, g in groups.items())
        alone = {g[0] for g in groups.values() if len(g) == 1}
        assert not any(a in alone and b in alone for a, b in e)


def test_walks(spark):
    row, col = [1, 0, 2, 1, 3, 1, 2], [2, 1, 1, 0, 4, 3, 0]
    e = spark.createDataFrame(list(zip(row, col)), "row long, col long")
    starts = spark.createDataFrame(list(enumerate([0, 1, 4, 5])), "walk_id long, node long")
    edges = sorted(zip(row, col))
    for p, q in ((1.0, 1.0), (2.0, 0.5)):
        walks = graph.random_walk(e, starts, 4, p, q).orderBy("walk_id", "step").collect()
        at = {(r["walk_id"], r["step"]): (r["node"], r["edge_id"]) for r in walks}
        for (w, s), (node, edge) in at.items():
            if s:
                before = at[w, s - 1][0]
                assert edges[edge] == (before, node) if edge >= 0 else before == node
        assert all(at[w, s][0] == (4, 5)[w - 2] for w in (2, 3) for s in range(5))
    flip = spark.createDataFrame([(0, 1), (1, 0)], "row long, col long")
    walk = graph.random_walk(flip, spark.createDataFrame([(0, 0)], "walk_id long, node long"), 3)
    assert lists(walk, "node", "edge_id", by=["step"]) == [(0, None), (1, 0), (0, 1), (1, 0)]


def test_biased_walk_distribution(spark):
    e = spark.createDataFrame(list(zip([0, 1, 1, 1, 2], [1, 0, 2, 3, 0])), "row long, col long")
    starts = spark.range(12000).select(F.col("id").alias("walk_id"), F.lit(0).cast("long").alias("node"))
    for p, q, want in ((2.0, 4.0, (2 / 7, 0, 4 / 7, 1 / 7)), (0.5, 2.0, (4 / 7, 0, 2 / 7, 1 / 7))):
        got = {r["node"]: r["count"] / 12000 for r in graph.random_walk(e, starts, 2, p, q).where("step = 2").groupBy("node").count().collect()}
        assert all(abs(got.get(k, 0) - w) < 0.025 for k, w in enumerate(want))


def test_morton(spark):
    rng = np.random.default_rng(1)
    cells = [tuple(int(v) for v in c) for c in rng.integers(0, 1 << 21, (50, 3))] + [(0, 0, 0), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame(cells, "x long, y long, z long").withColumn("key", morton.encode(F.col("x"), F.col("y"), F.col("z"))).withColumn("back", morton.decode(F.col("key")))
    for r in df.collect():
        want = sum(((v >> b) & 1) << (3 * b + k) for k, v in enumerate((r["x"], r["y"], r["z"])) for b in range(21))
        assert r["key"] == want and tuple(r["back"]) == (r["x"], r["y"], r["z"])
    keys = index.morton_keys(cloud(spark, [(0, 0, 0), (-1, 0, 0), (NAN, 0, 0), (2.0**21, 0, 0)]), (0.0,) * 3, (1.0,) * 3)
    assert lists(keys, "invalid", by=["idx"]) == [False, True, True, True]


@pytest.mark.parametrize("k,r", [(1, 0.3), (7, 0.55), (40, 1.2)])
def test_index_equals_scan(spark, k, r):
    rng = np.random.default_rng(9074)
    pts = cloud(spark, rng.integers(-64, 64, (192, 3)) / 32).union(cloud(spark, rng.integers(-8, 8, (60, 3)) / 32, 3))
    built = index.SpatialIndex.build(pts, "blocks", block=8)
    a, b = built.knn(pts, k), knn.knn(pts, pts, k)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    c, d, e = built.ball_query(pts, r, k), radius.ball_query(pts, pts, r, k), radius.ball_query(pts, pts, r, k, cells=False)
    assert c.exceptAll(e).count() == 0 and d.exceptAll(e).count() == 0 and c.count() == d.count() == e.count()


def test_feature_knn_blocks(spark):
    rng = np.random.default_rng(2)
    x = (rng.integers(-4, 4, (97, 20)) / 4).astype(np.float32)
    x[50] = x[3]
    df = spark.createDataFrame([(0, i, [float(v) for v in p]) for i, p in enumerate(x)], ingest.POINT)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = [int(j) for row in d for j in np.lexsort((np.arange(97), row))[:5]]
    assert lists(knn.knn(df, df, 5, 20), "ref", by=["q", "slot"]) == want


def test_ingest(spark):
    flat = spark.createDataFrame([(i,) for i in range(5)], "idx long")
    ptr = ingest.offsets_to_ptr(spark.createDataFrame([(0, 2), (1, 2), (2, 5)], "batch long, hi long"))
    assert lists(ingest.with_batch(flat, ptr), "batch", by=["idx"]) == [0, 0, 2, 2, 2]
    pts = axis(spark, (0, [1, 2]), (2, [3]))
    assert lists(ingest.ptr_of(ingest.clouds(pts, 4)), "lo", by=["batch"]) == [0, 2, 2, 3]
    assert lists(ingest.ptr_of(ingest.clouds(pts, 4)), "hi", by=["batch"]) == [2, 2, 3, 3]
    with pytest.raises(ValueError):
        ingest.validate(pts, small=F.col("idx") < 2)


def test_parameters():
    for bad in (-1.0, INF, NAN):
        with pytest.raises(ValueError):
            m.check_radius(bad, 1)
    for k in (True, -1, 1.5):
        with pytest.raises(ValueError):
            m.check_count(k)
