"""What must not be capped, nor go through one task, as tables grow."""

import random

import pytest

from cloudloom import ingest
from cloudloom.operators import graph, index, knn, loss


def greedy(edges, n):
    best = {}
    for a, b, w in edges:
        if a != b and w >= 0:
            key = (min(a, b), max(a, b))
            best[key] = max(best.get(key, 0.0), w)
    label = list(range(n))
    free = set(range(n))
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if {a, b} <= free:
            free -= {a, b}
            label[b] = a
    return label


@pytest.mark.parametrize("remainder", [graph.REMAINDER, 12])
def test_matching_is_greedy_and_maximal(spark, remainder):
    """A path of rising weights longer than the remainder, and a random graph with equal weights."""
    rng = random.Random(1)
    n = 100 if remainder > 99 else 24
    path = [(i, i + 1, float(i)) for i in range(n - 1)]
    mixed = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(4))) for _ in range(150)]
    for edges, nodes in ((path, n), (mixed, 60)):
        df = spark.createDataFrame(edges, "row long, col long, weight float")
        got = {r["node"]: r["label"] for r in graph.mutual_matching(df, nodes, remainder).collect()}
        assert [got[i] for i in range(nodes)] == greedy(edges, nodes)


def test_pointers_over_partitions(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 3, 200]) for _ in range(60)]
    cloud = spark.createDataFrame(list(enumerate(sizes)), "batch long, n long")
    ends = [sum(sizes[: i + 1]) for i in range(60)]
    ptr = ingest.ptr_of(cloud)
    assert {(r["batch"], r["lo"], r["hi"]) for r in ptr.collect()} == {(i, ends[i] - sizes[i], ends[i]) for i in range(60)}
    again = ingest.offsets_to_ptr(spark.createDataFrame(list(enumerate(ends)), "batch long, hi long"))
    assert {tuple(r) for r in again.select("batch", "lo", "hi").collect()} == {(i, ends[i] - sizes[i], ends[i]) for i in range(60)}
    flat = spark.range(ends[-1] + 3).withColumnRenamed("id", "idx")
    got = {r["idx"]: r["batch"] for r in ingest.with_batch(flat, ptr).collect()}
    want = [i for i, k in enumerate(sizes) for _ in range(k)]
    assert [got[i] for i in range(ends[-1])] == want and all(got[ends[-1] + k] is None for k in range(3))


def test_gradients_by_differences(spark):
    """Weighted mean Chamfer gradients, and those of indexed distances, against finite differences."""
    rng = random.Random(3)
    point = lambda: [rng.random() for _ in range(3)]
    xs, ys = {(b, i): point() for b in range(2) for i in range(5)}, {(b, i): point() for b in range(2) for i in range(4)}
    weight = [0.5, 2.0]
    df = lambda c: spark.createDataFrame([(*k, p) for k, p in c.items()], "batch long, idx long, pos array<float>")
    size = lambda n: spark.createDataFrame([(0, n), (1, n)], "batch long, n long")

    def value(x, y, most=False):
        d = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
        one = lambda s, t, b: sum(min(d(p, q) for (c, _), q in t.items() if c == b) for (c, _), p in s.items() if c == b) / sum(c == b for c, _ in s)
        far = lambda s, t, b: max(min(d(p, q) for (c, _), q in t.items() if c == b) for (c, _), p in s.items() if c == b)
        if most:
            return sum(weight[b] * max(far(x, y, b), far(y, x, b)) for b in range(2)) / sum(weight)
        return sum(weight[b] * (one(x, y, b) + one(y, x, b)) for b in range(2)) / sum(weight)

    w = spark.createDataFrame(list(enumerate(weight)), "batch long, w double")
    both = [(grad, own, how == "max") for how in ("mean", "max") for grad, own in zip(loss.chamfer_gradients(df(xs), df(ys), size(5), size(4), point_reduction=how, weights=w), (xs, ys), strict=True)]
    for grad, own, most in both:
        for r in grad.collect():
            for c in range(3):
                moved = []
                for h in (1e-4, -1e-4):
                    p = {**own, (r["batch"], r["idx"]): [v + h * (k == c) for k, v in enumerate(own[r["batch"], r["idx"]])]}
                    moved.append(value(p, ys, most) if own is xs else value(xs, p, most))
                assert abs((moved[0] - moved[1]) / 2e-4 - r["feat"][c]) < 1e-3
    built = index.SpatialIndex.build(df(ys))
    found = built.knn(df(xs), 1).select("batch", "q", "ref").withColumn("g", loss.F.lit(1.0))
    to_q, _ = built.distance_gradients(found, df(xs))
    near = {(r["batch"], r["q"]): r["ref"] for r in found.collect()}
    for r in to_q.collect():
        key = (r["batch"], r["idx"])
        assert r["feat"] == pytest.approx([2 * (a - b) for a, b in zip(xs[key], ys[key[0], near[key]], strict=True)], abs=1e-5)


def test_pointers_of_both_sides(spark):
    pts = spark.createDataFrame([(i, [float(i % 4), 0.0, 0.0]) for i in range(8)], "idx long, pos array<float>")
    ptr = spark.createDataFrame([(0, 0, 4), (1, 4, 8)], "batch long, lo long, hi long")
    assert {tuple(r) for r in knn.ptr_knn(pts, pts, ptr, ptr).collect()} == {(i, i, 0) for i in range(8)}
    assert {tuple(r) for r in knn.ptr_knn(pts, pts, ptr).collect()} == {(i, i % 4, 0) for i in range(8)}
    with pytest.raises(ValueError):
        knn.ptr_knn(pts, pts, None, ptr)
