"""Searches beside integer-exact distances: coordinates in 1/1024, scaled to BIGINT."""

import random

from pyspark.sql import functions as F

from cloudloom import ingest
from cloudloom.operators.knn import knn
from cloudloom.operators.radius import ball_query
from cloudloom.operators.rings import grid_knn

AXES = [(1, 0, 0), (0, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 0), (0, 0, 1), (0, 0, -1)]


def exact(query, ref):
    """(q, ref, d): squared distances in units of 1 / 1024 squared."""
    whole = lambda df, n: df.select(F.col("idx").alias(n), *[(F.col("pos")[i].cast("double") * 1024).cast("long").alias(f"{n}{i}") for i in range(3)])
    d = sum(((F.col(f"q{i}") - F.col(f"ref{i}")) * (F.col(f"q{i}") - F.col(f"ref{i}")) for i in range(3)), F.lit(0).cast("long"))
    return [tuple(r) for r in whole(query, "q").crossJoin(whole(ref, "ref")).select("q", "ref", d).collect()]


def test_searches_equal_exact_distances(spark):
    rng = random.Random(41)
    near = [[rng.randrange(-8, 9) / 1024 for _ in range(3)] for _ in range(40)] + [[float(rng.randrange(-3, 4)) for _ in range(3)] for _ in range(20)]
    asked = [[0.0, 0.0, 0.0]] + [[rng.randrange(-2048, 2049) / 1024 for _ in range(3)] for _ in range(15)]
    for cloud in ([list(map(float, p)) for p in AXES], near):
        q, ref = (ingest.points(spark, [(0, i, p) for i, p in enumerate(c)]) for c in (asked, cloud))
        pairs = exact(q, ref)
        first = {i: [r for _, r in sorted((d, r) for a, r, d in pairs if a == i)[:5]] for i in range(len(asked))}
        for found in (knn(q, ref, 5), grid_knn(q, ref, 5, 0.5)):
            got = {}
            for r in found.orderBy("q", "slot").collect():
                got.setdefault(r["q"], []).append(r["ref"])
            assert got == first
        for radius, k in ((1.0, 8), (2.0, 4)):
            want = {i: sorted(r for a, r, d in pairs if a == i and d < (radius * 1024) ** 2)[:k] for i in range(len(asked))}
            got = {i: [] for i in want}
            for r in ball_query(q, ref, radius, k).orderBy("q", "slot").collect():
                got[r["q"]].append(r["ref"])
            assert got == want
        if len(cloud) == len(AXES):
            assert first[0] == [1, 5, 0, 2, 3]
