"""Sums that a query rounds: products in single precision, added in double precision and rounded once."""

import numpy as np
from pyspark.sql import functions as F

from cloudloom import ingest, queries
from cloudloom.operators import gather


def test_interpolated_sums_are_rounded_once(spark):
    cells = ingest.points(spark, [(0, 0, [2.0, 8.0, 8.0]), (0, 1, [4.0, 64.0, 0.0]), (0, 2, [6.0, 72.0, 24.0])])
    feat = queries._cell_features(cells)
    assert feat.schema["feat"].dataType.elementType.simpleString() == "float"
    target = ingest.points(spark, [(0, i, [0.5 * i, 7.0 * i, 3.0]) for i in range(40)])
    w = {}
    for r in gather.inverse_distance_weights(gather._knn.offset_knn(target, cells, 3)).collect():
        w.setdefault(r["q"], []).append((r["ref"], np.float32(r["w"])))
    f = {r["idx"]: r["feat"] for r in feat.collect()}
    got = {r["q"]: r["feat"] for r in gather.interpolation(cells, target, feat, 2, kind="double").collect()}
    want = {q: [sum(float(np.float32(f[ref][c]) * x) for ref, x in rows) for c in range(2)] for q, rows in w.items()}
    assert got == want and any(float(np.float32(v)) != v for row in want.values() for v in row)
    grad, _ = gather.three_interpolate_grad(target.select("batch", F.col("idx").alias("q"), F.col("pos").alias("feat")), gather.inverse_distance_weights(gather._knn.three_nn(target, cells)), "double")
    assert grad.schema["feat"].dataType.elementType.simpleString() == "double"
