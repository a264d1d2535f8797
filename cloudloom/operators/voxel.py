"""Voxels, grid clusters and pooling: group-by on computed cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metric as m
from ..ingest import validate
from ..plans.order import global_order
from .gather import collect_features, explode_features


def vector(value: float | Sequence[float], dim: int) -> list[float]:
    out = list(value) if isinstance(value, (list, tuple)) else [value] * dim
    if len(out) != dim:
        raise ValueError(f"expected {dim} values")
    return [float(v) for v in out]


def _cells(size: Sequence[float], start: Sequence[float], dim: int) -> list[Column]:
    quotient = [((F.col("pos")[i] - m.flit(start[i])) / m.flit(size[i])).cast("float") for i in range(dim)]
    return [F.floor(q).alias(f"c{i}") for i, q in enumerate(quotient)]


@dataclass
class Voxels:
    """voxel: voxel_id, batch, c0.., count, ptr_lo, ptr_hi. point: idx, voxel_id, pos_in_order."""

    voxel: DataFrame
    point: DataFrame


def cells(points: DataFrame, size, dim: int = 3, start=0.0, end=None, check: bool = True) -> DataFrame:
    """Points with their cells c0..; a point outside [start, end), or not finite, raises when checked."""
    size, start = vector(size, dim), vector(start, dim)
    if min(size) <= 0:
        raise ValueError("size must be positive")
    if check:
        conditions = {"finite": m.all_finite(F.col("pos"))}
        for i in range(dim):
            conditions[f"range{i}"] = F.abs((F.col("pos")[i] - m.flit(start[i])) / m.flit(size[i])) < 2.0**62
            if end is not None:
                conditions[f"bounds{i}"] = (F.col("pos")[i] >= m.flit(start[i])) & (F.col("pos")[i] < m.flit(vector(end, dim)[i]))
        validate(points, **conditions)
    return points.select("*", *_cells(size, start, dim))


def voxelize(points: DataFrame, size, dim: int = 3, start=0.0, end=None, check: bool = True) -> Voxels:
    """Voxels in lexicographic order of (batch, cells), and the stable order of points by voxel and index.

    Ids are numbered on range-partitioned tables, so no task sees all voxels or all points.
    """
    keys = ["batch", *[f"c{i}" for i in range(dim)]]
    celled = cells(points, size, dim, start, end, check)
    ordered, _ = global_order(celled.select("idx", *keys), [F.col(k) for k in [*keys, "idx"]], "pos_in_order")
    groups = ordered.groupBy(*keys).agg(F.count("*").alias("count"), F.min("pos_in_order").alias("ptr_lo"))
    numbered, _ = global_order(groups, [F.col(k) for k in keys], "voxel_id")
    voxel = numbered.select("voxel_id", *keys, "count", "ptr_lo", (F.col("ptr_lo") + F.col("count")).alias("ptr_hi"))
    point = ordered.join(voxel.select("voxel_id", *keys), keys).select("idx", "voxel_id", "pos_in_order")
    return Voxels(voxel, point)


def voxel_downsample(points: DataFrame, size, dim: int = 3, start=0.0, end=None, feature_reduce: str = "mean", channels: int = 0) -> DataFrame:
    """(batch, c0.., count, pos, feat): mean position and mean or sum of features of each voxel, summed in double precision.

    One shuffle on (batch, cells): coordinates and channels are unrolled aggregates of one hash aggregation.
    """
    if feature_reduce not in ("mean", "sum"):
        raise ValueError("feature_reduce must be mean or sum")
    keys = ["batch", *[f"c{i}" for i in range(dim)]]
    pool = F.avg if feature_reduce == "mean" else F.sum
    aggs = [F.count("*").alias("count"), F.array(*[F.avg(F.col("pos")[i]).cast("float") for i in range(dim)]).alias("pos")]
    if channels:
        aggs.append(F.array(*[pool(F.col("feat")[i]).cast("float") for i in range(channels)]).alias("feat"))
    return cells(points, size, dim, start, end).groupBy(*keys).agg(*aggs)


def voxel_pool_grad(grad: DataFrame, voxels: Voxels, feature_reduce: str = "mean") -> DataFrame:
    """(idx, feat): each point's share of its voxel's gradient (voxel_id, feat): over the count for mean, all of it for sum."""
    g = grad.join(voxels.voxel.select("voxel_id", "count"), "voxel_id")
    each = F.transform("feat", lambda x: (x / F.col("count")).cast("float")) if feature_reduce == "mean" else F.col("feat")
    return voxels.point.join(g.select("voxel_id", each.alias("feat")), "voxel_id").select("idx", "feat")


def _bounds(points: DataFrame, dim: int, start, end) -> tuple[list[float], list[float]]:
    if start is None or end is None:
        row = points.agg(*[f(F.col("pos")[i]) for f in (F.min, F.max) for i in range(dim)]).first()
        if row[0] is None:
            raise ValueError("the cloud is empty")
        low, high = list(row[:dim]), list(row[dim:])
    return (vector(start, dim) if start is not None else low), (vector(end, dim) if end is not None else high)


def grid_cluster(points: DataFrame, size, dim: int = 3, start=None, end=None) -> DataFrame:
    """(idx, cluster): mixed-radix id of the cell truncated toward zero; extents trunc((end - start) / size) + 1.

    Bounds default to the minimum and maximum. The first coordinate varies fastest.
    """
    size = vector(size, dim)
    start, end = _bounds(points, dim, start, end)
    total, stride = F.lit(0).cast("long"), 1
    for i in range(dim):
        q = ((F.col("pos")[i] - m.flit(start[i])) / m.flit(size[i])).cast("float")
        total = total + q.cast("long") * F.lit(stride)
        stride *= int(m.f32(m.f32(m.f32(end[i]) - m.f32(start[i])) / m.f32(size[i]))) + 1
    return points.select("idx", total.alias("cluster"))


def voxel_grid(points: DataFrame, size, dim: int = 3, start=None, end=None) -> DataFrame:
    """``grid_cluster`` with the batch as a last dimension of size 1 from 0 to its maximum."""
    top = points.agg(F.max("batch")).first()[0]
    start, end = _bounds(points, dim, start, end)
    full = points.withColumn("pos", F.concat("pos", F.array(F.col("batch").cast("float"))))
    return grid_cluster(full, [*vector(size, dim), 1.0], dim + 1, [*start, 0.0], [*end, float(top or 0)])


def avg_pool_x(clustered: DataFrame, channels: int) -> DataFrame:
    """(cluster, batch, feat) by ascending cluster: mean features and the batch of the last member of (idx, batch, cluster, feat)."""
    return clustered.groupBy("cluster").agg(F.max_by("batch", "idx").alias("batch"), F.array(*[F.avg(F.col("feat")[i]).cast("float") for i in range(channels)]).alias("feat"))


def avg_pool_x_fixed(clustered: DataFrame, channels: int, rows: int) -> DataFrame:
    """(cluster, feat) for clusters 0..rows-1, zeros where empty."""
    grid = clustered.sparkSession.range(rows).select(F.col("id").alias("cluster"))
    pooled = avg_pool_x(clustered, channels).select("cluster", "feat")
    return grid.join(pooled, "cluster", "left").select("cluster", F.coalesce("feat", F.array_repeat(m.flit(0), channels)).alias("feat"))


def avg_pool_graph(nodes: DataFrame, edges: DataFrame, channels: int, attrs: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, batch, feat) and edges (src, dst, attr) of a graph coarsened by cluster.

    nodes: (idx, batch, cluster, feat); edges: (src, dst, attr). Clusters are numbered in order; edges within a cluster
    are dropped and parallel ones added up.
    """
    pooled, _ = global_order(avg_pool_x(nodes, channels), [F.col("cluster")], "node")
    of = nodes.select("idx", "cluster").join(pooled.select("cluster", "node"), "cluster").select("idx", "node")
    src, dst = of.toDF("src", "u"), of.toDF("dst", "v")
    mapped = edges.join(src, "src").join(dst, "dst").where("u <> v")
    out = mapped.groupBy("u", "v").agg(F.array(*[F.sum(F.col("attr")[i]).cast("float") for i in range(attrs)]).alias("attr"))
    return pooled.select("node", "batch", "feat"), out.select(F.col("u").alias("src"), F.col("v").alias("dst"), "attr")


def scatter(rows: DataFrame, how: str, size: int | None = None) -> DataFrame:
    """(dst, value) of rows (dst, row, value): sum, mean, max, min, argmax or argmin (the smallest row on ties).

    With ``size`` all segments 0..size-1 appear: 0 where empty, -1 for argmax and argmin.
    """
    best = lambda f, key: f(F.struct("value", key.alias("k"))).alias("b")
    if how == "argmax":
        out = rows.groupBy("dst").agg(best(F.max, -F.col("row"))).select("dst", (-F.col("b.k")).alias("value"))
    elif how == "argmin":
        out = rows.groupBy("dst").agg(best(F.min, F.col("row"))).select("dst", F.col("b.k").alias("value"))
    else:
        f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}.get(how)
        if f is None:
            raise ValueError(f"unknown reduction {how}")
        out = rows.groupBy("dst").agg(f("value").alias("value"))
    if size is None:
        return out
    grid = rows.sparkSession.range(size).select(F.col("id").alias("dst"))
    empty = F.lit(-1 if how.startswith("arg") else 0).cast(out.schema["value"].dataType)
    return grid.join(out, "dst", "left").select("dst", F.coalesce("value", empty).alias("value"))


def pooled_features(points: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """Channel-wise reduction of ``feat`` of any width by keys."""
    return collect_features(explode_features(points), keys, F.avg("v") if how == "mean" else F.sum("v"))
