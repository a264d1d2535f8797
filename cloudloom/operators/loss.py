"""Chamfer distance, its reductions, normals and gradients, and the ball-query gradient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metric as m
from ..plans.order import cut
from .gather import collect_features, explode_features
from .knn import first_minimum
from .pruned import Trees, by_place, places, plant

EPS = 1e-6


def point_losses(x: DataFrame, y: DataFrame, dim: int = 3, norm: int = 2, trees: Trees | None = None) -> DataFrame:
    """(batch, q, ref, d): each point's distance to its first nearest, 0 where the other cloud is empty."""
    return first_minimum(x, y, dim, norm, trees)


def spread(losses: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """The losses of places for all points that stand there."""
    return by_place(points, dim, lambda asked: losses)


def reduce_points(losses: DataFrame, cloud: DataFrame, how: str | None, value: str = "d") -> DataFrame:
    """(batch, loss) by mean (over max(n, 1)), sum or max (0 if empty); the rows themselves for None. A row with ``copies`` counts as so many."""
    if how is None:
        return losses
    each = F.col(value) * F.col("copies") if "copies" in losses.columns else F.col(value)
    total = {"mean": F.sum(each), "sum": F.sum(each), "max": F.max(value)}[how]
    out = cloud.select("batch", "n").join(losses.groupBy("batch").agg(total.cast("double").alias("loss")), "batch", "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    return out.select("batch", (F.col("loss") / F.greatest(F.col("n"), F.lit(1)) if how == "mean" else F.col("loss")).alias("loss"))


def reduce_batches(losses: DataFrame, how: str | None, weights: DataFrame | None = None) -> DataFrame:
    """(loss): sum, or mean over the batches or over the sum of weights (1 if that is 0). None: (batch, loss), weighted."""
    if weights is None:
        weighted = losses.withColumn("w", F.lit(1.0))
    else:
        if weights.where("w < 0").limit(1).count():
            raise ValueError("weights must not be negative")
        weighted = losses.join(weights.select("batch", "w"), "batch")
    weighted = weighted.withColumn("loss", F.col("loss") * F.col("w"))
    if how is None:
        return weighted.select("batch", "loss")
    if how == "sum":
        return weighted.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"))
    if how != "mean":
        raise ValueError("batch reduction must be mean, sum or None")
    return weighted.agg((F.coalesce(F.sum("loss"), F.lit(0.0)) / F.when(F.sum("w") > 0, F.sum("w")).otherwise(1.0)).alias("loss"))


def zero_weight_anchor(cloud: DataFrame) -> DataFrame:
    """(batch, other, loss): the B x B zeros that all-zero weights give without batch reduction in the padded interface."""
    b = cloud.select("batch")
    return b.crossJoin(b.withColumnRenamed("batch", "other")).withColumn("loss", F.lit(0.0))  # the result itself is B x B


def normal_losses(found: DataFrame, x_normals: DataFrame, y_normals: DataFrame, absolute: bool = True) -> DataFrame:
    """(batch, q, d) = 1 - |cos| of the normals (batch, idx, pos) of each point and its nearest; 1 in an empty reference cloud."""
    a = x_normals.select("batch", F.col("idx").alias("q"), F.col("pos").alias("a"))
    b = y_normals.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("b"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)
    norm = lambda u: F.greatest(F.sqrt(dot(u, u)), F.lit(EPS))
    cos = dot("a", "b") / (norm("a") * norm("b"))
    return found.join(a, ["batch", "q"]).join(b, ["batch", "ref"], "left").select("batch", "q", F.coalesce(1 - (F.abs(cos) if absolute else cos), F.lit(1.0)).alias("d"))


def chamfer_distance(x: DataFrame, y: DataFrame, cloud_x: DataFrame, cloud_y: DataFrame, dim: int = 3, norm: int = 2, point_reduction: str | None = "mean", batch_reduction: str | None = "mean", weights: DataFrame | None = None, single_directional: bool = False) -> DataFrame:
    """The loss after both reductions; directions are added, or the larger taken for point_reduction max.

    Without point reduction the rows of the directions: (direction, batch, q, ref, d).
    """
    if point_reduction is None and batch_reduction is not None:
        raise ValueError("batch reduction needs a point reduction")
    px, py = places(x, dim), places(y, dim)
    trees = plant(px, py, dim, 1)
    back = trees and (trees[1], trees[0])
    if point_reduction is None:
        rows = spread(point_losses(px, py, dim, norm, trees), x, dim).withColumn("direction", F.lit("xy"))
        return rows if single_directional else rows.unionByName(spread(point_losses(py, px, dim, norm, back), y, dim).withColumn("direction", F.lit("yx")))
    many = lambda losses, own: losses.join(own.select("batch", F.col("idx").alias("q"), F.col("copies").cast("double").alias("copies")), ["batch", "q"])
    per = reduce_points(many(point_losses(px, py, dim, norm, trees), px), cloud_x, point_reduction)
    if not single_directional:
        other = reduce_points(many(point_losses(py, px, dim, norm, back), py), cloud_y, point_reduction).withColumnRenamed("loss", "back")
        both = F.greatest("loss", "back") if point_reduction == "max" else F.col("loss") + F.col("back")
        per = per.join(other, "batch").select("batch", both.alias("loss"))
    return reduce_batches(per, batch_reduction, weights)


def _difference(found: DataFrame, x: DataFrame, y: DataFrame, each: Column) -> DataFrame:
    """Channels (batch, q, ref, c, v) of the gradient that each chosen pair (batch, q, ref, g) sends to its query."""
    a = x.select("batch", F.col("idx").alias("q"), F.col("pos").alias("a"))
    b = y.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("b"))
    rows = found.where("ref >= 0").join(a, ["batch", "q"]).join(b, ["batch", "ref"])
    return explode_features(rows.withColumn("feat", F.zip_with("a", "b", lambda q, r: each(F.col("g"), q, r))).drop("a", "b"))


def pair_gradients(found: DataFrame, x: DataFrame, y: DataFrame, norm: int = 2) -> tuple[DataFrame, DataFrame]:
    """(batch, idx, feat) gradients of queries and of references for pairs with upstream gradient g.

    Squared L2: 2 g (q - r) to the query; L1: g where q > r, else -g, at equality too. References get the negative sums.
    The ball-query gradient is the same over its selected pairs.
    """
    each = (lambda g, q, r: 2 * g * (q.cast("double") - r)) if norm == 2 else (lambda g, q, r: F.when(q > r, g).otherwise(-g))
    rows = _difference(found, x, y, each)
    q = collect_features(rows, ["batch", "q"], F.sum("v")).withColumnRenamed("q", "idx")
    r = collect_features(rows, ["batch", "ref"], -F.sum("v")).withColumnRenamed("ref", "idx")
    return q, r


def chamfer_gradients(x: DataFrame, y: DataFrame, cloud_x: DataFrame, cloud_y: DataFrame, dim: int = 3, norm: int = 2, point_reduction: str = "mean", batch_reduction: str = "mean", weights: DataFrame | None = None, single_directional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batch, idx, feat) gradients of ``chamfer_distance`` for the points of x and of y, through both reductions and directions.

    A pair's upstream gradient is its batch's weight, over the points of its cloud for point mean, over the batches or the
    sum of weights for batch mean. Through max it goes to the pair of the farthest point alone, the first of equal ones, of the direction
    with the larger maximum, and halves where the directions are equal. Points that no pair names have no row.
    """
    if point_reduction not in ("mean", "sum", "max") or batch_reduction not in ("mean", "sum"):
        raise ValueError("gradients go through mean, sum and max of points and through mean and sum of batches")
    w = cloud_x.select("batch").withColumn("w", F.lit(1.0)) if weights is None else cloud_x.select("batch").join(weights.select("batch", F.col("w").cast("double")), "batch")
    if batch_reduction == "mean":
        total = w.agg(F.sum("w").alias("t")).select(F.when(F.col("t") > 0, F.col("t")).otherwise(1.0).alias("t"))
        w = w.crossJoin(F.broadcast(total)).select("batch", (F.col("w") / F.col("t")).alias("w"))  # one row

    px, py = places(x, dim), places(y, dim)
    trees = plant(px, py, dim, 1)
    found = [point_losses(px, py, dim, norm, trees)] + ([] if single_directional else [point_losses(py, px, dim, norm, trees and (trees[1], trees[0]))])
    if point_reduction == "max":  # the farthest point is the first of its place
        top = F.max(F.struct("d", (-F.col("q")).alias("low"), "ref")).alias("b")
        found = [cut(f.groupBy("batch").agg(top).select("batch", (-F.col("b.low")).alias("q"), "b.ref", "b.d")) for f in found]
        most = w
        for i, f in enumerate(found):
            most = most.join(f.select("batch", F.col("d").alias(f"d{i}")), "batch", "left").withColumn(f"d{i}", F.coalesce(f"d{i}", m.flit(0)))
        share = lambda i: F.lit(1.0) if single_directional else F.when(F.col(f"d{i}") > F.col(f"d{1 - i}"), 1.0).when(F.col(f"d{i}") == F.col(f"d{1 - i}"), 0.5).otherwise(0.0)
        up = [most.select("batch", (F.col("w") * share(i)).alias("g")).where("g <> 0") for i in range(len(found))]
    else:
        found = [spread(f, own, dim) for f, own in zip(found, (x, y), strict=False)]
        up = [c.join(w, "batch").select("batch", (F.col("w") / F.greatest(F.col("n"), F.lit(1)) if point_reduction == "mean" else F.col("w")).alias("g")) for c in (cloud_x, cloud_y)]
    to_x, to_y = pair_gradients(found[0].join(up[0], "batch"), x, y, norm)
    if not single_directional:
        back_y, back_x = pair_gradients(found[1].join(up[1], "batch"), y, x, norm)
        added = lambda u, v: collect_features(explode_features(u.unionByName(v)), ["batch", "idx"], F.sum("v"))
        to_x, to_y = added(to_x, back_x), added(to_y, back_y)
    return to_x, to_y
