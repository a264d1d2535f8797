"""Index joins: gather, grouping, interpolation and their gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metric as m
from . import knn as _knn


def gather(features: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``index`` (batch, ..., ref) with the features (batch, idx, feat) of the point each names."""
    return index.join(features.select("batch", F.col("idx").alias("ref"), "feat"), ["batch", "ref"])


def zeros(n: int) -> Column:
    return F.array_repeat(m.flit(0), n)


def grouping(neighbours: DataFrame, features: DataFrame, points: DataFrame, centres: DataFrame, channels: int, with_xyz: bool = True) -> DataFrame:
    """(batch, q, slot, ref, feat): features of each neighbour, after its position relative to the centre; zeros at ref -1."""
    feat = features.select("batch", F.col("idx").alias("ref"), F.col("feat").alias("f"))
    out = neighbours.join(feat, ["batch", "ref"], "left").withColumn("feat", F.coalesce("f", zeros(channels)))
    if with_xyz:
        at = points.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("rpos"))
        centre = centres.select("batch", F.col("idx").alias("q"), F.col("pos").alias("qpos"))
        out = out.join(at, ["batch", "ref"], "left").join(centre, ["batch", "q"])
        relative = F.coalesce(F.zip_with("rpos", "qpos", lambda r, q: r - q), zeros(3))
        out = out.withColumn("feat", F.concat(relative, F.col("feat")))
    return out.select("batch", "q", "slot", "ref", "feat")


def query_and_group(features: DataFrame, points: DataFrame, centres: DataFrame, nsample: int, channels: int, neighbours: DataFrame | None = None, with_xyz: bool = True) -> DataFrame:
    found = neighbours if neighbours is not None else _knn.offset_knn(centres, points, nsample).drop("dist")
    return grouping(found, features, points, centres, channels, with_xyz)


def pair_d2(query: DataFrame, ref: DataFrame, chosen: DataFrame, dim: int = 3) -> DataFrame:
    """(batch, q, slot, ref, d): squared distances of pairs already chosen."""
    q = query.select("batch", F.col("idx").alias("q"), F.col("pos").alias("qpos"))
    r = ref.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("rpos"))
    return chosen.select("batch", "q", "slot", "ref").join(q, ["batch", "q"]).join(r, ["batch", "ref"]).select("batch", "q", "slot", "ref", m.d2(F.col("qpos"), F.col("rpos"), dim).alias("d"))


def explode_features(df: DataFrame, column: str = "feat") -> DataFrame:
    """A row per channel: c and v in place of the array."""
    return df.select("*", F.posexplode(column).alias("c", "v")).drop(column)


def collect_features(df: DataFrame, keys: list[str], value: Column, kind: str = "float") -> DataFrame:
    """The array again from (keys, c) groups: ``value`` is an aggregate of each channel."""
    per = df.groupBy(*keys, "c").agg(value.cast(kind).alias("v"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s.v).alias("feat"))


def three_interpolate(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(batch, q, feat) = sum over slots 0..2 of weight * feature, added in slot order in single precision.

    weights: (batch, q, slot, ref, w FLOAT).
    """
    rows = gather(features, weights)
    scaled = F.transform("feat", lambda x: (x * F.col("w")).cast("float"))
    slots = rows.groupBy("batch", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", scaled.alias("f")))), lambda s: s.f).alias("fs"))
    total = F.zip_with(F.zip_with(F.col("fs")[0], F.col("fs")[1], lambda a, b: a + b), F.col("fs")[2], lambda a, b: a + b)
    return slots.select("batch", "q", total.alias("feat"))


def three_interpolate_grad(grad: DataFrame, weights: DataFrame, kind: str = "float") -> tuple[DataFrame, DataFrame]:
    """(batch, ref, feat) gradients of the features, as ``kind``, and (batch, q, slot, w) of the weights, which are zero."""
    g = weights.join(grad.select("batch", "q", "feat"), ["batch", "q"]).withColumn("feat", F.transform("feat", lambda x: x * F.col("w")))
    return collect_features(explode_features(g), ["batch", "ref"], F.sum("v"), kind), weights.select("batch", "q", "slot", m.flit(0).alias("w"))


def inverse_distance_weights(found: DataFrame) -> DataFrame:
    """w = (1 / (dist + 1e-8)) over its sum by query; missing neighbours (ref < 0) weigh 0, and all do where none is left."""
    raw = F.when(F.col("ref") >= 0, (F.lit(1.0) / (F.col("dist") + 1e-8))).otherwise(F.lit(0.0))
    r = found.withColumn("raw", raw)
    total = r.groupBy("batch", "q").agg(F.sum("raw").alias("total"))
    return r.join(total, ["batch", "q"]).withColumn("w", (F.col("raw") / F.greatest(F.col("total"), F.lit(1e-20))).cast("float")).drop("raw", "total")


def interpolation(points: DataFrame, targets: DataFrame, features: DataFrame, channels: int, k: int = 3, kind: str = "float") -> DataFrame:
    """(batch, q, feat): inverse-distance mean of the features of the k nearest points, zeros where there is none.

    Sums are kept in double precision; ``kind`` double gives them as they are, for one who rounds them.
    """
    w = inverse_distance_weights(_knn.offset_knn(targets, points, k))
    f = features.select("batch", F.col("idx").alias("ref"), "feat")
    rows = w.join(f, ["batch", "ref"], "left").withColumn("feat", F.transform(F.coalesce("feat", zeros(channels)), lambda x: x * F.col("w")))
    return collect_features(explode_features(rows), ["batch", "q"], F.sum("v"), kind)


def edge_features(points: DataFrame, k: int, dim: int) -> DataFrame:
    """(batch, q, feat): channel-wise maximum over the k nearest of concat(f_i, relu(f_j - f_i)), an edge convolution with fixed weights."""
    found = _knn.knn(points, points, k, dim)
    a = points.select("batch", F.col("idx").alias("q"), F.col("pos").alias("fi"))
    b = points.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("fj"))
    rows = found.join(a, ["batch", "q"]).join(b, ["batch", "ref"])
    feat = F.concat(F.col("fi"), F.zip_with("fj", "fi", lambda x, y: F.greatest(x - y, m.flit(0))))
    return collect_features(explode_features(rows.select("batch", "q", feat.alias("feat"))), ["batch", "q"], F.max("v"))
