"""Candidates of exact nearest-neighbour searches: all pairs of small clouds, else what a descent of occupancy pyramids finds."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import metric as m
from ..plans.order import cut
from .pyramid import Pyramid, finite_points, nearest

SCAN = 4_000_000  # pairs up to which all are compared: less work than the steps of a descent


def few(query: DataFrame, ref: DataFrame) -> bool:
    """Whether the points of equal batches make up SCAN pairs at most."""
    n = query.groupBy("batch").agg(F.count("*").alias("n")).join(ref.groupBy("batch").agg(F.count("*").alias("m")), "batch")
    return (n.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0) <= SCAN


def pairs(query: DataFrame, ref: DataFrame, dim: int, distance=m.d2) -> DataFrame:
    """(batch, q, ref, d) of all points of equal batches."""
    q = query.select("batch", F.col("idx").alias("q"), F.col("pos").alias("qpos"))
    r = ref.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("rpos"))
    return q.join(r, "batch").select("batch", "q", "ref", distance(F.col("qpos"), F.col("rpos"), dim).alias("d"))


def by_place(query: DataFrame, dim: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows (batch, q, ...) of ``search``, which is asked with the first point of each place alone, for all points of that place.

    Rows of a place travel as one array, so that copies cost a row each. Both joins are by shuffle: their sizes can't be foretold.
    """
    own = query.select("batch", F.col("idx").alias("q"), F.slice("pos", 1, dim).alias("place"))
    first = cut(own.groupBy("batch", "place").agg(F.min("q").alias("first")))
    found = search(first.select("batch", F.col("first").alias("idx"), F.col("place").alias("pos")))
    packed = found.groupBy("batch", F.col("q").alias("first")).agg(F.collect_list(F.struct(*[c for c in found.columns if c not in ("batch", "q")])).alias("rows"))
    at = first.hint("merge").join(packed, ["batch", "first"]).select("batch", "place", "rows")
    return own.hint("merge").join(at, ["batch", "place"]).select("batch", "q", F.inline("rows"))


def places(points: DataFrame, dim: int) -> DataFrame:
    """(batch, idx, pos, copies): the first point of each place, which nearest neighbours of one point alone depend on, with the number of points there."""
    at = points.groupBy("batch", F.slice("pos", 1, dim).alias("pos")).agg(F.min("idx").alias("idx"), F.count("*").alias("copies"))
    return cut(at.select("batch", "idx", "pos", "copies"))


Trees = tuple[Pyramid, Pyramid]


def plant(query: DataFrame, ref: DataFrame, dim: int, k: int, rank: Column | None = None) -> Trees | None:
    """Pyramids of both clouds, built side by side; None where all pairs are compared."""
    if k == 0 or dim > 3 or few(query, ref):
        return None
    if query is ref:
        own = Pyramid.build(finite_points(ref, dim, rank), dim, k)
        return own, own
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(inheritable_thread_target(query.sparkSession)(Pyramid.build), finite_points(points, dim, order), dim, k) for points, order in ((query, None), (ref, rank))]
        return jobs[0].result(), jobs[1].result()


def candidates(query: DataFrame, ref: DataFrame, k: int, dim: int, norm: int = 2, rank: Column | None = None, infinite: bool = True, trees: Trees | None = None) -> DataFrame:
    """(batch, q, ref, d): at least the k smallest (d, rank) of each query that are not NaN; the rank is an integer over ``ref``, by default its index.

    norm 2 gives squared distances, 1 absolute ones. Without ``infinite``, points that are not finite have no rows. ``trees``
    are those of ``plant``, if they are there already.
    """
    distance = m.d2 if norm == 2 else m.l1
    trees = trees or plant(query, ref, dim, k, rank)
    if trees is None:
        return pairs(query, ref, dim, distance)
    found = nearest(*trees, k, norm)
    if not infinite:
        return found
    # a reference that is not finite is at an infinite distance from all finite queries, so only the first ones count
    axes = F.slice("pos", 1, dim)
    fine, number = m.all_finite(axes), Window.partitionBy("batch").orderBy("idx" if rank is None else rank)
    odd = ref.where(~fine & ~F.exists(axes, F.isnan)).withColumn("__n", F.row_number().over(number)).where(F.col("__n") <= k).drop("__n")
    return found.union(pairs(query.where(fine), odd, dim, distance)).union(pairs(query.where(~fine), ref, dim, distance))
