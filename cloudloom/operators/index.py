"""Z-ordered index over an occupancy pyramid: exact nearest neighbours and radius search; may be written to a path and opened again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metric as m
from ..functions import morton
from ..plans.order import cut
from . import pruned, pyramid
from .knn import smallest
from .loss import pair_gradients
from .pyramid import Pyramid, finite_points
from .radius import TINY, ball_query

LOCAL = 64  # ranges of blocks that a search reads of the table at most


def morton_keys(points: DataFrame, origin, cell_size) -> DataFrame:
    """(batch, idx, pos, key, invalid)."""
    key, bad = morton.keys(F.col("pos"), tuple(origin), tuple(cell_size))
    return points.select("batch", "idx", "pos", key.alias("key"), bad.alias("invalid"))


def hot_cell_fraction(points: DataFrame, origin, cell_size) -> DataFrame:
    """(fraction): share of the points in the fullest cell."""
    per = morton_keys(points, origin, cell_size).groupBy("key").agg(F.count("*").alias("n"))
    return per.agg((F.max("n") / F.sum("n")).alias("fraction"))


@dataclass
class SpatialIndex:
    """Points (batch, idx, pos) in z-order, in blocks with boxes under an occupancy pyramid; points that are not finite are left out.

    ``backend``: scan compares all pairs; blocks descends the pyramid; auto scans where points times queries are few.
    Built once, it serves any number of searches. With a path it is a table of blocks in z-order, whose row groups have the boxes as
    statistics, beside one of the upper nodes; ``open`` reads it again, in any session.
    """

    tree: Pyramid
    backend: str = "auto"

    @classmethod
    def build(cls, points: DataFrame, backend: str = "auto", block: int = pyramid.BLOCK, path: str | None = None, front: int = 32) -> SpatialIndex:
        """``front``: searches for at most so many neighbours look at no more than so many points of one place."""
        _check_backend(backend)
        tree = Pyramid.build(finite_points(points, 3), 3, front, f"{path}/blocks" if path else None, block)
        return cls(tree.stored(f"{path}/nodes" if path else None), backend)

    @classmethod
    def open(cls, spark: SparkSession, path: str, backend: str = "auto", front: int = 32) -> SpatialIndex:
        """The index that ``build`` wrote to ``path`` with the same ``front``."""
        _check_backend(backend)
        return cls(Pyramid.of(spark.read.parquet(f"{path}/blocks"), 3, front, spark.read.parquet(f"{path}/nodes")), backend)

    @property
    def size(self) -> int:
        return self.tree.size

    @property
    def points(self) -> DataFrame:
        """(batch, idx, pos) of the indexed points."""
        at = self.tree.blocks.select("batch", "xyz", F.posexplode("ids").alias("at", "idx"))
        return at.select("batch", "idx", F.expr("slice(xyz, 3 * at + 1, 3)").alias("pos"))

    @property
    def blocks(self) -> DataFrame:
        """(batch, blk, n, lo, hi, min_idx)."""
        box = [F.array(*[f"{c}{i}" for i in range(3)]).alias(c) for c in ("lo", "hi")]
        return self.tree.blocks.select("batch", F.col("id").alias("blk"), "n", *box, F.array_min("ids").alias("min_idx"))

    def _scan(self, queries: DataFrame) -> bool:
        return self.backend == "scan" or self.backend == "auto" and self.size * queries.count() <= pruned.SCAN

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        """(batch, q, slot, ref, dist) as the plain search gives it; queries that are not finite have no rows but in a scan.

        Of the written blocks only the ranges that the descent leaves are read.
        """
        m.check_count(k)
        if k == 0 or self._scan(queries):
            found = pruned.pairs(queries, self.points, 3).where(~F.isnan("d"))
            return smallest(found, k).select("batch", "q", "slot", "ref", m.root(F.col("d")).alias("dist"))
        search = lambda places: smallest(pyramid.nearest(Pyramid.build(finite_points(places, 3), 3, 1), self.tree, k, ranges=LOCAL), k)
        return pruned.by_place(queries, 3, search).select("batch", "q", "slot", "ref", m.root(F.col("d")).alias("dist"))

    def ball_query(self, queries: DataFrame, radius: float, k: int) -> DataFrame:
        """(batch, q, slot, ref, dist2) as the plain search gives it: the first k references by index.

        ``auto`` joins by cells of the radius; blocks meet the blocks within the radius, unless its square is lost in single precision.
        """
        m.check_radius(radius, k)
        limit = m.dense_threshold(radius)
        if self.backend != "blocks" or k == 0 or m.f32(radius) < TINY or limit == float("inf"):
            return ball_query(queries, self.points, radius, k)
        asked = Pyramid.build(finite_points(queries, 3), 3, 1)
        return pyramid.within(asked, self.tree, limit, k, ranges=LOCAL).select("batch", "q", "slot", "ref", F.col("d").alias("dist2"))

    def distance_gradients(self, found: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(batch, idx, feat) gradients of queries and of indexed points for found pairs (batch, q, ref) with upstream gradient g of dist2."""
        return pair_gradients(found, queries.select("batch", "idx", "pos"), cut(self.points))


def _check_backend(backend: str) -> None:
    if backend not in ("auto", "scan", "blocks"):
        raise ValueError("backend must be auto, scan or blocks")
