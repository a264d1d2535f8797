"""Adapters from long tables to the rectangular shapes of tensor interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import knn as _knn


def matrix(found: DataFrame, *columns: str) -> DataFrame:
    """(batch, q, columns as arrays in slot order) of rows (batch, q, slot, ...)."""
    rows = found.groupBy("batch", "q").agg(F.array_sort(F.collect_list(F.struct("slot", *columns))).alias("s"))
    return rows.select("batch", "q", *[F.col(f"s.{c}").alias(c) for c in columns])


def channel_first(features: DataFrame, channels: int) -> DataFrame:
    """(batch, c, values) in index order of rows (batch, idx, feat)."""
    rows = features.select("batch", "idx", F.posexplode(F.slice("feat", 1, channels)).alias("c", "v"))
    return rows.groupBy("batch", "c").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s")).select("batch", "c", F.col("s.v").alias("values"))


def edge_index(edges: DataFrame) -> DataFrame:
    """(src, dst) as BIGINT, the form of a two-row edge index."""
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))


class KNN:
    """Facade with a fixed k: ``KNN(k)(ref, query)`` gives (batch, q, dist, idx) arrays."""

    def __init__(self, k: int, dim: int = 3):
        self.k, self.dim = k, dim

    def __call__(self, ref: DataFrame, query: DataFrame) -> DataFrame:
        return matrix(_knn.knn(query, ref, self.k, self.dim), "dist", "ref").withColumnRenamed("ref", "idx")
