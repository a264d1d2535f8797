"""k-nearest joins with the total order (squared distance, reference index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import metric as m
from ..ingest import with_batch
from . import pivots
from .pruned import Trees, by_place, candidates, few

CEILING = 1e10  # squared distances from here on count as missing in the offset interface
MISSING = 1e5
UNROLLED = 8  # dimensions up to which all pairs of small clouds are compared by generated code


def smallest(candidates: DataFrame, k: int) -> DataFrame:
    """(batch, q, slot, ref, d) of the k smallest (d, ref) of each query; Spark prunes before and after the shuffle."""
    w = Window.partitionBy("batch", "q").orderBy("d", "ref")
    return candidates.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("batch", "q", (F.col("rn") - 1).cast("int").alias("slot"), "ref", "d")


def knn(query: DataFrame, ref: DataFrame, k: int, dim: int = 3, drop_nonfinite: bool = False) -> DataFrame:
    """(batch, q, slot, ref, dist): Euclidean distance of the k nearest references of each query of equal batch.

    Fewer rows where a batch has fewer references. Dense three-dimensional clouds keep infinite distances; feature and flat searches
    drop what is not finite. NaN never ranks.
    """
    m.check_count(k)
    only_finite = drop_nonfinite or dim != 3
    wide = k and (dim > UNROLLED or dim > 3 and not few(query, ref))
    counts = lambda found: found.where(m.finite(F.col("d")) if only_finite else ~F.isnan("d"))
    if wide or k == 0 or dim > 3 or few(query, ref):
        found = smallest(counts(pivots.nearest(query, ref, k, dim) if wide else candidates(query, ref, k, dim, infinite=not only_finite)), k)
    else:
        found = by_place(query, dim, lambda places: smallest(counts(candidates(places, ref, k, dim, infinite=not only_finite)), k))
    return found.select("batch", "q", "slot", "ref", m.root(F.col("d")).alias("dist"))


def flat_knn(query: DataFrame, ref: DataFrame, k: int, dim: int = 3, cosine: bool = False) -> DataFrame:
    """Edges (q, ref, slot) with global indices, min(k, N_b) a query; non-finite distances are dropped."""
    if cosine:
        raise NotImplementedError("cosine distance")
    return knn(query, ref, k, dim, drop_nonfinite=True).select("q", "ref", "slot")


def dealt(points: DataFrame, ptr: DataFrame | None, other: DataFrame | None) -> DataFrame:
    """Flat points (idx, pos) with the batch that ``ptr`` (batch, lo, hi) gives them; all are one cloud without pointers of the references."""
    if other is None:
        return points.withColumn("batch", F.lit(0).cast("long"))
    if ptr is None:
        raise ValueError("pointers of the queries are needed beside those of the references")
    return with_batch(points, ptr).where("batch is not null")


def ptr_knn(query: DataFrame, ref: DataFrame, ptr_query: DataFrame | None = None, ptr_ref: DataFrame | None = None, k: int = 1, dim: int = 3, cosine: bool = False) -> DataFrame:
    """Edges (q, ref, slot) of flat points (idx, pos) in pointer-coded clouds; without ptr_ref all are one cloud and ptr_query is ignored."""
    return flat_knn(dealt(query, ptr_query, ptr_ref), dealt(ref, ptr_ref, ptr_ref), k, dim, cosine)


def turn(edges: DataFrame, loop: bool, flow: str) -> DataFrame:
    """(src, dst) edges of a self join (q, ref): self edges dropped after the search, ends swapped for source_to_target."""
    if flow not in ("source_to_target", "target_to_source"):
        raise ValueError("flow must be source_to_target or target_to_source")
    kept = edges if loop else edges.where("q <> ref")
    return kept.select(F.col("ref").alias("src"), F.col("q").alias("dst")) if flow == "source_to_target" else kept.select(F.col("q").alias("src"), F.col("ref").alias("dst"))


def knn_graph(points: DataFrame, k: int, dim: int = 3, loop: bool = False, flow: str = "source_to_target", cosine: bool = False) -> DataFrame:
    """(src, dst): the k (k+1 without loops, self dropped afterwards) nearest points of each point."""
    return turn(flat_knn(points, points, k if loop else k + 1, dim, cosine), loop, flow)


def padded(query: DataFrame, found: DataFrame, k: int, values: dict[str, Column]) -> DataFrame:
    """Exactly k slots a query: left join on a slot grid, missing columns filled."""
    grid = query.select("batch", F.col("idx").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot")) if k else query.select("batch", F.col("idx").alias("q"), F.lit(0).alias("slot")).limit(0)
    return grid.join(found, ["batch", "q", "slot"], "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def offset_knn(query: DataFrame, ref: DataFrame, nsample: int, dim: int = 3) -> DataFrame:
    """(batch, q, slot, ref INT, dist) with nsample slots; missing or at squared distance 1e10 and beyond is (-1, 1e5)."""
    near = lambda asked: smallest(candidates(asked, ref, nsample, dim, infinite=False).where(F.col("d") < CEILING), nsample)
    found = near(query) if nsample == 0 or dim > 3 or few(query, ref) else by_place(query, dim, near)
    found = found.select("batch", "q", "slot", F.col("ref").cast("int").alias("ref"), m.root(F.col("d")).alias("dist"))
    return padded(query, found, nsample, {"ref": F.lit(-1), "dist": m.flit(MISSING)})


def three_nn(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """The three nearest known points, indices INT; raises if an occupied batch has fewer than three known points."""
    few = unknown.select("batch").distinct().join(known.groupBy("batch").count(), "batch", "left").where("coalesce(count, 0) < 3")
    if few.limit(1).count():
        raise ValueError("each batch needs three known points")
    return knn(unknown, known, 3).withColumn("ref", F.col("ref").cast("int"))


def lane_rank(local: Column) -> Column:
    """Order of (local index mod 1024, local index)."""
    return F.shiftleft(local % 1024, 52).bitwiseOR(local)


def nearest(x: DataFrame, y: DataFrame, dim: int = 3) -> DataFrame:
    """(idx, nearest): for each x the global index of its nearest y of equal batch.

    Ties go to the smaller (local index mod 1024, local index); squared distances of 1e38 and beyond, or NaN, don't count, and
    without a neighbour the answer is 0. Raises unless the occupied batches agree.
    """
    bx, by = x.select("batch").distinct(), y.select("batch").distinct()
    if bx.join(by, "batch", "left_anti").limit(1).count() or by.join(bx, "batch", "left_anti").limit(1).count():
        raise ValueError("x and y must occupy the same batches")
    first = y.groupBy("batch").agg(F.min("idx").alias("first"))
    ranked = y.join(first, "batch").withColumn("rank", lane_rank(F.col("idx") - F.col("first"))).drop("first")
    found = candidates(x, ranked, 1, dim, rank=F.col("rank"), infinite=False).where((F.col("d") < m.FLOAT_MAX_KEY) & ~F.isnan("d")).join(first, "batch")
    best = found.groupBy("q").agg(F.min(F.struct("d", lane_rank(F.col("ref") - F.col("first")).alias("rank"), F.col("ref").alias("ref"))).alias("b"))
    return x.select(F.col("idx").alias("q")).join(best, "q", "left").select(F.col("q").alias("idx"), F.coalesce("b.ref", F.lit(0)).alias("nearest"))


def first_minimum(query: DataFrame, ref: DataFrame, dim: int = 3, norm: int = 2, trees: Trees | None = None) -> DataFrame:
    """(batch, q, ref, d): nearest reference under squared L2 or L1, smallest index on ties; -1 and 0 in an empty reference cloud."""
    if norm not in (1, 2):
        raise ValueError("norm must be 1 or 2")
    best = candidates(query, ref, 1, dim, norm, trees=trees).groupBy("batch", "q").agg(F.min(F.struct("d", "ref")).alias("b"))
    return query.select("batch", F.col("idx").alias("q")).join(best, ["batch", "q"], "left").select("batch", "q", F.coalesce("b.ref", F.lit(-1)).alias("ref"), F.coalesce("b.d", m.flit(0)).alias("d"))
