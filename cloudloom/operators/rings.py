"""k-nearest neighbours on a uniform grid: an equi-join with the cells of widening rings, which queries leave as their bound is met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metric as m
from ..plans.order import cut, discard
from .knn import knn, smallest

RINGS = ((0, 1), (2, 3), (4, 7))  # of the rounds, counted from the first ring that meets the box of the references
FAR = 8  # first rings from here on hold much of the cloud at once: their queries go to the pyramids
LARGEST_CELL = 1e9  # beyond, cells are finer than their rounding


def _cell(pos: Column, i: int, size: float) -> Column:
    return F.floor(pos[i].cast("double") / F.lit(float(size)))


def _boxes(cells: DataFrame, dim: int) -> DataFrame:
    """(batch, lo0, hi0, ..) over the occupied cells."""
    return cells.groupBy("batch").agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(dim) for f, n in ((F.min, "lo"), (F.max, "hi"))])


def _largest(values: list[Column]) -> Column:
    return F.greatest(*values, F.lit(0).cast("long"))


def _around(active: DataFrame, lo: int, hi: int, dim: int) -> DataFrame:
    """The cells of rings first + lo to first + hi of each query that lie in the box of its references."""
    out = active.withColumn("__lo", F.col("first") + lo).withColumn("__hi", F.col("first") + hi)
    for i in range(dim):
        low, high = F.greatest(F.col(f"q{i}") - F.col("__hi"), F.col(f"lo{i}")), F.least(F.col(f"q{i}") + F.col("__hi"), F.col(f"hi{i}"))
        out = out.where(low <= high).withColumn(f"c{i}", F.explode(F.sequence(low, high)))
    return out.where(_largest([F.abs(F.col(f"c{i}") - F.col(f"q{i}")) for i in range(dim)]) >= F.col("__lo"))


def grid_knn(query: DataFrame, ref: DataFrame, k: int, size: float, dim: int = 3, rings: tuple = RINGS) -> DataFrame:
    """(batch, q, slot, ref, dist): the rows of ``knn``, by cells of width ``size``.

    A query starts at the first ring of cells around its own that meets the box of the occupied cells, and looks only at cells
    in that box. It leaves when its k-th distance is less than any in the next ring, or no ring is left. Queries that are still there after
    ``rings`` (sparse surroundings, cells much too fine) go to ``knn``, and so do at once those that start FAR rings out, to which a ring is a
    slab that can hold the whole cloud. Points that
    are not finite and distances that overflow take no part; ties go to the smaller index. Sizes that make cell numbers
    larger than LARGEST_CELL are refused.
    """
    m.check_count(k)
    if not 1 <= dim <= 3:
        raise ValueError("a grid has one to three dimensions")
    if not (size > 0 and size < float("inf")):
        raise ValueError("the width of cells must be positive and finite")
    points = ref.select("batch", F.col("idx").alias("ref"), F.col("pos").alias("rpos")).where(m.all_finite(F.slice("pos", 1, dim)))
    points = cut(points.select("*", *[_cell(F.col("rpos"), i, size).alias(f"c{i}") for i in range(dim)]))
    boxes = _boxes(points, dim)
    asked = query.select("batch", F.col("idx").alias("q"), F.col("pos").alias("qpos")).where(m.all_finite(F.slice("pos", 1, dim)))
    asked = asked.select("*", *[_cell(F.col("qpos"), i, size).alias(f"q{i}") for i in range(dim)]).join(boxes, "batch")
    axis = [(F.col(f"q{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(dim)]
    first = _largest([F.greatest(lo - q, q - hi) for q, lo, hi in axis])
    last = _largest([F.greatest(F.abs(lo - q), F.abs(hi - q)) for q, lo, hi in axis])
    asked = asked.withColumn("first", first).withColumn("last", last)
    asked = asked.withColumn("wide", F.greatest(*[F.abs(c.cast("double")) for a in axis for c in a]))
    active = cut(asked)
    widest = active.agg(F.max("wide")).first()[0] or 0
    if widest > LARGEST_CELL:
        raise ValueError(f"cells of width {size} are too fine for these coordinates")
    away = active.where(F.col("first") >= FAR).select("batch", F.col("q").alias("idx"), F.col("qpos").alias("pos"))
    far, active = not away.isEmpty(), active.where(F.col("first") < FAR)
    settled, best = [], None
    for lo, hi in rings:
        if far and active.isEmpty():
            active = None
            break
        near = _around(active, lo, hi, dim).join(points, ["batch", *[f"c{i}" for i in range(dim)]])
        near = near.select("batch", "q", "ref", m.d2(F.col("qpos"), F.col("rpos"), dim).alias("d")).where(m.finite(F.col("d")))
        found = near if best is None else near.union(best.join(active, ["batch", "q"], "left_semi").select("batch", "q", "ref", "d"))
        best = cut(smallest(found, k))
        # whatever lies beyond ring r differs by r cells on some axis, less what rounding of cells and distances may take
        reach = F.greatest((F.col("first") + hi) * (1 - 1e-5) - F.col("wide") * 1e-12, F.lit(0.0)) * float(size)
        kth = best.groupBy("batch", "q").agg(F.count("*").alias("n"), F.max("d").alias("kth"))
        seen = cut(active.join(kth, ["batch", "q"], "left").withColumn("done", (F.col("first") + hi >= F.col("last")) | F.coalesce((F.col("n") >= k) & (F.col("kth").cast("double") < reach * reach), F.lit(False))))
        settled.append(best.join(seen.where("done"), ["batch", "q"], "left_semi"))
        active = seen.where(~F.col("done")).drop("n", "kth", "done")
        if active.isEmpty():
            active = None
            break
    discard(points)
    parts = [found.select("batch", "q", "slot", "ref", m.root(F.col("d")).alias("dist")) for found in settled]
    rest = [away] if far else []
    if active is not None:
        rest.append(active.select("batch", F.col("q").alias("idx"), F.col("qpos").alias("pos")))
    if rest:
        parts.append(knn(reduce(DataFrame.union, rest), ref, k, dim, drop_nonfinite=True))
    return reduce(DataFrame.union, parts)
