"""Farthest-point sampling: one cloud per task, or distributed steps for clouds that no task should hold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import metric as m
from ..ingest import with_batch
from ..plans.order import cut, discard

NEAR = np.float32(1e-3)
CELLS = 4_096  # cells of a distributed sample, of all its clouds; of more clouds, one each
TOPS = 4  # points of each that a pass sends to the driver


def farthest(points: np.ndarray, count: int, start: int = 0, skip_near_origin: bool = False) -> np.ndarray:
    """Row numbers of a greedy farthest-point sample in single precision.

    The next point maximises the least squared distance to those chosen, the smaller row on ties. Points
    with squared norm below 1e-3 are never picked when skipped, but for the start; when none is left, row 0 is.
    """
    p = np.asarray(points, np.float32)
    out = np.zeros(count, np.int64)
    if not count:
        return out
    norm = (p[:, 0] * p[:, 0] + p[:, 1] * p[:, 1]) + p[:, 2] * p[:, 2]
    barred = norm < NEAR if skip_near_origin else np.zeros(len(p), bool)
    least = np.full(len(p), np.inf, np.float32)
    out[0] = start
    for t in range(1, count):
        d = p - p[out[t - 1]]
        least = np.minimum(least, (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2])
        out[t] = int(np.argmax(np.where(barred, np.float32(-np.inf), least)))
    return out


LEAF = 128  # points of a box, at most
PLAIN = 4_096  # points up to which all distances are computed
SLACK = 1e-6  # relative, above what single-precision distances are off by


def _leaves(p: np.ndarray) -> np.ndarray:
    """Rows of ``p`` in boxes of LEAF at most by halving the widest axis: (box, place), each ascending, short ones filled with their last row."""
    parts, out = [np.arange(len(p))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= LEAF:
            out.append(np.sort(rows))
            continue
        own = p[rows]
        axis, half = int(np.argmax(own.max(axis=0) - own.min(axis=0))), len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        parts += [rows[order[:half]], rows[order[half:]]]
    size = max(map(len, out))
    return np.stack([np.pad(rows, (0, size - len(rows)), mode="edge") for rows in out])


def farthest_in_boxes(points: np.ndarray, count: int, start: int = 0, skip_near_origin: bool = False) -> tuple[np.ndarray, int]:
    """The rows of ``farthest`` for finite points, and the number of distances computed.

    A pick lowers least distances only in boxes that are nearer to it than their largest least distance, so ever fewer boxes are
    gone through as the sample gets dense. Once all least distances are 0 every further pick is the same row.
    """
    p = np.asarray(points, np.float32)
    out = np.zeros(count, np.int64)
    if not count:
        return out, 0
    rows = _leaves(p)
    pos = p[rows]
    lo, hi = pos.min(axis=1).astype(float), pos.max(axis=1).astype(float)
    least = np.full(rows.shape, np.inf, np.float32)
    if skip_near_origin:
        least[((pos[..., 0] * pos[..., 0] + pos[..., 1] * pos[..., 1]) + pos[..., 2] * pos[..., 2]) < NEAR] = -np.inf
    top, best, compared = least.max(axis=1), rows[np.arange(len(rows)), least.argmax(axis=1)], 0
    out[0] = start
    for t in range(1, count):
        at = p[out[t - 1]]
        gap = np.maximum(np.maximum(lo - at, at - hi), 0)
        use = np.flatnonzero((gap * gap).sum(axis=1) * (1 - SLACK) <= top)
        with np.errstate(over="ignore"):
            d = pos[use] - at
            low = np.minimum(least[use], (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]) + d[..., 2] * d[..., 2])
        compared += low.size
        least[use], top[use] = low, low.max(axis=1)
        best[use] = rows[use, low.argmax(axis=1)]
        most = top.max()
        out[t] = best[top == most].min() if most > -np.inf else 0
        if most <= 0:
            out[t:] = out[t]
            break
    return out, compared


_SCHEMA = "batch long, slot int, idx long"


def _sample(points: DataFrame, count: Column, start: Column | None, skip: bool) -> DataFrame:
    """(batch, slot, idx) with the number of samples and first local row (0 for None) of each cloud in columns.

    Points of one place have equal distances and the first of them is picked, so a task gets the first of each place and the start.
    """
    rows = points.select("batch", "idx", *[F.col("pos")[i].alias(c) for i, c in enumerate("xyz")], count.cast("long").alias("count"), *([] if start is None else [start.cast("long").alias("start")]))
    sent = rows.groupBy("batch", "x", "y", "z").agg(F.min("idx").alias("idx"), F.first("count").alias("count")).withColumn("begin", F.lit(False))
    if start is not None:
        number = F.row_number().over(Window.partitionBy("batch").orderBy("idx")) - 1
        size = rows.groupBy("batch").agg(F.count("*").alias("n"))
        begin = rows.withColumn("at", number).join(size, "batch").where("at = start % n").select("batch", "x", "y", "z", "idx", "count", F.lit(True).alias("begin"))
        sent = sent.unionByName(begin)

    def one(t: pa.Table) -> pa.Table:
        idx = t.column("idx").to_numpy()
        order = np.argsort(idx, kind="stable")
        idx, begin = idx[order], np.flatnonzero(t.column("begin").to_numpy()[order])
        p = np.stack([t.column(c).to_numpy()[order] for c in "xyz"], axis=1)
        asked, first = int(t.column("count")[0].as_py()), int(begin[0]) if len(begin) else 0
        at = farthest_in_boxes(p, asked, first, skip)[0] if len(p) > PLAIN and asked > 1 and np.isfinite(p).all() else farthest(p, asked, first, skip)
        columns = [pa.array([t.column("batch")[0].as_py()] * len(at), pa.int64()), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(idx[at])]
        return pa.table(columns, names=["batch", "slot", "idx"])

    return sent.groupBy("batch").applyInArrow(one, _SCHEMA)


def furthest_point_sample(points: DataFrame, npoint: int, start_idx: int = 0, skip_near_origin: bool = False) -> DataFrame:
    """(batch, slot, idx): npoint samples of each cloud; one task holds the places of one cloud. See ``distributed`` for larger ones."""
    m.check_count(npoint, "npoint")
    return _sample(points, F.lit(npoint), F.lit(start_idx) if start_idx else None, skip_near_origin)


def sampled_from_origin_free(points: DataFrame, npoint: int) -> DataFrame:
    """The compatibility preset: near-origin points skipped, indices INT."""
    return furthest_point_sample(points, npoint, 0, True).withColumn("idx", F.col("idx").cast("int"))


def ratio_count(n: Column, ratio: float) -> Column:
    """ceil of the float32 product of n and the ratio."""
    return F.ceil((n.cast("float") * m.flit(ratio)).cast("float"))


def ratio_fps(points: DataFrame, ratio: float | None = 0.5, random_start: bool = False, seed: int = 0) -> DataFrame:
    """(batch, slot, idx) with global indices: ceil(n * ratio) samples a cloud, more than n above ratio 1.

    A random start is a digest of (seed, batch) modulo the size, so it is the same in every run.
    """
    ratio = 0.5 if ratio is None else ratio
    if ratio < 0 or not math.isfinite(ratio):
        raise ValueError("ratio must be finite and not negative")
    sized = points.join(points.groupBy("batch").agg(F.count("*").alias("__n")), "batch")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("batch")), F.col("__n")) if random_start else None
    return _sample(sized, ratio_count(F.col("__n"), ratio), start, False)


def ptr_fps(points: DataFrame, ptr: DataFrame, ratio: float | None = 0.5, random_start: bool = True, seed: int = 0) -> DataFrame:
    """``ratio_fps`` of flat points (idx, pos) in pointer-coded clouds (batch, lo, hi)."""
    return ratio_fps(with_batch(points, ptr).where("batch is not null"), ratio, random_start, seed)


def offset_fps(points: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch, slot, idx) with counts (batch, m) from the offset interface; a request beyond the cloud raises."""
    sized = points.join(points.groupBy("batch").agg(F.count("*").alias("__n")), "batch").join(counts.select("batch", "m"), "batch")
    if sized.where("m > __n").limit(1).count():
        raise ValueError("more samples asked than points")
    return _sample(sized, F.col("m"), None, False).withColumn("idx", F.col("idx").cast("int"))


def _squared(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = points - at
    with np.errstate(over="ignore", invalid="ignore"):
        return (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]


def certain_picks(cand: pd.DataFrame, box: pd.DataFrame, most: int) -> list[int]:
    """Rows of ``cand`` that a greedy sample picks next, as far as the candidates prove it; always one at least.

    ``cand`` (cell, idx, x, y, z, least) holds the TOPS farthest points of each cell, ``box`` (cell, n, x0.., x1..) all cells. Points that are not
    candidates are no farther than the last candidate of their cell was, nor than the far corner of the cell from any pick. A pick is
    certain while it is farther than all of these.
    """
    cell = np.searchsorted(box["cell"].to_numpy(), cand["cell"].to_numpy())
    pos, idx, least = cand[["x", "y", "z"]].to_numpy(np.float32), cand["idx"].to_numpy(), cand["least"].to_numpy(np.float32).copy()
    bound = np.full(len(box), np.inf)
    np.minimum.at(bound, cell, least.astype(float))
    bound[box["n"].to_numpy() <= TOPS] = -np.inf  # all points of the cell are candidates
    lo, hi = (box[[f"{c}{s}" for c in "xyz"]].to_numpy(float) for s in (0, 1))
    picks: list[int] = []
    while len(picks) < most:
        top = least.max()
        best = np.flatnonzero(least == top)
        row = int(best[np.argmin(idx[best])])
        if picks and not top > bound.max(initial=-np.inf):
            break
        picks.append(row)
        least = np.fmin(least, _squared(pos, pos[row]))
        at = pos[row].astype(float)
        span = np.maximum(np.abs(lo - at), np.abs(hi - at))
        bound = np.fmin(bound, (span * span).sum(axis=1) * (1 + 1e-6) + 1e-37)
    return picks


def distributed(points: DataFrame, npoint: int, start_idx: int = 0) -> DataFrame:
    """The same sample for clouds beyond one task's memory: several picks with each pass over the points.

    Points are ranked by index; the start is an index. Each cloud is cut in cells, CELLS in all at most. A pass lowers the least distances of
    all points by the last picks and sends the TOPS farthest points of every cell to the driver, which goes on picking until a
    point it does not have could be farther; see ``certain_picks``. Least distances are written after each pass.
    """
    m.check_count(npoint, "npoint")
    spark = points.sparkSession
    chosen = {r["batch"]: [(r["idx"], r["pos"])] for r in points.where(F.col("idx") == start_idx).select("batch", "idx", "pos").collect()}  # one point per cloud
    edge = points.agg(*[f(F.col("pos")[i].cast("double")) for f in (F.min, F.max) for i in range(3)]).first()
    side = max(1, int((CELLS / max(1, len(chosen))) ** (1 / 3)))
    axes = [F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.col("pos")[i].cast("double") - (edge[i] or 0.0)) / max((edge[i + 3] or 0.0) - (edge[i] or 0.0), 1e-30) * side))) for i in range(3)]
    cell = F.coalesce((axes[0] * side + axes[1]) * side + axes[2], F.lit(-1)).cast("long")
    state = cut(points.select("batch", "idx", "pos", cell.alias("cell"), m.flit(float("inf")).alias("least")))
    sides = [f(F.col("pos")[i]).alias(f"{c}{s}") for i, c in enumerate("xyz") for s, f in ((0, F.min), (1, F.max))]
    boxes = dict(list(state.groupBy("batch", "cell").agg(F.count("*").alias("n"), *sides).orderBy("batch", "cell").toPandas().groupby("batch"))) if npoint > 1 else {}
    fresh = {b: [p for _, p in own] for b, own in chosen.items()}
    rank = F.row_number().over(Window.partitionBy("batch", "cell").orderBy(F.desc("least"), "idx"))
    while npoint and any(len(own) < npoint for own in chosen.values()):
        last = spark.createDataFrame(list(fresh.items()), "batch long, at array<array<float>>")
        near = F.array_min(F.transform("at", lambda a: m.d2(a, F.col("pos"), 3)))
        lowered = cut(state.join(F.broadcast(last), "batch").select("batch", "idx", "pos", "cell", F.least("least", near).alias("least")))  # the picks of a pass
        discard(state)
        state = lowered
        tops = state.withColumn("rn", rank).where(F.col("rn") <= TOPS).select("batch", "cell", "idx", *[F.col("pos")[i].alias(c) for i, c in enumerate("xyz")], "least").toPandas()
        fresh = {}
        for b, cand in tops.groupby("batch"):
            cand = cand.reset_index(drop=True)
            rows = certain_picks(cand, boxes[b].reset_index(drop=True), npoint - len(chosen[b]))
            fresh[int(b)] = [[float(v) for v in cand.loc[r, ["x", "y", "z"]]] for r in rows]
            chosen[b] += [(int(cand.loc[r, "idx"]), None) for r in rows]
    discard(state)
    return spark.createDataFrame([(int(b), t, i) for b, own in chosen.items() for t, (i, _) in enumerate(own[:npoint])], _SCHEMA)
