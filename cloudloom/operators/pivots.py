"""Exact nearest neighbours of wide vectors: blocks of vectors are left out by the triangle inequality over distances to pivots.

A vector's distances to a few pivots are its coordinates. Blocks of vectors near one pivot have boxes of these, and of two boxes the largest
gap on any axis bounds all distances from below, the least sum of distances to a pivot from above. The boxes form an occupancy
pyramid, which is descended as that of points is. Vectors in clusters meet their own surroundings; where all distances are
alike, as of independent noise, no bound parts them and all blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metric as m
from .pyramid import LEAST, MOST, Nearest, Pyramid, descend, finite_points, needed_pairs, searched

PIVOTS = 24
SAMPLE = 2_000  # vectors of which the pivots are taken
BLOCK = 256
GROWTH = 8  # times that size, of many vectors: a matrix product takes large blocks, and fewer pairs of blocks are listed
SPARSE = 0.1  # of pairs of two blocks that are summed up one by one
BOXES = 128  # compared with a block of queries at once
TILE = 8  # bits: 256 blocks of queries that a block of references is sent to at once, fewer if cores would have no tile of their own


def choose(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Pivots of a sample: each the vector farthest from those taken, the first that farthest from the mean."""
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    far = np.linalg.norm(vectors - vectors.mean(axis=0), axis=1)
    taken = [int(np.argmax(far))]
    least = np.linalg.norm(vectors - vectors[taken[0]], axis=1)
    while len(taken) < min(count, len(vectors)) and least.max() > 0:
        taken.append(int(np.argmax(least)))
        least = np.minimum(least, np.linalg.norm(vectors - vectors[taken[-1]], axis=1))
    return vectors[taken]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots in double precision, by differences: no cancellation."""
    out = np.empty((len(x), len(pivots)))
    x = x.astype(np.float64)
    for i, p in enumerate(pivots):
        step = x - p
        out[:, i] = np.sqrt((step * step).sum(axis=1))
    return out


def _least(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distances of boxes (row, end, pivot)."""
    gap = np.maximum(np.maximum(r[None, :, 0] - q[:, None, 1], q[:, None, 0] - r[None, :, 1]), 0).max(axis=2, initial=0.0)
    return gap * gap


class PivotNearest(Nearest):
    def __init__(self, ids: np.ndarray, pos: np.ndarray, k: int, pivots: np.ndarray):
        super().__init__(ids, pos, k, 2)
        own = to_pivots(pos, pivots)
        self.own, self.slack = np.stack([own, own], axis=1), slack(pos.shape[1])
        self.centre = pos.mean(axis=0, dtype=np.float64)
        near, self.square = self.centred(pos)
        self.left = np.concatenate([-2 * near, np.ones((len(pos), 1), np.float32)], axis=1)

    def centred(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors less the mean of the queries, in single precision, and their squared lengths: both are small where distances are."""
        with np.errstate(over="ignore"):
            near = (pos - self.centre).astype(np.float32)
        return near, np.square(near, dtype=np.float64).sum(axis=1)

    def least(self, box: np.ndarray) -> np.ndarray:
        """(query, box), some boxes at a time."""
        return np.concatenate([_least(self.own, box[at : at + BOXES]) for at in range(0, max(len(box), 1), BOXES)], axis=1)

    def hits(self, rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of all distances, but a matrix product first tells which pairs can be close enough; only these are summed up axis by axis.

        The product gives |r|^2 - 2 qr, off by less than slack * (|q|^2 + |r|^2) with all roundings; so far it may be beyond
        what the k-th distance allows.
        """
        near, square = self.centred(pos)
        if max(self.square.max(initial=0.0), square.max(initial=0.0)) > MOST / 16:  # products could leave single precision
            return super().hits(rows, pos)
        right = np.concatenate([near, (square * (1 - self.slack))[:, None].astype(np.float32)], axis=1)
        room = self.worst()[rows] - self.square[rows] * (1 - self.slack)
        with np.errstate(over="ignore"):
            room = np.nextafter(room.astype(np.float32), np.float32(np.inf))[:, None]
        close = np.flatnonzero(self.left[rows] @ right.T <= room)
        if len(close) > SPARSE * len(rows) * len(pos):
            return super().hits(rows, pos)
        i, j = np.divmod(close, len(pos))
        i = rows[i]
        d = np.zeros(len(i), np.float32)
        with np.errstate(over="ignore"):
            for x, y in zip(self.pos[i].T, pos[j].T, strict=True):  # in the order and precision of ``distances``
                step = y - x
                d += step * step
        fits = d <= self.d[i, -1]
        return i[fits], j[fits], d[fits]


def slack(width: int) -> float:
    """Above what a sum of so many squares in single precision is off by, relative."""
    return (width + 16) * 2.0**-22


def reachable(q: np.ndarray, r: np.ndarray, n: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, near, lead): the lead boxes hold k vectors within the bound from above, what is beyond it is left out."""
    near, far = _least(q, r), (q[:, None, 1] + r[None, :, 1]).min(axis=2)
    order = np.argsort(far, axis=1, kind="stable")
    count = np.cumsum(n[order], axis=1)
    kept, lead = np.ones(near.shape, bool), np.zeros(near.shape, bool)
    for i in range(len(q)):
        at = int(np.searchsorted(count[i], k)) + 1
        lead[i, order[i, :at]] = True
        if at <= len(r):
            kept[i] = near[i] <= far[i, order[i, at - 1]] ** 2 * (1 + slack(width)) + LEAST
    return kept | lead, near, lead


def block_size(count: int) -> int:
    """BLOCK until there are more blocks, half full at worst, than vectors in one, then more up to GROWTH times that."""
    return max(BLOCK, min(GROWTH * BLOCK, 1 << (2 * count // BLOCK).bit_length() >> 1))


def build(vectors: DataFrame, width: int, pivots: np.ndarray, front: int, block: int | None = None) -> Pyramid:
    """Pyramid over the pivot distances of (batch, idx, rank, pos), in the order of the nearest pivot and the distance to it."""
    kind = vectors.schema["batch"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("pos").flatten().to_numpy().reshape(b.num_rows, width)
            at = to_pivots(x, pivots)
            z = at.argmin(axis=1)
            columns = [*(b.column(c) for c in ("batch", "idx", "rank", "pos")), pa.array(z), pa.array(at.min(axis=1)), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), at.shape[1]).cast(pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["batch", "idx", "rank", "pos", "z", "away", "at"])

    rows = vectors.select("batch", F.col("idx").cast("long").alias("idx"), F.col("rank").cast("long").alias("rank"), F.slice("pos", 1, width).alias("pos"))
    rows = rows.mapInArrow(placed, f"batch {kind}, idx long, rank long, pos array<float>, z long, away double, at array<double>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["batch", "z", "away", "rank"]  # vectors at one place have equal distances
    return Pyramid.of_ordered(rows.repartitionByRange(parts, *order).sortWithinPartitions("batch", "z", "away", "pos", "rank"), len(pivots), front, None, block or BLOCK)


def nearest(query: DataFrame, ref: DataFrame, k: int, width: int, count: bool = False) -> DataFrame:
    """(batch, q, ref, d): the k smallest (squared distance, index) of each finite vector among finite ones; see ``searched`` for ``count``."""
    m.check_count(k)
    r = finite_points(ref, width)
    sample = r.orderBy(F.xxhash64("batch", "idx"), "idx").limit(SAMPLE).select(F.slice("pos", 1, width)).collect()
    pivots = choose(np.array([x[0] for x in sample], np.float64).reshape(len(sample), width))
    if not len(pivots):
        pivots = np.zeros((1, width))
    block = block_size(r.count())
    refs = build(r, width, pivots, k, block)
    asked = refs if query is ref else build(finite_points(query, width), width, pivots, k, block)
    tile = max(0, min(TILE, (asked.blocks.count() // (2 * query.sparkSession.sparkContext.defaultParallelism)).bit_length() - 1))
    make = lambda ids, pos: PivotNearest(ids, pos, k, pivots)
    pairs = descend(asked, refs, True, lambda a, b, n: reachable(a, b, n, k, width))
    return searched(asked, refs, needed_pairs(asked, refs, pairs, make), make, count, tile)
