"""Occupancy pyramid over points in up to three dimensions, and the exact nearest-neighbour search that descends it.

Points are put in z-order and cut into blocks with tight boxes and counts; runs of FAN nodes form a node of the level above. A search
descends the pyramids of queries and references together, a join on parents for each level. A node of references is left out once other
nodes, which hold enough points, are closer to every place of the node of queries: then none of its points can be among the nearest.
What remains at the lowest level are pairs of blocks, which tasks compare nearest first. So a search looks at occupied
space alone, wherever its queries are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import metric as m
from ..functions import morton
from ..plans.order import cut

BLOCK = 64  # points in a block, at most
FAN = 4  # bits: 16 nodes in a node of the level above
TOP = 256  # nodes of the highest level, at most, if there is one batch
SLACK = 2e-6  # relative, above what single-precision distances are off by
LEAST = 1e-37  # absolute, for distances that single precision holds inexactly
MOST = 3e38  # distances beyond are infinite in single precision
ROWS = 16_384
APART = 4  # tasks a tile of queries
GROUP = 1 << 20  # bytes of a row group of a lasting table: small, so that local searches skip most
SPANS = 4_096


def _z_order(points: DataFrame, dim: int) -> DataFrame:
    """Points with a z-order key over their extent, sorted by batch, key, place and rank over range partitions."""
    edge = points.agg(*[f(F.col("pos")[i].cast("double")) for f in (F.min, F.max) for i in range(dim)]).first()
    low = [edge[i] or 0.0 for i in range(dim)]
    extent = max([(edge[i + dim] or 0.0) - low[i] for i in range(dim)] + [1e-30]) * (1 + SLACK)
    cell = [F.floor((F.col("pos")[i].cast("double") - low[i]) / (extent / (1 << 20))) for i in range(dim)] + [F.lit(0)] * (3 - dim)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("batch"), F.col("z"), *[F.col("pos")[i] for i in range(dim)], F.col("rank")]
    return points.withColumn("z", morton.encode(*cell)).repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _ends(z: np.ndarray, size: int) -> list[int]:
    """Ends of blocks of a run of keys: each from half of ``size`` to ``size`` long, where the key changes in its highest bit."""
    turn = np.concatenate([z[1:] ^ z[:-1], [0]])
    at, ends = 0, []
    while len(z) - at > size:
        at += size // 2 + int(np.argmax(turn[at + size // 2 - 1 : at + size]))
        ends.append(at)
    return [*ends, len(z)]


def _cut_blocks(batches: Iterator[pa.RecordBatch], dim: int, size: int, front: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one partition of ordered points (batch, idx, rank, pos, z), with boxes of the places pos, or of the column ``at`` where there is one.

    Of the points of one place, the ``front`` first are in front blocks and the rest in others: a search for so few never needs those.
    """
    pid, made = TaskContext.get().partitionId(), 0

    def blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal made
        t = t.combine_chunks()
        batch, z, idx, rank = (t.column(c).to_numpy() for c in ("batch", "z", "idx", "rank"))
        pos = t.column("pos").combine_chunks().flatten().to_numpy().reshape(len(z), -1)
        place, room = (t.column("at").combine_chunks().flatten().to_numpy().reshape(len(z), dim), np.inf) if "at" in t.column_names else (pos, 0)
        new = np.ones(len(z), bool)
        new[1:] = (batch[1:] != batch[:-1]) | (pos[1:] != pos[:-1]).any(axis=1)
        at = np.arange(len(z))
        ahead = at - np.maximum.accumulate(np.where(new, at, 0)) < front
        rows = []
        for lead in (True, False):
            own = np.flatnonzero(ahead == lead)
            if not len(own):
                continue
            edges = [0, *(np.flatnonzero(np.diff(batch[own])) + 1).tolist(), len(own)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                start = lo
                for end in _ends(z[own[lo:hi]], size):
                    rows.append((lead, own[start : lo + end]))
                    start = lo + end
        box = [(place[r].min(axis=0).astype(np.float32), place[r].max(axis=0).astype(np.float32)) for _, r in rows]
        box = [(np.nextafter(lo, -room, dtype=np.float32), np.nextafter(hi, room, dtype=np.float32)) if room else (lo, hi) for lo, hi in box]
        columns = {
            "pid": pa.array(np.full(len(rows), pid, np.int64)), "i": pa.array(made + np.arange(len(rows))), "batch": pa.array([batch[r[0]] for _, r in rows], t.schema.field("batch").type),
            "n": pa.array([len(r) for _, r in rows], pa.int64()), "front": pa.array([lead for lead, _ in rows]),
            "ids": pa.array([idx[r] for _, r in rows], pa.list_(pa.int64())), "ranks": pa.array([rank[r] for _, r in rows], pa.list_(pa.int64())),
            "xyz": pa.array([pos[r].ravel() for _, r in rows], pa.list_(pa.float32())),
        }
        columns |= {f"{name}{i}": pa.array([b[side][i] for b in box], pa.float32()) for side, name in enumerate(("lo", "hi")) for i in range(dim)}
        made += len(rows)
        yield pa.record_batch(list(columns.values()), names=list(columns))

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            yield from blocks(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from blocks(pa.Table.from_batches(held))


@dataclass
class Pyramid:
    """Blocks (id, batch, n, front, lo0.., hi0.., ids, ranks, xyz) of finite points; ``bits`` is what ids take, ``step`` those within a task."""

    blocks: DataFrame
    dim: int
    bits: int
    step: int
    size: int
    front: int
    upper: DataFrame | None = None  # (level, front, batch, id, n, lo0.., hi0..) of the levels above the blocks, where they are written

    @classmethod
    def build(cls, points: DataFrame, dim: int, front: int, path: str | None = None, block: int = BLOCK) -> Pyramid:
        """Of points (batch, idx, rank, pos), all finite, in z-order; written to ``path`` where one is given, else to the shared folder."""
        ordered = _z_order(points.select("batch", F.col("idx").cast("long").alias("idx"), F.col("rank").cast("long").alias("rank"), F.slice("pos", 1, dim).alias("pos")), dim)
        return cls.of_ordered(ordered.select("batch", "idx", "rank", "pos", "z"), dim, front, path, block)

    @classmethod
    def of_ordered(cls, ordered: DataFrame, dim: int, front: int, path: str | None = None, block: int = BLOCK) -> Pyramid:
        """Of range partitions sorted by (batch, z, pos, rank)."""
        size, boxes = max(block, front), ", ".join(f"{c}{i} float" for c in ("lo", "hi") for i in range(dim))
        schema = f"pid long, i long, batch {ordered.schema['batch'].dataType.simpleString()}, n long, front boolean, ids array<long>, ranks array<long>, xyz array<float>, {boxes}"
        made = ordered.mapInArrow(lambda it: _cut_blocks(it, dim, size, front), schema)
        if path is None:
            return cls.of(cut(made), dim, front)
        made.write.option("parquet.block.size", GROUP).parquet(path)
        return cls.of(ordered.sparkSession.read.schema(schema).parquet(path), dim, front)

    @classmethod
    def of(cls, written: DataFrame, dim: int, front: int, upper: DataFrame | None = None) -> Pyramid:
        last = written.agg(F.max("pid"), F.max("i"), F.sum("n")).first()
        step = int(last[1] or 0).bit_length()
        blocks = written.withColumn("id", F.shiftleft("pid", step).bitwiseOR(F.col("i")))
        return cls(blocks, dim, step + int(last[0] or 0).bit_length(), step, int(last[2] or 0), front, upper)

    def nodes(self, level: int, front: bool) -> DataFrame:
        """(batch, id, n, lo0.., hi0..) of a level; level 0 are the blocks."""
        box, base, b = [f"{c}{i}" for c in ("lo", "hi") for i in range(self.dim)], 0, self.blocks.where("front") if front else self.blocks
        if level and self.upper is not None and self.levels():
            base = min(level, self.levels())
            b = self.upper.where((F.col("level") == base) & (F.col("front") == front))
        b = b.select("batch", F.shiftright("id", FAN * (level - base)).alias("id"), "n", *box)
        return b.groupBy("batch", "id").agg(F.sum("n").alias("n"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in box]) if level > base else b

    def stored(self, path: str | None = None) -> Pyramid:
        """With all levels above the blocks written, to ``path`` or the shared folder, for many searches."""
        none = self.nodes(0, True).where("false").select(F.lit(0).alias("level"), F.lit(True).alias("front"), "*")
        rows = none
        for level in range(1, self.levels() + 1):
            for front in (True, False):
                rows = rows.unionByName(self.nodes(level, front).select(F.lit(level).alias("level"), F.lit(front).alias("front"), "*"))
        if path is None:
            return replace(self, upper=cut(rows))
        rows.write.parquet(path)
        return replace(self, upper=self.blocks.sparkSession.read.schema(none.schema).parquet(path))

    def read(self, pairs: DataFrame, ranges: int) -> DataFrame:
        """The blocks within up to ``ranges`` spans of the numbers r of ``pairs``: what lies between them is not read from the table.

        All numbers are cut in about SPANS equal spans. Those in use are joined but at their widest gaps, and stated over columns that row
        groups have statistics of.
        """
        width = max(1, (1 << self.bits) // SPANS)
        used = sorted(r[0] for r in pairs.select(F.expr(f"r div {width}")).distinct().collect())  # 2 * SPANS at most
        spans: list[list[int]] = []
        for x in used:
            if spans and x == spans[-1][1]:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        if not spans:
            return self.blocks.where("false")
        widest = sorted(range(1, len(spans)), key=lambda j: spans[j - 1][1] - spans[j][0])[: max(ranges - 1, 0)]
        edges = [0, *sorted(widest), len(spans)]
        spans = [[spans[a][0], spans[b - 1][1]] for a, b in zip(edges, edges[1:], strict=False)]
        inside = F.lit(False)
        for lo, hi in spans:
            first, last = lo * width, hi * width - 1
            (p, i), (pp, ii) = divmod(first, 1 << self.step), divmod(last, 1 << self.step)
            pid, at_i = F.col("pid"), F.col("i")
            one = (pid == p) & at_i.between(i, ii) if p == pp else ((pid == p) & (at_i >= i)) | pid.between(p + 1, pp - 1) | ((pid == pp) & (at_i <= ii))
            inside = inside | one
        return self.blocks.where(inside)

    def levels(self) -> int:
        """Levels above the blocks up to that with TOP nodes at most; one root for each batch is above them all."""
        return max(0, -(-(self.bits - TOP.bit_length() + 1) // FAN))

    def kids(self, level: int, front: bool, root: bool) -> DataFrame:
        """(batch, id, ids, ns, box) of the nodes of a level with their up to 2^FAN children, or TOP under a root."""
        low = self.nodes(level - 1, front)
        box = F.array(*[f"{c}{i}" for c in ("lo", "hi") for i in range(self.dim)])
        up = F.lit(0).cast("long") if root else F.shiftright("id", FAN)
        return low.groupBy("batch", up.alias("up")).agg(F.collect_list("id").alias("ids"), F.collect_list("n").alias("ns"), F.flatten(F.collect_list(box)).alias("box")).withColumnRenamed("up", "id")


def _near(q: np.ndarray, r: np.ndarray, norm: int) -> np.ndarray:
    """Least distances (squared for norm 2) of the places of boxes q and r, given as (row, end, axis)."""
    gap = np.maximum(np.maximum(r[None, :, 0] - q[:, None, 1], q[:, None, 0] - r[None, :, 1]), 0)
    return (gap * gap).sum(axis=2) if norm == 2 else gap.sum(axis=2)


def _far(q: np.ndarray, r: np.ndarray, norm: int) -> np.ndarray:
    span = np.maximum(r[None, :, 1] - q[:, None, 0], q[:, None, 1] - r[None, :, 0])
    return (span * span).sum(axis=2) if norm == 2 else span.sum(axis=2)


def margin(q: np.ndarray, b: np.ndarray, r: np.ndarray, norm: int) -> np.ndarray:
    """For boxes (axis-wise ends) q and b of a row and boxes r: how much farther, at most over the places of q, all of b is than the nearest of r.

    Axes are apart. On each the difference is convex or linear between the ends of q, the middle of b and the ends of r, so its
    greatest value is at one of these. Below zero, every place of b is closer than r, wherever in q one stands.
    """
    total = np.full(r.shape[:1], LEAST)
    power = (lambda x: x * x) if norm == 2 else (lambda x: x)
    for i in range(q.shape[1]):
        (lo, hi), (b0, b1), (r0, r1) = q[:, i], b[:, i], (r[:, 0, i], r[:, 1, i])
        best = np.full(len(total), -np.inf)
        for t in (lo, hi, min(max((b0 + b1) / 2, lo), hi), np.clip(r0, lo, hi), np.clip(r1, lo, hi)):
            best = np.maximum(best, power(np.maximum(t - b0, b1 - t)) * (1 + SLACK) - power(np.maximum(np.maximum(r0 - t, t - r1), 0)))
        total += best
    return total


def reachable(q: np.ndarray, r: np.ndarray, n: np.ndarray, k: int, norm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, near, lead) of boxes q and boxes r of n points each: whether r can hold one of the k nearest of a place of q.

    The lead boxes are the first by greatest distance that hold k points; what all of them are closer than is left out.
    """
    near, far = _near(q, r, norm), _far(q, r, norm)
    order = np.argsort(far, axis=1, kind="stable")
    count = np.cumsum(n[order], axis=1)
    kept, lead = np.ones(near.shape, bool), np.zeros(near.shape, bool)
    for i in range(len(q)):
        m = int(np.searchsorted(count[i], k)) + 1
        first = order[i, :m]
        lead[i, first] = True
        if m <= len(r) and far[i, first].max() < MOST:
            b = np.stack([r[first, 0].min(axis=0), r[first, 1].max(axis=0)])
            close = np.flatnonzero(near[i] <= _far(q[i : i + 1], b[None], norm)[0, 0] * (1 + SLACK) + LEAST)
            kept[i] = False
            kept[i, close[margin(q[i], b, r[close], norm) >= 0]] = True
            kept[i, first] = True
    return kept, near, lead


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal (batch, q) of a sorted stream, many at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        first = np.flatnonzero(b.column("first").to_numpy(zero_copy_only=False))
        if held and len(first) and sum(x.num_rows for x in held) + first[-1] >= 256:
            cut_at = int(first[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut_at)]).combine_chunks()
            held = [b.slice(cut_at)]
        elif b.num_rows:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _expand(batches: Iterator[pa.RecordBatch], keep, dim: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of children from rows (batch, q, first, ids, ns, box): a node of queries, then the nodes of references it meets."""
    for t in _groups(batches):
        b = t.to_batches()[0]
        first = np.flatnonzero(b.column("first").to_numpy(zero_copy_only=False))
        (ids, at), (ns, _), (box, bat) = _column(b, "ids"), _column(b, "ns"), _column(b, "box")
        names, out = b.column("batch"), []
        for lo, hi in zip(first, [*first[1:], b.num_rows], strict=True):
            if hi - lo < 2:
                continue
            q, r = (box[bat[x] : bat[y]].reshape(-1, 2, dim).astype(np.float64) for x, y in ((lo, lo + 1), (lo + 1, hi)))
            kept, near, lead = keep(q, r, ns[at[lo + 1] : at[hi]])
            i, j = np.nonzero(kept)
            rid = ids[at[lo + 1] : at[hi]][j]
            flat = box[bat[lo + 1] : bat[hi]].reshape(-1, 2 * dim)[j]
            columns = [pa.array([names[int(lo)].as_py()] * len(i), schema.field("batch").type), pa.array(ids[at[lo] : at[lo + 1]][i]), pa.array(rid), pa.array(near[i, j]), pa.array(lead[i, j])]
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * 2 * dim), pa.array(flat.ravel())))
            out.append(pa.record_batch(columns, schema=schema))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def descend(query: Pyramid, ref: Pyramid, front: bool, keep) -> DataFrame:
    """(batch, q, r, near, lead, box): the pairs of blocks left by a descent that keeps what ``keep`` says of the boxes of children."""
    kind, dim, top = query.blocks.schema["batch"].dataType, ref.dim, max(query.levels(), ref.levels()) + 1
    parts = int(query.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"batch {kind.simpleString()}, q long, r long, near double, lead boolean, box array<float>"
    arrow = pa.schema([("batch", to_arrow_type(kind)), ("q", pa.int64()), ("r", pa.int64()), ("near", pa.float64()), ("lead", pa.bool_()), ("box", pa.list_(pa.field("item", pa.float32())))])
    pairs = None
    for level in range(top, 0, -1):
        own = query.kids(level, False, level == top).withColumnRenamed("id", "q")
        kids = ref.kids(level, front, level == top).withColumnRenamed("id", "r")
        met = own.select("batch", "q").withColumn("r", F.lit(0).cast("long")) if pairs is None else pairs.select("batch", "q", "r")
        rows = own.withColumn("first", F.lit(True)).unionByName(met.join(kids, ["batch", "r"]).drop("r").withColumn("first", F.lit(False)))
        rows = rows.repartition(parts, "batch", "q").sortWithinPartitions("batch", "q", F.desc("first")).select("batch", "first", "ids", "ns", "box")
        pairs = rows.mapInArrow(lambda it: _expand(it, keep, dim, arrow), schema)
    return pairs


def block_pairs(query: Pyramid, ref: Pyramid, k: int, norm: int = 2) -> DataFrame:
    """Blocks of references that can hold one of the k nearest of a place in the box of a block of queries."""
    return descend(query, ref, k <= ref.front, lambda q, r, n: reachable(q, r, n, k, norm))


def within_pairs(query: Pyramid, ref: Pyramid, limit: float) -> DataFrame:
    """Blocks whose boxes have places within the squared distance ``limit`` of each other."""

    def keep(q: np.ndarray, r: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = _near(q, r, 2)
        return near <= limit * (1 + SLACK) + LEAST, near, np.zeros(near.shape, bool)

    return descend(query, ref, False, keep)


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = batch.column(name)
    offsets = c.offsets.to_numpy()
    return c.values.to_numpy(zero_copy_only=False), offsets


def distances(query: np.ndarray, ref: np.ndarray, norm: int) -> np.ndarray:
    """All distances in single precision, an axis at a time as generated code sums them."""
    total = None
    with np.errstate(over="ignore"):
        for i in range(query.shape[1]):
            step = ref[None, :, i] - query[:, i, None]
            term = step * step if norm == 2 else np.abs(step)
            total = term if total is None else total + term
    return total


class Nearest:
    """The k smallest (distance, rank) of each query of a block, over blocks of references as they come."""

    slack = SLACK

    def __init__(self, ids: np.ndarray, pos: np.ndarray, k: int, norm: int):
        self.ids, self.pos, self.norm, self.k = ids, pos, norm, k
        self.d = np.full((len(ids), k), np.inf, np.float32)
        self.rank = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.ref = np.full((len(ids), k), -1)
        self.compared = 0

    def worst(self) -> np.ndarray:
        """What the k-th distances found can be beyond rounding."""
        return self.d[:, -1].astype(np.float64) * (1 + self.slack) + LEAST

    def least(self, box: np.ndarray) -> np.ndarray:
        """(query, box): a distance that no place of the box is below."""
        own = self.pos.astype(np.float64)
        return _near(np.stack([own, own], axis=1), box, self.norm)

    def offer(self, ids: np.ndarray, ranks: np.ndarray, pos: np.ndarray, near: float, box: np.ndarray) -> None:
        worst = self.worst()
        if near > worst.max(initial=-1.0):
            return
        rows = np.flatnonzero(self.least(box[None])[:, 0] <= worst)
        if not len(rows):
            return
        self.compared += len(rows) * len(ids)
        i, j, found = self.hits(rows, pos)
        if not len(i):
            return
        first = np.flatnonzero(np.diff(i, prepend=-1))
        rows, each = i[first], np.diff(first, append=len(i))
        at = (np.repeat(np.arange(len(first)), each), np.arange(len(i)) - np.repeat(first, each))
        d, rank, ref = (np.full((len(rows), each.max()), none, x.dtype) for none, x in ((np.inf, self.d), (np.iinfo(np.int64).max, self.rank), (-1, self.ref)))
        d[at], rank[at], ref[at] = found, ranks[j], ids[j]
        d, rank, ref = (np.concatenate([x[rows], y], axis=1) for x, y in ((self.d, d), (self.rank, rank), (self.ref, ref)))
        order = np.lexsort((rank, d), axis=1)[:, : self.k]
        self.d[rows], self.rank[rows], self.ref[rows] = (np.take_along_axis(x, order, axis=1) for x in (d, rank, ref))

    def hits(self, rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance), by query: pairs within the k-th distance found, and within the k-th of these places."""
        d = distances(self.pos[rows], pos, self.norm)
        hit = d <= self.d[rows, -1:]
        if hit.all() and len(pos) > 4 * self.k:
            hit &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        i, j = np.nonzero(hit)
        return rows[i], j, d[i, j]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all found: number of the query in its block, reference, distance."""
        q, at = np.nonzero(self.rank < np.iinfo(np.int64).max)
        return q, self.ref[q, at], self.d[q, at]


class Within:
    """The k least references of each query of a block whose squared distance is below the limit."""

    def __init__(self, ids: np.ndarray, pos: np.ndarray, k: int, limit: float):
        self.ids, self.pos, self.k, self.limit = ids, pos, k, np.float32(limit)
        self.ref = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.d = np.zeros((len(ids), k), np.float32)

    def offer(self, ids: np.ndarray, ranks: np.ndarray, pos: np.ndarray, near: float, box: np.ndarray) -> None:
        if ids.min() >= self.ref[:, -1].max(initial=0):
            return
        d = distances(self.pos, pos, 2)
        hit = (d < self.limit) & (ids[None] < self.ref[:, -1:])
        rows, use = np.flatnonzero(hit.any(axis=1)), hit.any(axis=0)
        if not len(rows):
            return
        some = np.ix_(rows, np.flatnonzero(use))
        ref = np.concatenate([self.ref[rows], np.where(hit[some], ids[use][None], np.iinfo(np.int64).max)], axis=1)
        order = np.argsort(ref, axis=1, kind="stable")[:, : self.k]
        self.ref[rows], self.d[rows] = (np.take_along_axis(x, order, axis=1) for x in (ref, np.concatenate([self.d[rows], d[some]], axis=1)))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, at = np.nonzero(self.ref < np.iinfo(np.int64).max)
        return q, at, self.ref[q, at], self.d[q, at]


def _blocks_met(batches: Iterator[pa.RecordBatch], make, dim: int) -> Iterator[tuple]:
    """Each block of queries of a sorted stream after its blocks of references were offered, nearest first; and the boxes that came without points.

    Rows are (batch, q, r, first, near, box, ids, ranks, xyz): the block of queries, of which ``make`` gives what collects, then the others.
    """
    block, own, left = None, None, []
    for b in batches:
        first, near, key, r = b.column("first").to_numpy(zero_copy_only=False), b.column("near").to_numpy(), b.column("q").to_numpy(), b.column("r").to_numpy(zero_copy_only=False)
        (ids, at), (ranks, _), (xyz, xat), (box, bat) = (_column(b, c) for c in ("ids", "ranks", "xyz", "box"))
        for i in range(b.num_rows):
            n = int(at[i + 1] - at[i])
            pos = xyz[xat[i] : xat[i + 1]].reshape(n, -1) if n else None
            if first[i]:
                if block is not None:
                    yield block, own, left
                block, own, left = make(ids[at[i] : at[i + 1]].copy(), pos.copy()), (b.column("batch")[i], int(key[i])), []
                continue
            room = box[bat[i] : bat[i + 1]].reshape(2, dim).astype(np.float64)
            if n:
                block.offer(ids[at[i] : at[i + 1]], ranks[at[i] : at[i + 1]], pos, float(near[i]), room)
            else:
                left.append((int(r[i]), float(near[i]), room))
    if block is not None:
        yield block, own, left


def _batched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in rows:
        held.append(b)
        size += b.num_rows
        if size >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _needed(batches: Iterator[pa.RecordBatch], make, dim: int) -> Iterator[pa.RecordBatch]:
    """(batch, q, r, near) of the boxes that a query of the block can need, given its distances to the lead blocks."""

    def rows() -> Iterator[pa.RecordBatch]:
        for block, (batch, q), left in _blocks_met(batches, make, dim):
            if left:
                near = block.least(np.stack([x for _, _, x in left]))
                use = np.flatnonzero((near <= block.worst()[:, None]).any(axis=0))
                yield pa.record_batch([pa.array([batch.as_py()] * len(use), batch.type), pa.array(np.full(len(use), q)), pa.array(np.array([left[u][0] for u in use], np.int64)), pa.array(near[:, use].min(axis=0, initial=np.inf))], names=["batch", "q", "r", "near"])

    yield from _batched(rows())


def _tiles_met(batches: Iterator[pa.RecordBatch], make, dim: int) -> Iterator[tuple]:
    """Each block of queries after the blocks of references it is paired with were offered; rows (batch, tile, q, first, qs, nears, ids, ranks, xyz, box)."""
    tile, held = None, {}
    for b in batches:
        first, tiles, key = b.column("first").to_numpy(zero_copy_only=False), b.column("tile").to_numpy(), b.column("q").to_numpy()
        (ids, at), (ranks, _), (xyz, xat), (box, bat), (qs, qat), (nears, _) = (_column(b, c) for c in ("ids", "ranks", "xyz", "box", "qs", "nears"))
        for i in range(b.num_rows):
            own = (b.column("batch")[i], int(tiles[i]))
            if own != tile:
                yield from ((block, (tile[0], q), []) for q, block in held.items())
                tile, held = own, {}
            pos = xyz[xat[i] : xat[i + 1]].reshape(int(at[i + 1] - at[i]), -1)
            if first[i]:
                held[int(key[i])] = make(ids[at[i] : at[i + 1]].copy(), pos.copy())
                continue
            room = box[bat[i] : bat[i + 1]].reshape(2, dim).astype(np.float64)
            for q, near in zip(qs[qat[i] : qat[i + 1]].tolist(), nears[qat[i] : qat[i + 1]].tolist(), strict=True):
                held[q].offer(ids[at[i] : at[i + 1]], ranks[at[i] : at[i + 1]], pos, near, room)
    yield from ((block, (tile[0], q), []) for q, block in held.items())


def _search(batches: Iterator[pa.RecordBatch], make, dim: int, count: bool, meet=_blocks_met) -> Iterator[pa.RecordBatch]:
    """(batch, q, ref, d) of the nearest found; with ``count`` the numbers of queries and of comparisons as q and ref."""

    def rows() -> Iterator[pa.RecordBatch]:
        for block, (batch, _), _ in meet(batches, make, dim):
            q, ref, d = block.rows()
            ids = block.ids[q]
            if count:
                ids, ref, d = np.array([len(block.ids)]), np.array([block.compared]), np.zeros(1, np.float32)
            yield pa.record_batch([pa.array([batch.as_py()] * len(ids), batch.type), pa.array(ids), pa.array(ref), pa.array(d)], names=["batch", "q", "ref", "d"])

    yield from _batched(rows())


def _streams(pairs: DataFrame, query: Pyramid, ref: Pyramid, boxes: DataFrame | None = None) -> DataFrame:
    """Blocks of queries, each before the blocks of references it is paired with, and these before boxes alone."""
    parts = int(query.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none, points = F.array().cast("array<float>"), ["ids", "ranks", "xyz"]
    own = query.blocks.select("batch", F.col("id").alias("q"), F.lit(-1).cast("long").alias("r"), F.lit(0).alias("turn"), F.lit(-1.0).alias("near"), none.alias("box"), *points)
    room = F.array(*[f"{c}{i}" for c in ("lo", "hi") for i in range(ref.dim)]).alias("box")
    met = pairs.select("batch", "q", "r", "near").join(ref.blocks.select("batch", F.col("id").alias("r"), room, *points), ["batch", "r"])
    rows = own.unionByName(met.select("batch", "q", "r", F.lit(1).alias("turn"), "near", "box", *points))
    if boxes is not None:
        empty = F.array().cast("array<long>")
        rows = rows.unionByName(boxes.select("batch", "q", "r", F.lit(2).alias("turn"), "near", "box", empty.alias("ids"), empty.alias("ranks"), none.alias("xyz")))
    sorted_ = rows.repartition(parts, "batch", "q").sortWithinPartitions("batch", "q", "turn", "near")
    return sorted_.select("batch", "q", "r", (F.col("turn") == 0).alias("first"), "near", "box", *points)


def _tiles(pairs: DataFrame, query: Pyramid, ref: Pyramid, tile: int) -> DataFrame:
    """``_streams`` for 2^tile blocks of queries at a time: a block of references is sent once to all of them that it is paired with."""
    points, of = ["ids", "ranks", "xyz"], F.shiftright("q", tile).alias("tile")
    # a tile is long work, so tiles should seldom share a task
    parts = max(int(query.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), APART * query.blocks.select("batch", F.shiftright("id", tile)).distinct().count())
    own = query.blocks.withColumn("q", F.col("id")).select("batch", of, "q", F.lit(0).alias("turn"), F.lit(-1.0).alias("near"), F.array().cast("array<long>").alias("qs"), F.array().cast("array<double>").alias("nears"), F.array().cast("array<float>").alias("box"), *points)
    met = pairs.groupBy("batch", of, "r").agg(F.collect_list(F.struct("q", "near")).alias("all"), F.min("near").alias("near"))
    room = F.array(*[f"{c}{i}" for c in ("lo", "hi") for i in range(ref.dim)]).alias("box")
    met = met.join(ref.blocks.select("batch", F.col("id").alias("r"), room, *points), ["batch", "r"])
    met = met.select("batch", "tile", F.lit(-1).cast("long").alias("q"), F.lit(1).alias("turn"), "near", F.col("all.q").alias("qs"), F.col("all.near").alias("nears"), "box", *points)
    sorted_ = own.unionByName(met).repartition(parts, "batch", "tile").sortWithinPartitions("batch", "tile", "turn", "near")
    return sorted_.select("batch", "tile", "q", (F.col("turn") == 0).alias("first"), "qs", "nears", "box", *points)


def needed_pairs(query: Pyramid, ref: Pyramid, pairs: DataFrame, make) -> DataFrame:
    """Of ``pairs`` of blocks (batch, q, r, near, lead, box) those left once every query knows its k-th distance among the points of the lead blocks."""
    kind, dim, pairs = query.blocks.schema["batch"].dataType.simpleString(), ref.dim, cut(pairs)
    lead = pairs.where("lead").select("batch", "q", "r", "near")
    rest = _streams(lead, query, ref, pairs.where("not lead")).mapInArrow(lambda it: _needed(it, make, dim), f"batch {kind}, q long, r long, near double")
    return cut(lead.union(rest))


def searched(query: Pyramid, ref: Pyramid, pairs: DataFrame, make, count: bool = False, tile: int = 0) -> DataFrame:
    """(batch, q, ref, d) of what ``make`` collects of each block of queries over its ``pairs`` (batch, q, r, near); 2^tile blocks of queries are met at once."""
    kind, dim = query.blocks.schema["batch"].dataType.simpleString(), ref.dim
    rows, meet = (_tiles(pairs, query, ref, tile), _tiles_met) if tile else (_streams(pairs, query, ref), _blocks_met)
    return rows.mapInArrow(lambda it: _search(it, make, dim, count, meet), f"batch {kind}, q long, ref long, d float")


def nearest(query: Pyramid, ref: Pyramid, k: int, norm: int = 2, ranges: int = 0) -> DataFrame:
    """(batch, q, ref, d): the k smallest (distance, rank) of each query; fewer where its batch has fewer references.

    With ``ranges`` the blocks of references are read in so many spans at most, as far as they are needed.
    """
    make = lambda ids, pos: Nearest(ids, pos, k, norm)
    pairs = needed_pairs(query, ref, block_pairs(query, ref, k, norm), make)
    return searched(query, replace(ref, blocks=ref.read(pairs, ranges)) if ranges else ref, pairs, make)


def compared(query: Pyramid, ref: Pyramid, k: int, norm: int = 2) -> float:
    """Points that a query is compared with in the last step of ``nearest``, on average."""
    make = lambda ids, pos: Nearest(ids, pos, k, norm)
    return mean_compared(searched(query, ref, needed_pairs(query, ref, block_pairs(query, ref, k, norm), make), make, True))


def mean_compared(counted: DataFrame) -> float:
    found = counted.agg(F.sum("ref"), F.sum("q")).first()
    return (found[0] or 0) / max(found[1] or 0, 1)


def _first_within(batches: Iterator[pa.RecordBatch], k: int, dim: int, limit: float) -> Iterator[pa.RecordBatch]:
    """(batch, q, slot, ref, d): of each query the k first references by index with a squared distance below ``limit``."""

    def rows() -> Iterator[pa.RecordBatch]:
        for block, (batch, _), _ in _blocks_met(batches, lambda ids, pos: Within(ids, pos, k, limit), dim):
            q, slot, ref, d = block.rows()
            yield pa.record_batch([pa.array([batch.as_py()] * len(q), batch.type), pa.array(block.ids[q]), pa.array(slot.astype(np.int32)), pa.array(ref), pa.array(d)], names=["batch", "q", "slot", "ref", "d"])

    yield from _batched(rows())


def within(query: Pyramid, ref: Pyramid, limit: float, k: int, ranges: int = 0) -> DataFrame:
    """(batch, q, slot, ref, d): of each query the k first references by index with a squared distance below ``limit``."""
    kind, dim = query.blocks.schema["batch"].dataType.simpleString(), ref.dim
    pairs = cut(within_pairs(query, ref, limit))
    if ranges:
        ref = replace(ref, blocks=ref.read(pairs, ranges))
    return _streams(pairs, query, ref).mapInArrow(lambda it: _first_within(it, k, dim, limit), f"batch {kind}, q long, slot int, ref long, d float")


def finite_points(points: DataFrame, dim: int, rank: Column | None = None) -> DataFrame:
    """(batch, idx, rank, pos) of the points whose ``dim`` first coordinates are finite; ties go to the smaller rank, by default the index."""
    return points.where(F.col("batch").isNotNull() & m.all_finite(F.slice("pos", 1, dim))).select("batch", "idx", (F.col("idx") if rank is None else rank).alias("rank"), "pos")
