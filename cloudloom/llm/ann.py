"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into balanced parts with few cut edges, and a softmax classifier learns
which part a vector's neighbours are in. Every row is indexed under its most probable part, and a query is routed to the
several most probable ones, where it is compared exactly. The number of parts grows with the rows; how many of them a
query is routed to follows from the sample, where the share of true neighbours that each number would find is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

PARTS, MOST_PARTS = 16, 256  # parts of a small table and of any
PART_ROOT = 14  # about the square root of the rows by this, as a power of two
TARGET = 0.96  # share of the sample's neighbours that the routed parts must hold
SAMPLE_ROWS = 8_000  # vectors that fit the index: the distinct ones with the smallest digests
NEIGHBOURS = 10
CELL_ROWS = 4_000  # rows or queries that a task compares at once


def valid(col: str) -> str:
    """SQL of vectors that take part: not null, no null, NaN or infinite component, not zero."""
    bad = f"exists({col}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return f"{col} is not null and size({col}) > 0 and not {bad} and exists({col}, x -> x <> 0)"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the inner-product form, for candidates only; final ones are summed term by term."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for lo in range(0, len(x), 1000):
        d = squared(x[lo : lo + 1000], x)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        if k > 0:
            out[lo : lo + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 0, slack: float = 1.05) -> np.ndarray:
    """Parts of at most ``slack`` times the mean size that keep neighbours together.

    Starts from recursive halving along principal directions and then moves rows to the part most of their neighbours (both
    ways) are in while that part has room, best gains first.
    """
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo <= 1 or len(rows) == 0:
            label[rows] = lo
            return
        mid = (lo + hi) // 2
        c = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(c.T @ c)[1][:, -1]
        order = rows[np.argsort(c @ direction, kind="stable")]
        at = len(rows) * (mid - lo) // (hi - lo)
        halve(order[:at], lo, mid)
        halve(order[at:], mid, hi)

    halve(np.arange(len(x)), 0, parts)
    limit = int(np.ceil(slack * len(x) / parts))
    rng = np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(30):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (src, label[dst]), 1)
        np.add.at(votes, (dst, label[src]), 1)
        gain = votes - votes[np.arange(len(x)), label][:, None]
        size, moved = np.bincount(label, minlength=parts), 0
        order = np.argsort(-gain.max(1) + 0.01 * rng.random(len(x)), kind="stable")
        for i in order[rng.random(len(x)) < 0.7]:
            if gain[i].max() <= 0:
                continue
            for p in np.argsort(-gain[i], kind="stable")[:3]:
                if gain[i, p] > 0 and size[p] < limit:
                    size[label[i]] -= 1
                    size[p] += 1
                    label[i], moved = p, moved + 1
                    break
        if not moved:
            break
    return label


@dataclass
class Router:
    """Softmax classifier of parts over a vector and a fixed set of random ReLU features."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, seed: int = 0, steps: int = 300) -> Router:
        """target: for each row the share of its neighbours (and itself) in each part."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0) + 1e-9
        hidden = rng.normal(size=(x.shape[1], 128)) / np.sqrt(x.shape[1])
        r = cls(mean, scale, hidden, np.zeros((x.shape[1] + 129, target.shape[1])))
        a = r._inputs(x)
        m, v = np.zeros_like(r.weight), np.zeros_like(r.weight)
        for t in range(1, steps + 1):
            g = a.T @ (r._softmax(a @ r.weight) - target) / len(x) + 1e-4 * r.weight
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            r.weight -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return r

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.concatenate([z, np.maximum(z @ self.hidden, 0), np.ones((len(x), 1))], axis=1)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-(self._inputs(x) @ self.weight), axis=1, kind="stable")


def fit_router(sample: np.ndarray, parts: int = PARTS) -> Router:
    graph = neighbour_graph(sample, NEIGHBOURS)
    label = balanced_parts(sample, graph, parts)
    target = np.zeros((len(sample), parts))
    target[np.arange(len(sample)), label] = 1
    if graph.shape[1]:
        np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph.ravel()]), 1)
    return Router.fit(sample, target / target.sum(1, keepdims=True))


def probes_needed(router: Router, sample: np.ndarray, target: float = TARGET) -> int:
    """Parts to look into so that ``target`` of the sample's neighbours are there; their own part is the one they are indexed under.

    Neighbours in a sample are farther apart than in the whole table, so this asks for more rather than fewer.
    """
    ranked = router.ranked(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 1000))
    graph = neighbour_graph(sample, NEIGHBOURS)[asked]
    if not graph.size:
        return ranked.shape[1]
    place = np.argsort(ranked[asked], axis=1)  # of each part in a query's ranking
    at = np.take_along_axis(place, ranked[graph.ravel(), 0].reshape(graph.shape), axis=1)
    found = np.cumsum(np.bincount(at.ravel(), minlength=ranked.shape[1])) / at.size
    return int(np.searchsorted(found, target)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, every: int = 100, k: int = 10, parts: int | None = None, probes: int | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every`` its k nearest other rows found: query_id, rank, vec_id, score.

    The score is the Euclidean distance in double precision of the original vectors; ties go to the smaller id. Vectors that are null,
    zero, or hold null or non-finite components, rows with a null id, and vectors of another length than most of the
    sample, take no part. Of a vector that many rows repeat, each cell keeps the k+1 smallest ids, which is all that
    can be among the k nearest. Repeated ids are rows of their own, but a query does not find its own id. ``parts`` is by
    default a power of two that grows with the square root of the rows, ``probes`` what the sample shows to be needed; with
    ``probes`` equal to ``parts`` the search is exact. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, vec_id {vectors.schema[id_col].dataType.simpleString()}, score double"
    rows = vectors.where(F.col(id_col).isNotNull()).where(valid(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    picked = rows.select("v").distinct().withColumn("h", F.xxhash64("v")).orderBy("h", "v").limit(sample_rows).select("v").toArrow().column("v").to_pylist()
    if not picked:
        return spark.createDataFrame([], schema)
    width = int(np.bincount([len(v) for v in picked]).argmax())
    sample = np.array([v for v in picked if len(v) == width])
    if parts is None:
        parts = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(rows.count()) / PART_ROOT))), PARTS, MOST_PARTS))
    parts = min(parts, len(sample))
    router = fit_router(sample, parts)
    probes = min(probes_needed(router, sample) if probes is None else probes, parts)
    sent = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ranked = sent.value.ranked(_matrix(b.column(1)))[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, ranked.size + 1, probes, dtype=np.int32), ranked.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "v", "parts"])

    routed = cut(rows.where(F.size("v") == width).mapInArrow(route, "id long, v array<double>, parts array<int>"))
    # of equal vectors only the smallest ids can be found
    few = routed.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1)
    base = few.select("id", "v", F.col("parts")[0].alias("part"))
    asked = routed.where(F.col("id") % every == 0).select("id", "v", F.explode("parts").alias("part"))
    most = lambda df: max([r[0] for r in df.groupBy("part").count().select("count").collect()], default=0)  # noqa: E731  one count a part
    data_cells, query_cells = (max(1, -(-most(df) // CELL_ROWS)) for df in (base, asked))
    cell = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every_cell = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = base.withColumn("d", cell(data_cells)).withColumn("q", every_cell(query_cells))
    queries = asked.withColumn("q", cell(query_cells)).withColumn("d", every_cell(data_cells))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = right["id"].to_numpy(), np.array(right["v"].tolist())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for lo in range(0, len(left), 256):
                part = left.iloc[lo : lo + 256]
                own, y = part["id"].to_numpy(), np.array(part["v"].tolist())
                d = squared(y, x)
                d[own[:, None] == ids[None, :]] = np.inf
                near = min(len(ids), k)
                limit = np.partition(d, near - 1, axis=1)[:, near - 1]
                q, c = np.nonzero((d <= (limit + 1e-9 * (1 + np.abs(limit)))[:, None]) & np.isfinite(d))  # with room for rounding
                score = np.sqrt(((y[q] - x[c]) ** 2).sum(1))
                best = np.lexsort((ids[c], score, q))
                q, c, score = q[best], c[best], score[best]
                first = np.searchsorted(q, np.arange(len(part)))
                keep = np.arange(len(q)) - first[q] < k
                out.append(pd.DataFrame({"query_id": own[q[keep]], "vec_id": ids[c[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["part", "d", "q"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    distinct = found.distinct() if probes > 1 else found
    return distinct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
