"""Vector code compression: part codebooks learned in integers, entries found by branch and bound in ball trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 2
LONG = 2**63 - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: 64-bit integers where all distances of such vectors fit, exact Python integers elsewhere."""
    most = SCALE * min(float(np.abs(x).max()), 2.0**40) + 2 if x.size else 0.0
    if 4 * most * most * x.shape[1] < 2.0**62:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in row] for row in x.tolist()], dtype=object)


def root(a: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    if a.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(a) if a.size else a
    r = np.sqrt(a.astype(np.float64)).astype(np.int64)
    r -= r * r > a
    return r + ((r + 1) * (r + 1) <= a)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    step = x - y
    return (step * step).sum(axis=1)


@dataclass
class Ball:
    """Entries within ``radius`` of ``center``; the radius is rounded up, so no entry lies beyond it."""

    center: np.ndarray
    radius: int
    members: list[int]
    halves: list[Ball] = field(default_factory=list)


def ball_tree(entries: np.ndarray, members: list[int] | None = None) -> Ball:
    """Halves by two far entries until LEAF are left, or all are equal."""
    members = list(range(len(entries))) if members is None else members
    own = entries[members]
    center = np.array([int(s) // len(own) for s in own.sum(axis=0)], dtype=entries.dtype)
    far = squared(own, center)
    ball = Ball(center, math.isqrt(int(far.max())) + 1, members)
    if len(members) > LEAF:
        a = own[int(np.argmax(far))]
        b = own[int(np.argmax(squared(own, a)))]
        left = squared(own, a) <= squared(own, b)
        if left.any() and not left.all():
            ball.halves = [ball_tree(entries, [m for m, x in zip(members, left, strict=True) if x == side]) for side in (True, False)]
    return ball


class Book:
    """The entries of one part position with their tree."""

    def __init__(self, entries: list[list[int]]):
        self.exact = np.array(entries, dtype=object).reshape(len(entries), -1)
        most = max((abs(v) for row in entries for v in row), default=0)
        self.small = self.exact.astype(np.int64) if 4 * (most + 2) ** 2 * self.exact.shape[1] < 2**62 else None
        self.trees: dict[bool, Ball] = {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, ties to the lower index; all in whole numbers.

        The nearer half is searched first. A ball is looked into unless even the distance to its center, rounded down, less its radius is
        beyond the best found: one that may only tie is looked into as well.
        """
        plain = self.small is not None and x.dtype != object
        entries = self.small if plain else self.exact
        x = x if plain else x.astype(object)
        if plain not in self.trees:
            self.trees[plain] = ball_tree(entries)
        best, index = squared(x, entries[0]), np.zeros(len(x), np.int64)

        def visit(ball: Ball, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if not ball.halves:
                for m in ball.members:
                    d = squared(x[rows], entries[m])
                    new = ((d < best[rows]) | ((d == best[rows]) & (m < index[rows]))).astype(bool)
                    best[rows[new]], index[rows[new]] = d[new], m
                return
            reach = [root(squared(x[rows], h.center)) for h in ball.halves]
            near = (reach[0] <= reach[1]).astype(bool)
            for first, second, pick in ((0, 1, near), (1, 0, ~near)):
                own = rows[pick]
                visit(ball.halves[first], own)
                gap = np.maximum(reach[second][pick] - ball.halves[second].radius, 0)
                visit(ball.halves[second], own[(gap * gap <= best[own]).astype(bool)])

        visit(self.trees[plain], np.arange(len(x)))
        return index, best


Books = dict[int, list[list[list[int]]]]  # of each width: part, entry, component


def _cut_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(row, part, position); widths that the parts do not divide are padded with zeros, which no distance feels."""
    short = -x.shape[1] % parts
    x = np.concatenate([x, np.zeros((len(x), short), x.dtype)], axis=1) if short else x
    return x.reshape(len(x), parts, -1)


def _by_width(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, integer parts) of a batch of vectors without nulls."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        flat = batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield int(width), rows, _cut_parts(integers(flat.reshape(len(rows), int(width))), parts)


def _sums(batches: Iterator[pa.RecordBatch], books: Books, parts: int) -> Iterator[pa.RecordBatch]:
    """Per width, part and entry the number and the sums of a task's parts, as decimal text: they have no bound."""
    trees = {w: [Book(b) for b in book] for w, book in books.items()}
    total: dict[tuple[int, int, int], list] = {}
    for batch in batches:
        for width, _, x in _by_width(batch, parts):
            for p, book in enumerate(trees[width]):
                index, _ = book.nearest(x[:, p])
                for e in np.unique(index):
                    own = x[index == e, p]
                    kept = total.setdefault((width, p, int(e)), [0, [0] * own.shape[1]])
                    kept[0] += len(own)
                    kept[1] = [a + int(b) for a, b in zip(kept[1], own.sum(axis=0), strict=True)]
    keys = list(total)
    columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
    yield pa.record_batch([*columns, pa.array([total[k][0] for k in keys], pa.int64()), pa.array([[str(v) for v in total[k][1]] for k in keys], pa.list_(pa.string()))], names=["width", "part", "entry", "n", "sums"])


def _means(rows: pd.DataFrame) -> pd.DataFrame:
    n = int(rows["n"].sum())
    sums = [sum(int(v) for v in column) for column in zip(*rows["sums"], strict=True)]
    return pd.DataFrame({"width": rows["width"].iloc[:1], "part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "mean": [[str(s // n) for s in sums]]})


def digest(book: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, width, v) of the vectors that are not null and hold finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.size(v).alias("width"), v.alias("v"))


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of each width of ``rows`` (id, width, v): they start as parts of the least ids, ties by the vector, null ids last.

    Each round assigns all parts and sends one row of sums per task and entry; per width ``entries`` rows come to the driver.
    """
    first = Window.partitionBy("width").orderBy(F.col("id").asc_nulls_last(), "v")
    start = rows.select("id", "width", "v", F.row_number().over(first).alias("rn")).where(F.col("rn") <= entries).orderBy("width", "rn").collect()
    books: Books = {}
    for r in start:
        x = _cut_parts(integers(np.array([r["v"]], np.float64).reshape(1, -1)), parts)[0]
        book = books.setdefault(r["width"], [[] for _ in range(parts)])
        for p in range(parts):
            book[p].append([int(v) for v in x[p]])
    for _ in range(rounds if books else 0):
        at = books
        found = rows.select("width", "v").mapInArrow(lambda it, at=at: _sums(it, at, parts), "width int, part int, entry int, n long, sums array<string>")
        new = found.groupBy("width", "part", "entry").applyInPandas(_means, "width int, part int, entry int, mean array<string>").collect()
        books = {w: [list(part) for part in book] for w, book in books.items()}
        for r in new:
            books[r["width"]][r["part"]][r["entry"]] = [int(v) for v in r["mean"]]
    return books


def encode(rows: DataFrame, books: Books, parts: int = PARTS) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of rows (id, label, width, v)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, names = {w: [Book(b) for b in book] for w, book in books.items()}, {w: digest(book) for w, book in books.items()}
        for batch in batches:
            for width, at, x in _by_width(batch, parts):
                codes, error = np.zeros((len(at), parts), np.uint8), np.zeros(len(at), object)
                for p, book in enumerate(trees[width]):
                    index, d = book.nearest(x[:, p])
                    codes[:, p], error = index, error + d.astype(object)
                text = codes.tobytes().hex()
                own = batch.take(pa.array(at))
                columns = [own.column("id"), own.column("label"), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())]
                yield pa.record_batch([*columns, pa.array([min(int(v), LONG) for v in error], pa.int64()), pa.array([names[width]] * len(at), pa.string())], names=["id", "label", "code", "error", "codebooks_sha256"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector that is kept: id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null, NaN or infinite components are left out; zero vectors and repeated rows take part. Each width has
    codebooks of its own. With fewer vectors than entries there are fewer entries. Distances are exact at any size of the
    components; an error or a sum of errors beyond a long is given as the greatest long. An empty table gives no rows; further
    columns are ignored. ``entries`` is 256 at most, two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = cut(clean(vectors, id_col, vector_col, label_col))
    coded = cut(encode(rows, learn(rows, parts, entries, rounds), parts))
    total = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    out = coded.join(total, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
