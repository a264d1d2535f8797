"""Toxicity by class-conditional Kneser-Ney bigram models with shared backoff counts.

Each class y (toxic, ordinary) has

    P_y(v | u) = max(c_y(u, v) - B_y, 0) / c_y(u) + rest_y(u) * P_y(v)
    P_y(v)     = max(n_y(v) - D_y, 0) / n_y + rest_y * P(v)

with c_y the texts of the class with the pair u v, n_y(v) the different words before v in texts of the class, and P(v) the
same continuation count over the texts of both classes, discounted and shared out to unseen words. The rests make sums of one. Each
discount is Kneser-Ney's own, n1 / (n1 + 2 n2) of the counts it is taken from. A pair of a single text is left to backoff, as with
the usual count cutoff.

A log ratio log P_toxic - log P_ordinary is of the same size for one chance count as for a hundred, so it enters by its
expectation: w = 1 / (1 + (1 - q) / q * e^-L) is the probability that the word takes sides, with L the log-likelihood that its texts
f_toxic, f_ordinary gain by a share of their own over that of the classes, and q the prior for it. The ratio of a word counts w times; what a pair
adds to its word counts by the same rule, with the word's expected share in place of the classes'. Both priors are the ones that serve best on
labelled texts that were not counted. A text is measured by the mean over its words, and that times the root of its length; a logistic
curve makes it a score. Terms within TOLERANCE of their default are not stored and stand at it, when the priors are chosen too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import cut, discard, release

WORD_PRIORS = (1e-1, 1e-2, 1e-3, 1e-4)
PAIR_PRIORS = (1e-2, 1e-3, 1e-4)
TOLERANCE = 0.05  # of a term of the mean
ONCE = np.uint64(1)  # stands before a word in the count of its texts
CALIBRATION_ROWS = 4_000  # bound expected size of the labelled sample, not counted, that chooses priors and fits the curve: ids whose digest falls in that share
CALIBRATION_SHARE = 0.2  # of the labelled rows, where that is less
BROADCAST_ROWS = 4_000_000  # of the model, 16 bytes each; a larger one is joined
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.7
ROUNDS = 2  # in which pairs are counted, by their digest: what one has shuffled is gone before the next
MERGE = 1_500_000  # pairs that a task gathers before it merges equal ones
MERGE_SUMS = 100_000  # sums of texts, 13 doubles each, that it gathers


def remainder(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def _marked(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, text number); the word before a text's first one is 0."""
    before = np.zeros(len(words.hash), np.uint64)
    before[1:] = words.hash[:-1]
    heads = words.first[:-1][np.diff(words.first) > 0]
    before[heads] = 0
    return before, words.hash, words.doc


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix(u * np.uint64(0xD6E8FEB86659FD93) + v)


@tk.trimmed
def _counts(batches: Iterator[pa.RecordBatch], part: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """(u, v, toxic, ordinary) sums of the pairs of each task's texts (toxic, text), and of its words with ONCE for u; those whose digest falls in this one of the rounds."""
    held: list[np.ndarray] = []

    def merged() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        at = np.flatnonzero(new)
        toxic, all_ = np.add.reduceat(rows[:, 2], at).view(np.int64), np.diff(np.append(at, len(rows)))
        return pa.record_batch([pa.array(tk.signed(rows[at, 0].copy())), pa.array(tk.signed(rows[at, 1].copy())), pa.array(toxic), pa.array(all_ - toxic)], names=["u", "v", "toxic", "ordinary"])

    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        for lo, hi, data, off in tk.slices(batch.column(1)):
            u, v, d = _marked(tk.words(data, off, loose=True))
            for before in (u, np.full(len(v), ONCE)):
                mine = np.flatnonzero(_pair(before, v) % np.uint64(rounds) == part)
                rows = mine[_distinct(d[mine], before[mine], v[mine])]
                held.append(np.stack([before[rows], v[rows], label[lo:hi][d[rows]]], axis=1))
            if sum(map(len, held)) >= MERGE:
                yield merged()
                held = []
    if sum(map(len, held)):
        yield merged()


def _distinct(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A row of each different (text, u, v)."""
    with np.errstate(over="ignore"):
        return np.unique(tk.mix(_pair(u, v) + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]


Arrays = dict[str, np.ndarray]


@dataclass
class Rates:
    """Totals and discounts of the counts, each class with its own of words and pairs, and the terms of rows of counts."""

    totals: dict[str, float]  # of n_t and n_o
    word_d: dict[str, float]
    pair_d: dict[str, float]
    rest: dict[str, float]  # of words
    unseen: float
    side: float  # share of texts with a word that are toxic, over all words

    def p_word(self, y: str, x: Arrays) -> np.ndarray:
        """P_y(v) from n_y and shared."""
        return np.maximum(x[f"n_{y}"] - self.word_d[y], 0) / self.totals[y] + self.rest[y] * x["shared"]

    def p_pair(self, y: str, x: Arrays) -> np.ndarray:
        """P_y(v | u), from the columns of u and of the pair too."""
        total, single = x[f"t_{y}"], self.p_word(y, x)
        own, some = np.maximum(x[f"c_{y}"] - self.pair_d[y], 0), np.maximum(total, 1)
        return np.where(total > 0, own / some + x[f"l_{y}"] / some * single, single)

    def common(self, q: float) -> float:
        """The term of a word that was not seen."""
        return q * float(np.log(self.rest["t"]) - np.log(self.rest["o"]))

    def word(self, q: float, x: Arrays) -> np.ndarray:
        return _stored(self._sides(q, x) * _ratio(self.p_word, x), self.common(q))

    def context(self, r: float, x: Arrays) -> np.ndarray:
        """The term that u adds before a word with which it makes no counted pair."""
        rest = lambda y, x: np.where(x[f"t_{y}"] > 0, x[f"l_{y}"] / np.maximum(x[f"t_{y}"], 1), 1.0)
        return _stored(r * _ratio(rest, x), 0.0)

    def pair(self, q: float, r: float, x: Arrays) -> np.ndarray:
        """The term that a counted pair adds to its word."""
        w = self._sides(q, x)
        share = np.clip(w * x["f_t"] / (x["f_t"] + x["f_o"]) + (1 - w) * self.side, 1e-6, 1 - 1e-6)
        return _stored(_weight(r, x["c_t"], x["c_o"], share) * (_ratio(self.p_pair, x) - _ratio(self.p_word, x)), self.context(r, x))

    def _sides(self, q: float, x: Arrays) -> np.ndarray:
        return _weight(q, x["f_t"], x["f_o"], self.side)


@dataclass
class Counts:
    """Tables of counts and their rates."""

    words: DataFrame  # v, n_t, n_o (words before it), f_t, f_o (texts), shared: P(v)
    pairs: DataFrame  # u, v, c_t, c_o of pairs in two texts or more
    contexts: DataFrame  # u, t_t, t_o (texts), l_t, l_o (what is left of them to backoff); those of such pairs
    rates: Rates

    @property
    def word_d(self) -> dict[str, float]:
        return self.rates.word_d

    @property
    def pair_d(self) -> dict[str, float]:
        return self.rates.pair_d


def _ratio(p: Callable, x: Arrays) -> np.ndarray:
    return np.log(p("t", x)) - np.log(p("o", x))


def _stored(x: np.ndarray, default: np.ndarray | float) -> np.ndarray:
    return np.where(np.abs(x - default) > TOLERANCE, x, default)


def _weight(prior: float, t: np.ndarray, o: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Probability that t and o have a share of their own, given the prior for it and the share they have otherwise."""
    part = lambda k, s: k * np.log(np.where(k > 0, k / (np.maximum(t + o, 1) * s), 1.0))
    gain = part(t, share) + part(o, 1 - share)
    return 1 / (1 + (1 - prior) / prior * np.exp(-np.minimum(gain, 500.0)))


def _arrays(batch: pa.RecordBatch) -> Arrays:
    """Columns without nulls; counts as doubles."""
    return {n: c.to_numpy(zero_copy_only=False) if n in ("__k", "u", "v") else c.to_numpy(zero_copy_only=False).astype(float) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def count(train: DataFrame, text_col: str) -> Counts | None:
    """Counts of the texts (__toxic, text); None if a class has none."""
    spark, n, tables = train.sparkSession, ROUNDS, []
    for part in range(n):
        pieces = train.select("__toxic", text_col).mapInArrow(lambda b, p=part: _counts(b, p, n), "u long, v long, toxic long, ordinary long")
        tables.append(cut(pieces.groupBy("u", "v").agg(F.sum("toxic").alias("c_t"), F.sum("ordinary").alias("c_o"))))
        release(spark)
    counted = reduce(DataFrame.union, tables)
    word, pair = F.col("u") == int(ONCE), F.col("u") != int(ONCE)
    many = lambda c: F.sum(c.cast("int"))
    texts = lambda c: F.coalesce(F.max(F.when(word, F.col(c))), F.lit(0))
    words = counted.groupBy("v").agg(many(pair & (F.col("c_t") > 0)).alias("n_t"), many(pair & (F.col("c_o") > 0)).alias("n_o"), many(pair).alias("n"), texts("c_t").alias("f_t"), texts("c_o").alias("f_o"))
    words = cut(words)
    release(spark)
    is_ = lambda c, k: F.sum((F.col(c) == k).cast("double"))
    some = lambda c: F.sum((F.col(c) > 0).cast("double"))
    w = words.agg(F.sum("n_t").alias("t"), F.sum("n_o").alias("o"), F.sum("n").alias("n"), F.count("*").alias("v"), is_("n", 1).alias("s1"), is_("n", 2).alias("s2"), F.sum("f_t").alias("ft"), F.sum("f_o").alias("fo"),
        *[is_(f"n_{y}", k).alias(f"{y}{k}") for y in "to" for k in (1, 2)], *[some(f"n_{y}").alias(f"v{y}") for y in "to"]).first()
    if not w["t"] or not w["o"]:
        return None
    pairs = counted.where(pair)
    p = pairs.agg(*[is_(f"c_{y}", k).alias(f"{y}{k}") for y in "to" for k in (1, 2)]).first()
    word_d, pair_d = ({y: _discount(x[f"{y}1"], x[f"{y}2"]) for y in "to"} for x in (w, p))
    shared_d = _discount(w["s1"], w["s2"])
    unseen = shared_d * w["v"] / (w["v"] + 1) / w["n"]
    words = words.withColumn("shared", F.greatest(F.col("n") - shared_d, F.lit(0.0)) / w["n"] + unseen).drop("n")
    kept = F.col("c_t") + F.col("c_o") > 1
    left = [F.sum(F.when(kept, F.least(F.col(f"c_{y}"), F.lit(pair_d[y]))).otherwise(F.col(f"c_{y}"))).alias(f"l_{y}") for y in "to"]
    contexts = cut(pairs.groupBy("u").agg(F.sum("c_t").alias("t_t"), F.sum("c_o").alias("t_o"), *left, F.max(kept).alias("some")).where("some").drop("some"))
    pairs = cut(pairs.where(kept))
    discard(*tables)
    release(spark)
    rates = Rates({y: float(w[y]) for y in "to"}, word_d, pair_d, {y: word_d[y] * w[f"v{y}"] / w[y] for y in "to"}, unseen, w["ft"] / (w["ft"] + w["fo"]))
    return Counts(words, pairs, contexts, rates)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of all parts, and their sums of each row of values."""
    k, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return k, np.stack([np.bincount(at, x, minlength=len(k)) for x in np.concatenate([x for _, x in parts], axis=1)])


def choose(counts: Counts, sample: DataFrame, text_col: str) -> tuple[float, float, tuple[float, float, float]]:
    """The priors of words and of pairs with the least logistic loss on labelled texts (__toxic, text), and their curve.

    The sample has a bounded number of texts; one row for each of them comes to the driver.
    """
    used, keyed = _tokens(sample.select("__toxic", text_col))
    used = used.join(counts.words, "v", "left").join(counts.contexts, "u", "left").join(counts.pairs, ["u", "v"], "left")
    tried = [(q, r) for q in WORD_PRIORS for r in PAIR_PRIORS]
    names = ["n", *[f"x{i}" for i in range(len(tried))]]
    rates = counts.rates

    @tk.trimmed
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and, for each choice of priors, terms of each text, summed as far as a task gathers them. As expressions of
        Spark the terms of all choices would make a plan of a MB, which the driver writes out at each step."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            k, x = _merged(held)
            return pa.RecordBatch.from_arrays([pa.array(k), *map(pa.array, x)], names=["__k", *names])

        for b in batches:
            if not b.num_rows:
                continue
            x = _arrays(b)
            paired = np.flatnonzero(x["c_t"] + x["c_o"])
            own = {n: c[paired] for n, c in x.items()}
            word, context = {q: rates.word(q, x) for q in WORD_PRIORS}, {r: rates.context(r, x) for r in PAIR_PRIORS}
            sums = [x["count"]]
            for q, r in tried:
                added = context[r].copy()
                added[paired] = rates.pair(q, r, own)
                sums.append(x["count"] * (word[q] + added))
            held.append(_merged([(x["__k"], np.stack(sums))]))
            if sum(len(k) for k, _ in held) >= MERGE_SUMS:
                yield sent()
                held = []
        if held:
            yield sent()

    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_t", "n_o", "f_t", "f_o", "t_t", "t_o", "l_t", "l_o", "c_t", "c_o")]
    parts = used.select("__k", "count", *known, F.coalesce("shared", F.lit(rates.unseen)).alias("shared")).mapInArrow(summed, ", ".join(["__k long", *[f"{n} double" for n in names]]))
    sums = parts.groupBy("__k").agg(*[F.sum(n).alias(n) for n in names])
    fit = keyed.select("__k", "__toxic").join(sums, "__k", "left").na.fill(0).drop("__k").toPandas()
    release(sample.sparkSession)
    y, n = fit["__toxic"].to_numpy(float), fit["n"].to_numpy(float)
    best = None
    for i, (q, r) in enumerate(tried):
        x = fit[f"x{i}"].to_numpy(float) / np.maximum(n, 1)
        curve = _curve(x, n, y)
        z = np.clip(curve[0] + curve[1] * x + curve[2] * x * np.sqrt(n), -30, 30)
        loss = float(np.log1p(np.exp(np.where(y > 0, -z, z))).mean()) if len(y) else 0.0
        if best is None or loss < best[0]:
            best = (loss, q, r, curve)
    return best[1:]


def learn(counts: Counts, q: float, r: float) -> tuple[DataFrame, float]:
    """Terms (kind, key, ratio) under the chosen priors, and that of all words without one.

    Kind 0: of a word; 1: what a word before adds; 2: what it adds as a counted pair, in place of kind 1.
    """
    rates = counts.rates
    common = rates.common(q)
    single = _terms(counts.words, 0, lambda x: (x["v"], rates.word(q, x), common))
    context = _terms(counts.contexts, 1, lambda x: (x["u"], rates.context(r, x), 0.0))
    paired = counts.pairs.join(counts.contexts, "u").join(counts.words, "v")
    pair = _terms(paired, 2, lambda x: (tk.signed(_pair(x["u"].view(np.uint64), x["v"].view(np.uint64))), rates.pair(q, r, x), rates.context(r, x)))
    terms = cut(single.union(context).union(pair))
    release(terms.sparkSession)
    return terms, common


def _terms(table: DataFrame, kind: int, term: Callable) -> DataFrame:
    """(kind, key, ratio) of the rows whose (key, ratio, default) by ``term`` has a ratio of its own."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ratio, default = term(_arrays(b))
            at = np.flatnonzero(ratio != default)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(key[at]), pa.array(ratio[at])], names=["kind", "key", "ratio"])

    return table.mapInArrow(own, "kind int, key long, ratio double")


@dataclass
class Model:
    """The terms as sorted arrays, for a broadcast of bounded size."""

    tables: list[tuple[np.ndarray, np.ndarray]]
    common: float

    @classmethod
    def collect(cls, ratios: DataFrame, common: float) -> Model:
        t = ratios.toArrow()
        kind, key, ratio = t.column("kind").to_numpy(), t.column("key").to_numpy().view(np.uint64), t.column("ratio").to_numpy()
        tables = []
        for k in range(3):
            order = np.argsort(key[kind == k])
            tables.append((key[kind == k][order], ratio[kind == k][order]))
        return cls(tables, common)

    def _find(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in wanted, their ratios) of the keys that have one."""
        keys, ratios = self.tables[kind]
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        ok = np.flatnonzero(keys[at] == wanted)
        return ok, ratios[at[ok]]

    def sums(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Sum of terms and number of words of each text."""
        u, v, doc = _marked(w)
        x = np.full(len(v), self.common)
        at, r = self._find(0, v)
        x[at] = r
        added = np.zeros(len(v))
        at, r = self._find(1, u)
        added[at] = r
        at, r = self._find(2, _pair(u, v))
        added[at] = r
        x += added
        n = np.diff(w.first)
        return np.bincount(doc, x, minlength=len(n)), n


def _features_broadcast(rows: DataFrame, model: Model, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` of rows with the mean ratio x and the number of words n of the text; the text goes to tasks once, kept or not."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    asked = columns if text_col in columns else [*columns, text_col]
    at = asked.index(text_col)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", __x double, __n long"

    @tk.trimmed
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, off in tk.slices(batch.column(at)):
                s, k = sent.value.sums(tk.words(data, off, loose=True))
                x.append(s / np.maximum(k, 1))
                n.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(np.concatenate(x)), pa.array(np.concatenate(n))], names=[*columns, "__x", "__n"])

    return rows.select(*asked).mapInArrow(measure, schema)


def _tokens(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(__k, u, v, uv, count) of the words of rows, whose last column is the text, and the rows with their key __k."""
    keyed = cut(rows.withColumn("__k", F.monotonically_increasing_id()))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, off in tk.slices(batch.column(1)):
                u, v, d = _marked(tk.words(data, off, loose=True))
                yield pa.record_batch([pa.array(keys[lo + d]), pa.array(tk.signed(u)), pa.array(tk.signed(v)), pa.array(tk.signed(_pair(u, v)))], names=["__k", "u", "v", "uv"])

    return keyed.select("__k", rows.columns[-1]).mapInArrow(tokens, "__k long, u long, v long, uv long").groupBy("__k", "u", "v", "uv").count(), keyed


def _features_joined(rows: DataFrame, ratios: DataFrame, common: float, columns: list[str], text_col: str) -> DataFrame:
    """The same by joins, for models too large to broadcast."""
    used, keyed = _tokens(rows.select(*[c for c in columns if c != text_col], text_col))
    for k, name in enumerate(("v", "u", "uv")):
        used = used.join(ratios.where(F.col("kind") == k).select(F.col("key").alias(name), F.col("ratio").alias(f"r{k}")), name, "left")
    x = F.coalesce("r0", F.lit(common)) + F.coalesce("r2", "r1", F.lit(0.0))
    sums = used.groupBy("__k").agg((F.sum(F.col("count") * x) / F.sum("count")).alias("__x"), F.sum("count").alias("__n"))
    return keyed.join(sums, "__k", "left").select(*columns, F.coalesce("__x", F.lit(0.0)).alias("__x"), F.coalesce("__n", F.lit(0)).alias("__n"))


def _curve(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slopes (not negative) of a logistic curve in x and x * sqrt(n), by Newton steps with a small ridge.

    Without rows of both kinds the curve is flat, on the side of the kind there is (ordinary if none).
    """
    if len(x) == 0 or y.min() == y.max():
        return (-3.0 if len(x) == 0 or y.max() == 0 else 3.0), 0.0, 0.0
    a = np.stack([np.ones_like(x), x, x * np.sqrt(n)], axis=1)
    scale = np.maximum(np.abs(a).mean(axis=0), 1e-9)
    a /= scale
    use = [0, 1, 2]
    while True:
        m, b = a[:, use], np.zeros(len(use))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
            g = m.T @ (y - p) - 1e-2 * b
            step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(len(use)), g)
            b += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        low = [k for k, c in zip(use, b, strict=True) if k and c < 0]
        if not low:
            break
        use = [k for k in use if k not in low]
    out = np.zeros(3)
    out[use] = b / scale[use]
    return float(out[0]), float(out[1]), float(out[2])


def _measured(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str, text_col: str, broadcast_rows: int) -> tuple[DataFrame, Column]:
    """``columns`` with __x and __n of all rows, and the score in these."""
    learnt = labels.where(f"`{id_col}` is not null and toxic is not null").where(remainder(id_col) != 1).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    known = learnt.count()
    marked = F.broadcast(learnt) if known <= BROADCAST_LABELS else learnt
    labelled = docs.select(F.col(id_col), F.col(text_col)).join(marked, docs[id_col] == marked["__id"]).select(id_col, text_col, "__toxic")
    share = int((1 << 20) * min(CALIBRATION_SHARE, CALIBRATION_ROWS / max(known, 1)))
    sampled = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share
    counts = count(labelled.where(~sampled), text_col)
    if counts is None:  # texts of one class at most: all score alike
        spark = docs.sparkSession
        ratios, common = spark.createDataFrame([], "kind int, key long, ratio double"), 0.0
        rate = labelled.agg(F.avg("__toxic")).first()[0]
        a, b, c = _curve(np.zeros(0), np.zeros(0), np.zeros(0)) if not rate else _curve(np.zeros(1), np.zeros(1), np.ones(1))
    else:
        q, r, (a, b, c) = choose(counts, labelled.where(sampled), text_col)
        ratios, common = learn(counts, q, r)
    model = Model.collect(ratios, common) if ratios.count() <= broadcast_rows else None

    logit = F.lit(a) + F.lit(b) * F.col("__x") + F.lit(c) * F.col("__x") * F.sqrt(F.col("__n"))
    measured = _features_broadcast(docs, model, columns, text_col) if model else _features_joined(docs, ratios, common, columns, text_col)
    return measured, 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Of the labelled rows those with crc32(id as text) mod 3 of 1 are held out; of all others about CALIBRATION_ROWS, or
    CALIBRATION_SHARE if less, choose priors and fit the curve, and the rest give counts. Scores use the text alone. A null or empty text scores as the curve at 0. A null id is not
    held out and never labelled. Several labels of an id: the largest holds. Repeated rows get a row each. Without
    labels all texts score alike, below the threshold. An empty table gives no rows. Other columns are ignored.
    """
    out, score = _measured(docs, labels, [id_col], id_col, text_col, broadcast_rows)
    scored = out.select(id_col, (remainder(id_col) == 1).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_toxicity`` doesn't predict toxic; texts are not shuffled."""
    out, score = _measured(docs, labels, docs.columns, id_col, text_col, broadcast_rows)
    return out.where(score < THRESHOLD).select(*docs.columns)
