"""Benchmark decontamination: all n-grams of the test items are seeds that join texts to them, Smith-Waterman scores them.

Items of up to BROADCAST_BYTES go to all tasks, where texts look their n-grams up and are aligned without a shuffle. More items are
joined with the texts' n-grams by shuffle, and only the stretches of texts and items that share seeds meet again to be aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textkit as tk
from .align import MATCH, smith_waterman
from .common import cut

N = 4
MIN_SCORE = 0.5
BROADCAST_BYTES = 16 << 20
ASKED = 256  # alignments for which a text is sent once
_FILTER_BITS = 20


@dataclass
class Items:
    """A block of test items: ids, word hashes, and the occurrences of their n-grams sorted by hash."""

    ids: list
    words: list[np.ndarray]
    size: np.ndarray  # n-gram length used for each item
    gram: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # occurrences of gram g are first[g]:first[g+1]
    item: np.ndarray
    at: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list, n: int) -> Items:
        data, off = tk.text_buffer(pa.array(texts, pa.string()))
        w = tk.words(data, off, loose=True)
        seqs = [w.hash[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]
        kept = [i for i, s in enumerate(seqs) if len(s)]
        ids, seqs = [ids[i] for i in kept], [seqs[i] for i in kept]
        size = np.array([min(n, len(s)) for s in seqs], np.int64)
        parts = [(tk.gram_hash(s, int(k)), np.full(len(s) - k + 1, i), np.arange(len(s) - k + 1)) for i, (s, k) in enumerate(zip(seqs, size, strict=True))]
        h, item, at = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(3))
        order = np.lexsort((at, item, h))
        return cls._index(ids, seqs, size, h[order], item[order], at[order])

    @classmethod
    def _index(cls, ids, seqs, size, h, item, at) -> Items:
        gram, first = np.unique(h, return_index=True)
        marks = np.zeros(1 << _FILTER_BITS, bool)
        marks[(gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(ids, seqs, size, gram, np.append(first, len(h)), item, at, marks)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, gram numbers) of the hashes that are grams of an item."""
        may = np.flatnonzero(self.marks[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(may) or not len(self.gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = np.minimum(np.searchsorted(self.gram, h[may]), len(self.gram) - 1)
        ok = self.gram[g] == h[may]
        return may[ok], g[ok]


def _hits(items: Items, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, gram number) of all item grams in a slice of texts."""
    out = []
    for n in np.unique(items.size).tolist():
        h, d, p = tk.grams(w, int(n))
        at, g = items.lookup(h)
        out.append((d[at], p[at], g))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _score(item: np.ndarray, text: np.ndarray, low: int, high: int, min_score: float) -> tuple[float, int, int] | None:
    """(minus the score, first word, end word) of an item's best alignment around the diagonals low to high, if it reaches ``min_score``."""
    slack = int(2 * len(item) * (1 - min_score)) + 1  # an alignment of that score has no more gaps
    lo, hi = max(0, low - slack), min(len(text), high + len(item) + slack)
    if np.isin(item, text[lo:hi]).sum() < min_score * len(item):  # bounds the score from above
        return None
    score, _, _, first, end = smith_waterman(item, text[lo:hi])
    share = score / (MATCH * len(item))
    return (-share, lo + first, lo + end) if share >= min_score else None


def _leaks(items: Items, w: tk.Words, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(text number, item number, score, first word, end word): the best alignment of each text and item."""
    doc, pos, g = _hits(items, w)
    times = items.first[g + 1] - items.first[g]
    place = np.repeat(items.first[g] - np.cumsum(times) + times, times) + np.arange(times.sum())
    doc, pos, item = np.repeat(doc, times), np.repeat(pos, times), items.item[place]
    diagonal = pos - items.at[place]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    length = np.array([len(s) for s in items.words], np.int64)
    if not len(doc):
        return []
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > length[item[1:]] // 2 + 1)
    starts = np.flatnonzero(new)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(starts, np.append(starts[1:], len(doc)), strict=True):
        d, i = int(doc[a]), int(item[a])
        found = _score(items.words[i], w.hash[w.first[d] : w.first[d + 1]], int(diagonal[a]), int(diagonal[b - 1]), min_score)
        if found and found < best.get((d, i), (0.0, 0, 0)):
            best[d, i] = found
    return [(d, i, -s, f, e) for (d, i), (s, f, e) in sorted(best.items())]


def _sent(docs: DataFrame, items: DataFrame, n: int, item_id: str, item_text: str):
    """A broadcast of the items, or None if they have more than BROADCAST_BYTES."""
    rows = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return None
    part = rows.orderBy("i", "t").collect()  # of checked size
    return docs.sparkSession.sparkContext.broadcast(Items.of([r[0] for r in part], [r[1] for r in part], n))


def _item_seeds(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(gram, size, i, at, length) of the n-grams of items (i, text); items of fewer words are one gram."""
    for b in batches:
        for lo, _, data, off in tk.slices(b.column(1)):
            w = tk.words(data, off, loose=True)
            count = np.diff(w.first)
            for size in range(1, n + 1):
                h, d, p = tk.grams(w, size)
                own = np.minimum(count[d], n) == size
                h, d, p = h[own], d[own], p[own]
                yield pa.record_batch([pa.array(tk.signed(h)), pa.array(np.full(len(h), size, np.int32)), b.column(0).take(pa.array(lo + d)), pa.array(p.astype(np.int64)), pa.array(count[d].astype(np.int64))], names=["gram", "size", "i", "at", "length"])


def _text_grams(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, _, data, off in tk.slices(b.column(1)):
            w = tk.words(data, off, loose=True)
            for size in sizes:
                h, d, p = tk.grams(w, size)
                yield pa.record_batch([pa.array(tk.signed(h)), pa.array(np.full(len(h), size, np.int32)), b.column(0).take(pa.array(lo + d)), pa.array(p.astype(np.int64))], names=["gram", "size", "k", "pos"])


def _align_asked(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    """Scores of the stretches asked of a text: rows (k, text, asked)."""
    for b in batches:
        rows = []
        for lo, hi, data, off in tk.slices(b.column(1)):
            w = tk.words(data, off, loose=True)
            for x in range(hi - lo):
                text = w.hash[w.first[x] : w.first[x + 1]]
                for r in b.column(2)[lo + x].as_py():
                    own, ends = tk.text_buffer(pa.array([r["t"]]))
                    found = _score(tk.words(own, ends, loose=True).hash, text, r["low"], r["high"], min_score)
                    if found:
                        rows.append((b.column(0)[lo + x].as_py(), r["i"], *found))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()])], names=["k", "i", "minus", "first", "end"])


def _joined_leaks(texts: DataFrame, items: DataFrame, n: int, min_score: float) -> DataFrame:
    """(k, i, minus, first, end): the best alignment of each text (k, text) and item (i, t) by a join of their seeds."""
    seeds = cut(items.select("i", "t").mapInArrow(lambda b: _item_seeds(b, n), "gram long, size int, i long, at long, length long"))
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most n
    grams = texts.select("k", "text").mapInArrow(lambda b: _text_grams(b, sizes), "gram long, size int, k long, pos long")
    hits = grams.join(seeds, ["gram", "size"]).select("k", "i", "length", (F.col("pos") - F.col("at")).alias("diagonal"))
    order = Window.partitionBy("k", "i").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.expr("length div 2") + 1, F.lit(True))
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(runs.groupBy("k", "i", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high")))
    share = runs.groupBy("k").count().select("k", F.ceil(F.col("count") / ASKED).alias("of"))
    asked = runs.join(items.select("i", "t"), "i").join(share, "k").groupBy("k", F.pmod(F.xxhash64("i", "run"), F.col("of")).alias("part")).agg(F.collect_list(F.struct("i", "t", "low", "high")).alias("asked"))
    scored = texts.join(asked, "k").select("k", "text", "asked").mapInArrow(lambda b: _align_asked(b, min_score), "k long, i long, minus double, first long, end long")
    return scored.groupBy("k", "i").agg(F.min(F.struct("minus", "first", "end")).alias("b")).select("k", "i", "b.*")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def find_leaks(docs: DataFrame, items: DataFrame, n: int = N, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each input row and test item that it holds: id, item id, score, first_word, end_word.

    Words are lower-cased and parted by space and ASCII punctuation. The score is that of the best local alignment over
    that of the whole item (match 2, mismatch -1, gap -1), at least ``min_score``. All n-grams of an item are seeds, however
    often they occur, so every such alignment with n equal words in a row is found. An item of fewer than n words is one seed. Null and empty texts and items match nothing. Repeated
    rows give their rows each; repeated items too. Empty tables give no rows. Other columns are ignored.
    """
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, `{item_id}` {item_type.simpleString()}, score double, first_word long, end_word long"
    sent = _sent(docs, items, n, item_id, item_text)
    if sent is None:
        texts = _numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "k")
        tests = _numbered(items.select(F.col(item_id).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t")), "i")
        found = _joined_leaks(texts, tests, n, min_score).join(texts.select("k", "id"), "k").join(tests.select("i", "item"), "i")
        return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), (-F.col("minus")).alias("score"), F.col("first").alias("first_word"), F.col("end").alias("end_word"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value
        ids = pa.array(part.ids)
        for batch in batches:
            for lo, hi, data, off in tk.slices(batch.column(1)):
                found = _leaks(part, tk.words(data, off, loose=True), min_score)
                if found:
                    d, i, s, f, e = (list(x) for x in zip(*found, strict=True))
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(d)), ids.take(pa.array(i)), pa.array(s, pa.float64()), pa.array(f, pa.int64()), pa.array(e, pa.int64())], names=[id_col, item_id, "score", "first_word", "end_word"])

    return docs.select(id_col, text_col).mapInArrow(align, schema)


def drop_leaks(docs: DataFrame, items: DataFrame, n: int = N, min_score: float = MIN_SCORE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item; see ``find_leaks``. Texts are shuffled only where items are too many to send."""
    at = docs.columns.index(text_col)
    sent = _sent(docs, items, n, item_id, item_text)
    if sent is None:
        keyed = _numbered(docs, "__k")
        texts = keyed.select(F.col("__k").alias("k"), F.col(text_col).alias("text"))
        tests = _numbered(items.select(F.coalesce(F.col(item_text), F.lit("")).alias("t")), "i")
        gone = _joined_leaks(texts, tests, n, min_score).select(F.col("k").alias("__k")).distinct()
        return keyed.join(gone, "__k", "left_anti").select(*docs.columns)

    @tk.trimmed
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value
        for batch in batches:
            for lo, hi, data, off in tk.slices(batch.column(at)):
                keep = np.ones(hi - lo, bool)
                keep[[x[0] for x in _leaks(part, tk.words(data, off, loose=True), min_score)]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
