"""Exact repeated-substring removal with suffix arrays.

Each string of LENGTH bytes has an anchor, the least hash among its Q-byte windows, so equal strings have equal anchors. Texts
are cut into stretches of string starts with one anchor. Equal stretches are found by digest and cover each other; one of each
stands for all. Anchors with several different stretches go to a shard, which sorts its suffixes by Larsson-Sadakane refinement,
takes common prefixes with Kasai's recurrence, and marks starts whose neighbour shares LENGTH bytes. An anchor with too much text for
one shard is divided: its stretches are cut again where the least of further hash functions change, so that only
strings that agree in all of them still meet. What is too much even then is dealt to several shards, whose sorted
digests of distinct strings are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import cut, discard, keyed, release

LENGTH = 400
Q = 32
SHARD = 512 << 10  # bytes of text in a suffix array
STEP = 7  # symbols in the first key
PART = 4 << 20  # bytes of text in a batch of stretches
LEVELS = 3  # times that an anchor with too much text is divided
FURTHER = 4  # hash functions that each time adds


def stretches(data: np.ndarray, off: np.ndarray, length: int, q: int, functions: int = 1) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first start, end start, anchors merged) of the stretches of a slice of texts.

    Starts are relative to their text. Neighbouring anchors with equal hash, as in periodic text, are one stretch. With
    several hash functions the anchor is made of the least of each.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(np.uint64), none, none, none
    at = np.arange(n - q + 1)
    h = tk.span_hash(tk.prefix_hash(data), at, at + q)
    doc = np.searchsorted(off, np.arange(n - length + 1), side="right") - 1
    start = np.flatnonzero(np.arange(n - length + 1) + length <= off[doc + 1])
    if not len(start):
        return none, none.view(np.uint64), none, none, none
    doc = doc[start]
    value, moved = np.zeros(len(start), np.uint64), np.ones(len(start), bool)
    moved[1:] = False
    for k in range(functions):
        low = h if k == 0 else tk.mix(h ^ np.uint64(k * 0x2545F4914F6CDD1D % 2**64))
        low = (low >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        width, window = 1, length - q + 1
        while width < window:
            step = min(width, window - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[start]
        value = h[anchor] if functions == 1 else tk.mix(value ^ h[anchor]) + np.uint64(k)
        moved[1:] |= anchor[1:] != anchor[:-1]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    merged = np.add.reduceat((moved | new).astype(np.int64), first)
    last = np.append(first[1:], len(start)) - 1
    base = off[doc[first]]
    return doc[first], value[first], start[first] - base, start[last] - base + 1, merged


def suffix_array(text: np.ndarray, seg: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes of the segments in order, and for each depth h the ranks by the first h bytes.

    seg: segment of each byte; end: end of its segment. A suffix ends with its segment; suffixes that are equal up
    to there are ordered by segment. Only groups of still equal suffixes are sorted again, by the rank h bytes on.
    """
    n = len(text)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(STEP):
        symbol = np.zeros(n, np.uint64)
        m = max(0, n - k)
        symbol[:m] = text[k:].astype(np.uint64) + np.uint64(1)
        symbol[at + k >= end] = 0
        key = (key << np.uint64(9)) | symbol
    sa = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0))
    depth, levels = STEP, {STEP: rank.astype(np.int32)}
    count = int(seg[-1]) + 1 if n else 0
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        active = np.flatnonzero(~single)
        if not len(active):
            return sa, levels
        idx = sa[active]
        on = idx + depth
        inside = on < end[idx]
        second = np.where(inside, rank[np.minimum(on, n - 1)] + count, seg[idx])
        order = np.argsort(rank[idx] * (n + count + 1) + second)
        idx, second = idx[order], second[order]
        sa[active] = idx
        first = rank[idx]
        split = np.ones(len(idx), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[active] = split
        rank[idx] = np.maximum.accumulate(np.where(split, active, 0))
        depth *= 2
        levels[depth] = rank.astype(np.int32)


def common_prefixes(text: np.ndarray, seg_first: np.ndarray, end: np.ndarray, sa: np.ndarray, levels: dict[int, np.ndarray], cap: int) -> np.ndarray:
    """Length, up to ``cap``, that each suffix of ``cap`` bytes or more shares with the one before it in the array; 0 for others.

    Kasai's recurrence, that a suffix shares at least one byte less than the suffix a byte earlier did, runs over all segments
    in step; what is added to it is found with the ranks of the refinement, the greatest depth first.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    longest = int((end[seg_first] - seg_first).max()) if n else 0
    shared = np.zeros(len(seg_first), np.int64)
    depths = sorted(levels, reverse=True)
    alive = np.arange(len(seg_first))
    for t in range(longest):
        alive = alive[seg_first[alive] + t + cap <= end[seg_first[alive]]]
        i = seg_first[alive] + t
        j = before[i]
        l = np.where(j >= 0, np.maximum(shared[alive] - 1, 0), 0)  # noqa: E741
        limit = np.minimum(end[i] - i, end[j] - j)
        x = np.minimum(i + l, n - 1)
        grow = np.flatnonzero((j >= 0) & (l < limit) & (text[x] == text[np.minimum(j + l, n - 1)]))
        if len(grow):
            a, b, have, limit = i[grow], j[grow], l[grow], limit[grow]
            for d in depths:
                while True:
                    fits = have + d <= limit
                    x, y = np.where(fits, a + have, 0), np.where(fits, b + have, 0)
                    fits &= levels[d][x] == levels[d][y]
                    have = have + np.where(fits, d, 0)
                    if d < depths[0] or not fits.any():
                        break
            for _ in range(STEP):
                fits = have < limit
                fits &= text[np.where(fits, a + have, 0)] == text[np.where(fits, b + have, 0)]
                if not fits.any():
                    break
                have = have + fits
            l[grow] = have
        shared[alive] = l
        out[i] = np.minimum(l, cap)
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Unions of [s, s + length) of sorted starts; touching ones are one."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + length).tolist(), strict=True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """Rows of whole (anchor, shard) groups, about SHARD bytes of text together; a part of a divided anchor is alone."""
    held: list[pa.Table] = []
    size, last, alone = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        anchor, shard, shards = (batch.column(k).to_numpy() for k in range(3))
        turn = np.ones(len(anchor), bool)
        turn[1:] = (anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(turn)
        bytes_ = np.add.reduceat(pc.binary_length(batch.column(5)).to_numpy(), at).tolist()
        keys = list(zip(anchor[at].tolist(), shard[at].tolist(), (shards[at] > 1).tolist(), strict=True))
        begin = 0
        for row, add, (a, s, divided) in zip(at.tolist(), bytes_, keys, strict=True):
            if (a, s) != last and size and (size + add > SHARD or divided or alone):
                if row > begin:
                    held.append(table.slice(begin, row - begin))
                yield held
                held, size, begin = [], 0, row
            size, last, alone = size + add, (a, s), divided
        held.append(table.slice(begin))
    if held:
        yield held


_OUT = "rid long, lo long, hi long, digest long, open boolean"


def _shard(parts: list[pa.Table], length: int) -> tuple[list, list[pa.RecordBatch]]:
    """Covered runs (rid, lo, hi) of the segments of one shard, and digests of the distinct strings of divided anchors."""
    table = pa.concat_tables(parts).combine_chunks()
    rid, lo, anchor = (table.column(c).to_numpy() for c in ("rid", "lo", "anchor"))
    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(x, len(number)) for x in table.column("bytes").to_pylist()], np.int64)
    times = np.bincount(kind)
    texts = list(number)
    lead_row = np.full(len(texts), len(kind), np.int64)
    np.minimum.at(lead_row, kind, np.arange(len(kind)))
    size = np.array([len(x) for x in texts], np.int64)
    asks = table.column("open").to_numpy(zero_copy_only=False)
    covered: list[list[tuple[int, int]]] = [_runs(np.arange(n - length + 1), length) if k > 1 else [] for n, k in zip(size.tolist(), times.tolist(), strict=True)]
    # equal segments cover each other; an anchor with a single text, not periodic, has no other equal strings
    _, group, texts_of = np.unique(anchor[lead_row], return_inverse=True, return_counts=True)
    divided = table.column("shards").to_numpy()[lead_row] > 1
    use = np.flatnonzero((texts_of[group] > 1) | (table.column("merged").to_numpy()[lead_row] > 1) | divided)
    first = np.cumsum(size[use]) - size[use]
    text = np.frombuffer(b"".join([texts[k] for k in use.tolist()]), np.uint8)
    seg = np.repeat(np.arange(len(use)), size[use])
    end = np.repeat(first + size[use], size[use])
    hit = np.zeros(len(text), bool)
    lead = np.ones(len(text), bool)
    if len(text):
        sa, levels = suffix_array(text, seg, end)
        lcp = common_prefixes(text, first, end, sa, levels, length)
        full = lcp[sa] >= length  # with the suffix before
        hit[sa[full]] = True
        hit[sa[np.flatnonzero(full) - 1]] = True
        lead[sa[full]] = False  # the first of each group of equal strings speaks for it
    for s, k in enumerate(use.tolist()):
        if times[k] == 1:
            covered[k] = _runs(np.flatnonzero(hit[first[s] : first[s] + size[k]]), length)
    runs = [(r, a + p, b + p) for r, p, k, ask in zip(rid.tolist(), lo.tolist(), kind.tolist(), asks.tolist(), strict=True) if ask for a, b in covered[k]]
    digests = []
    if divided.any():
        own = divided[use]
        start = np.flatnonzero((np.arange(len(text)) + length <= end) & lead & own[seg])
        k = use[seg[start]]
        row = lead_row[k]
        h = tk.signed(tk.span_hash(tk.prefix_hash(text), start, start + length))
        at = start - first[seg[start]] + lo[row]
        alone = ~hit[start] & (times[k] == 1) & asks[row]
        digests.append(pa.record_batch([pa.array(rid[row]), pa.array(at), pa.array(at + length), pa.array(h), pa.array(alone)], names=["rid", "lo", "hi", "digest", "open"]))
    return runs, digests


_PIECE = "anchor long, digest binary, rid long, lo long, hi long, merged long, open boolean"
_NAMES = ["anchor", "digest", "rid", "lo", "hi", "merged", "open"]
_STRETCH = "anchor long, shards int, rid long, lo long, hi long, merged long, open boolean, bytes binary"
_STRETCH_NAMES = ["anchor", "shards", "rid", "lo", "hi", "merged", "open", "bytes"]


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    view = memoryview(data)
    return pa.array([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())


@tk.trimmed
def _stretch_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of _STRETCH: the stretches listed beside each text (rid, text, parts), with their bytes."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for b in batches:
        rows: list[list] = [[] for _ in types]
        held = 0
        for i in range(b.num_rows):
            rid, raw = b.column(0)[i].as_py(), b.column(1)[i].as_buffer().to_pybytes()
            for p in b.column(2)[i].as_py():
                value = raw[p["lo"] : p["hi"] + length - 1]
                for k, x in enumerate((p["anchor"], p["shards"], rid, p["lo"], p["hi"], p["merged"], p["open"], value)):
                    rows[k].append(x)
                held += len(value)
                if held > PART:
                    yield _batch(rows, types, _STRETCH_NAMES)
                    rows, held = [[] for _ in types], 0
        yield _batch(rows, types, _STRETCH_NAMES)


@tk.trimmed
def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, shards, shard, rid, lo, bytes, merged, open) of rows of _STRETCH: parts of at most ``length`` starts, dealt to the shards of their anchor."""
    names = ["anchor", "shards", "shard", "rid", "lo", "bytes", "merged", "open"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        held = 0
        for i in range(b.num_rows):
            anchor, shards, rid, first, end, merged, ask = (b.column(k)[i].as_py() for k in range(7))
            raw = b.column(7)[i].as_buffer().to_pybytes()
            spread = int(tk.mix(np.array([rid & (2**63 - 1)], np.uint64) + np.uint64(first))[0] % np.uint64(shards)) if shards > 1 else 0
            for lo in range(first, end, length):  # periodic stretches are long; each part keeps its starts whole
                value = raw[lo - first : min(lo + length, end) - first + length - 1]
                for k, x in enumerate((anchor, shards, spread, rid, lo, value, merged, ask)):
                    rows[k].append(x)
                held += len(value)
                if held > PART:
                    yield _batch(rows, types, names)
                    rows, held = [[] for _ in names], 0
        yield _batch(rows, types, names)


def _batch(rows: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)


def _cut_again(batches: Iterator[pa.RecordBatch], length: int, q: int, functions: int) -> Iterator[pa.RecordBatch]:
    """Pieces, with their bytes, of the given stretches by the anchors of more hash functions."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            rid, lo, ask = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            raw = b.column(3).to_pylist()
            off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            data = np.frombuffer(b"".join(raw), np.uint8)
            d, h, s, e, m = stretches(data, off, length, q, functions)
            first, last = off[d] + s, off[d] + e + length - 1
            view = memoryview(data)
            own = pa.array([bytes(view[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            yield pa.record_batch([pa.array(tk.signed(h.copy())), _digests(data, first, last), pa.array(rid[d]), pa.array(s + lo[d]), pa.array(e + lo[d]), pa.array(m), pa.array(ask[d]), own], names=[*_NAMES, "bytes"])


def _levels(source: DataFrame, length: int, q: int) -> tuple[list[DataFrame], list[tuple[DataFrame, str]]]:
    """Runs (rid, lo, hi) of stretches that another one equals, and tables of the different stretches of each anchor, each with the condition that tells those to be sorted.

    Texts are shuffled once, for the bytes of all stretches that are sorted or cut again; from there on stretches carry them.
    """

    @tk.trimmed
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids = b.column(0).to_numpy()
            for lo, _, data, off in tk.slices(b.column(1)):
                d, h, s, e, m = stretches(data, off, length, q)
                yield pa.record_batch([pa.array(tk.signed(h.copy())), _digests(data, off[d] + s, off[d] + e + length - 1), pa.array(rids[lo + d]), pa.array(s), pa.array(e), pa.array(m), pa.array(np.ones(len(d), bool))], names=_NAMES)

    spark = source.sparkSession
    pieces, covered, queued = cut(source.mapInArrow(cut_up, _PIECE)), [], []
    for level in range(LEVELS + 1):
        carried = ["bytes"] if level else []
        shared = pieces.groupBy("anchor").agg(F.sum("merged").alias("times")).where("times > 1").select("anchor")
        some = cut(pieces.join(shared, "anchor"))
        discard(pieces)
        release(spark)
        kinds = cut(some.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "lo", "hi", "merged", "open", *carried)).alias("first"), F.max("open").alias("asks")))
        release(spark)
        again = kinds.where("copies > 1 and asks").select("anchor", "digest")
        equal = some.where("open").join(again, ["anchor", "digest"]).select("rid", "lo", (F.col("hi") + length - 1).alias("hi"))
        one = kinds.select("anchor", "first.rid", "first.lo", "first.hi", "first.merged", (F.col("first.open") & (F.col("copies") == 1)).alias("open"), *[f"first.{c}" for c in carried])
        size = one.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("hi") - F.col("lo") + length).alias("size"), F.max("merged").alias("most"), F.max("open").alias("some"))
        wanted = size.where("some and (kinds > 1 or most > 1)").select("anchor", F.ceil(F.col("size") / SHARD).cast("int").alias("shards"))
        covered.append(cut(equal))
        one = one.join(wanted, "anchor")
        if level == 0:
            one = cut(one)
            discard(some, kinds)
            release(spark)
            parts = one.groupBy("rid").agg(F.collect_list(F.struct("anchor", "shards", "lo", "hi", "merged", "open")).alias("parts"))
            held = cut(source.join(parts, "rid").select("rid", "text", "parts").mapInArrow(lambda b: _stretch_bytes(b, length), _STRETCH))
            discard(one)
        else:
            held = cut(one.select(*_STRETCH_NAMES))
            discard(some, kinds)
        release(spark)
        last = level == LEVELS
        queued.append((held, "true" if last else "shards = 1"))
        large = held.where("false" if last else "shards > 1")
        if not large.limit(1).count():
            break
        functions = 1 + FURTHER * (level + 1)
        pieces = cut(large.select("rid", "lo", "open", "bytes").mapInArrow(lambda b, f=functions: _cut_again(b, length, q, f), f"{_PIECE}, bytes binary"))
        release(spark)
    return covered, queued


def repeated_runs(source: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(rid, lo, hi): byte runs of documents (rid, text) that strings of ``length`` bytes starting elsewhere too cover; they may overlap."""
    covered, queued = _levels(source, length, q)
    segments = reduce(DataFrame.union, [held.where(own) for held, own in queued]).mapInArrow(lambda b: _segments(b, length), "anchor long, shards int, shard int, rid long, lo long, bytes binary, merged long, open boolean")

    @tk.trimmed
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield from _answers(*_shard(chunk, length))

    keys = ["anchor", "shard"]
    sorted_ = cut(segments.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(sort, _OUT))
    discard(*[held for held, _ in queued])
    release(source.sparkSession)

    @tk.trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts, as yet without a partner, whose digest another shard has: each is looked up in the sorted digests."""
        tail: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if tail is None else pa.concat_tables([tail, t])
            d = t.column("digest").to_numpy()
            whole = int(np.searchsorted(d, d[-1])) if len(d) else 0  # the last digest may go on
            yield from _matched(t.slice(0, whole))
            tail = t.slice(whole)
        if tail is not None:
            yield from _matched(tail)

    digests = sorted_.where("digest is not null").select("rid", "lo", "hi", "digest", "open")
    merged = digests.repartition("digest").sortWithinPartitions("digest").mapInArrow(merge, "rid long, lo long, hi long")
    return sorted_.where("digest is null").select("rid", "lo", "hi").unionByName(merged).unionByName(reduce(DataFrame.union, covered))


def _answers(runs: list, digests: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = pa.nulls(len(runs))
    cols = [pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]
    yield pa.RecordBatch.from_arrays([*cols, none.cast(pa.int64()), none.cast(pa.bool_())], names=["rid", "lo", "hi", "digest", "open"])
    yield from digests


def _matched(t: pa.Table) -> Iterator[pa.RecordBatch]:
    d = t.column("digest").to_numpy()
    many = np.searchsorted(d, d, side="right") - np.searchsorted(d, d) > 1
    rows = t.filter(pa.array(many & t.column("open").to_numpy(zero_copy_only=False).astype(bool))).select(["rid", "lo", "hi"])
    yield from rows.combine_chunks().to_batches()


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and spans (and kept bytes with ``keep_text``).

    A byte is removed if a string of ``length`` bytes of its text covers it that also starts anywhere else, in the same text or
    another, a repeated row included. spans lists the maximal removed runs as (lo, hi). Null texts are empty: 0 bytes, the digest of
    no bytes. Ids are only carried along, so they may repeat or be null. An empty table gives no rows.
    Other columns are ignored.
    """
    source, unique = keyed(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.col("id").cast("long")) if unique else cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    q = min(Q, max(1, length // 2))
    spans = repeated_runs(rows.select("rid", "text"), length, q).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>" + (", kept binary" if keep_text else "")

    @tk.trimmed
    def erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                runs: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in b.column(2)[i].as_py() or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                kept, at = [], 0
                for lo, hi in runs:
                    kept.append(raw[at:lo])
                    at = hi
                rest = b"".join([*kept, raw[at:]])
                for k, x in enumerate((len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in runs], rest)):
                    out[k].append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.binary()][: 6 if keep_text else 5]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(out, types, strict=False)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(types) + 1])

    return rows.join(spans, "rid", "left").select("id", "text", "spans").mapInArrow(erase, schema)
