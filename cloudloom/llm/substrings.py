"""Fuzzy repeated passages across documents by collinear chaining of shared k-mers.

K-mers of five words are thinned to window minimisers, which equal passages pick alike. Each shared k-mer
has one owner, its first occurrence by (document, position), and every other occurrence meets only the
owner, so the matches grow with the text and not with the square of a group. A task links the repeats that it sees
to the first of them, so a frequent k-mer is shuffled once per stretch of a task; what was linked to a stretch's first
is then handed on to that one's owner, so the matches do not depend on how documents are dealt to tasks. Matches of a pair of
documents are chained in order with gap costs, and the chains are aligned word by word. Seeds that gave no passage so
meet again as pairs of seeds of different owners within MIN_WORDS words, as strings of 4 and 8 consecutive shared seeds and as strings
that span MIN_WORDS words, each with the first document that holds it as owner: parts of a passage that have different
owners so lead to the document that holds the whole. A string of MIN_WORDS equal words is itself a passage with its
owner, so words in one are always covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import cut, discard, keyed, release, rid, whole

K = 5
WINDOW = 4
MIN_WORDS = 40
PERCENT = 80
MAX_GAP = 60  # words between two blocks of a chain
GAP_COST = 0.02  # per word of gap on either side, in seeds
MIN_SEEDS = 2
PAD = 48  # words by which a chain may grow in the alignment
FEW = 32  # blocks of a pair that are compared one by one instead of by a tree
HELD = 500_000  # k-mers among which a task links repeats itself
ROWS = 1024  # of texts that are gone through as Python strings
ASKED = 4096  # stretches of a text that are cut out by one task
SHARED = -1  # in place of a position: no match, but other documents have the k-mer


def minimisers(h: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hashes of each ``window`` consecutive ones; windows end with their text.

    first: text i has h[first[i]:first[i+1]]. All places that tie for the least are picked.
    """
    count = np.diff(first)
    pad = window - 1
    top = np.iinfo(np.uint64).max
    at = np.arange(len(h)) + np.repeat(np.arange(len(count)), count) * pad + pad
    full = np.full(len(h) + len(count) * pad + 2 * pad, top, np.uint64)
    full[at] = h
    low, width = full, 1  # low[i] is the least of full[i : i + width]
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    inside = np.zeros(len(full), bool)
    inside[at] = True
    low = np.where(inside[: len(low)], low, np.uint64(0))  # windows start at a word
    high, width = low, 1
    while width < window:
        step = min(width, window - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    return np.flatnonzero(high[at - pad] == h)


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Best of places below i."""
        out = (float("-inf"), -1)
        while i:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def blocks(pos: np.ndarray, other: np.ndarray, pair: np.ndarray | None = None) -> np.ndarray:
    """Seeds of pairs of documents merged along diagonals: rows (pos, other, end, seeds, pair), sorted by pair, pos and other. Equal seeds count once."""
    pair = np.zeros(len(pos), np.int64) if pair is None else pair
    order = np.lexsort((pos, pos - other, pair))
    d, p, o = pair[order], pos[order], other[order]
    like = (d[1:] == d[:-1]) & (p[1:] - o[1:] == p[:-1] - o[:-1])
    once = np.ones(len(p), bool)
    once[1:] = ~(like & (p[1:] == p[:-1]))
    new = np.ones(len(p), bool)
    new[1:] = ~like | (p[1:] - p[:-1] > MAX_GAP)
    d, p, o, new = d[once], p[once], o[once], new[once]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(p))
    out = np.stack([p[starts], o[starts], p[ends - 1] + K, ends - starts, d[starts]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0], out[:, 4]))]


def _forerunners(left: list[list[int]]) -> tuple[list[float], list[int]]:
    """The score of the best chain that ends with each block, and the block before it there (-1: none)."""
    score, back = [0.0] * len(left), [-1] * len(left)

    def put(i: int, value: float, j: int) -> None:
        gain = value - GAP_COST * float(left[i][0] + left[i][1])
        score[i], back[i] = float(left[i][3]) + max(gain, 0.0), j if gain > 0 else -1

    if len(left) <= FEW:
        worth: list[float] = []
        for i, (p, o, end, _) in enumerate(left):
            best = (float("-inf"), -1)
            for j in range(i):
                q = left[j]
                if q[2] <= p and q[1] + q[2] - q[0] <= o and (worth[j], j) > best:
                    best = (worth[j], j)
            put(i, *best)
            worth.append(score[i] + GAP_COST * float(end + o + end - p))
        return score, back
    rows = np.array(left)
    end_other = rows[:, 1] + rows[:, 2] - rows[:, 0]
    values = np.unique(np.concatenate([rows[:, 1], end_other]))
    tree, done = Fenwick(len(values)), 0
    by_end = np.argsort(rows[:, 2], kind="stable").tolist()
    place, start_place, end_other = np.searchsorted(values, end_other).tolist(), np.searchsorted(values, rows[:, 1], side="right").tolist(), end_other.tolist()
    for i in range(len(left)):
        while done < len(left) and left[by_end[done]][2] <= left[i][0]:
            j = by_end[done]
            tree.put(place[j], (score[j] + GAP_COST * float(left[j][2] + end_other[j]), j))
            done += 1
        put(i, *tree.get(start_place[i]))
    return score, back


def chains(seeds: np.ndarray) -> list[np.ndarray]:
    """Disjoint chains of blocks in falling score, each with its blocks in order in both documents.

    The score of a chain is its seeds less GAP_COST for each word of gap on either side; a Fenwick tree over the
    ends in the other document finds each block's best forerunner. A block joins one only past its end on one side.
    """
    left, out = seeds[:, :4].tolist(), []
    while left:
        score, back = _forerunners(left)
        chain = [score.index(max(score))]
        while back[chain[-1]] >= 0:
            chain.append(back[chain[-1]])
        rows = [left[i] for i in reversed(chain)]
        if sum(r[3] for r in rows) < MIN_SEEDS:
            break
        out.append(np.array(rows))
        lo, hi = rows[0][0], rows[-1][2]
        left = [r for r in left if r[0] >= hi or r[2] <= lo]  # what overlaps the chain's stretch is explained by it
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matches of a longest common subsequence of two short stretches."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best = np.maximum(table[i + 1, :-1], np.where(b == a[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: np.ndarray, b: np.ndarray, anchors: np.ndarray, most: bool = False) -> np.ndarray:
    """Which words of a meet an equal word of b, as the chain's anchors (pos, other, end) order them.

    Along a block and outwards from the ends words are compared one to one; between blocks by longest common subsequence,
    or with ``most`` not at all: then all words between blocks count, so that no alignment has more.
    """
    hit = np.zeros(len(a), bool)
    done_a = done_b = 0
    for k, (p, o, end) in enumerate(anchors[:, :3].tolist()):
        shift = max(0, done_a - p, done_b - o)  # blocks may overlap by a few words
        p, o = p + shift, o + shift
        if p >= end:
            continue
        if k == 0:
            n = min(p, o)
            hit[p - n : p] = a[p - n : p] == b[o - n : o]
        elif p - done_a and o - done_b and max(p - done_a, o - done_b) <= 4 * MAX_GAP:
            if most:
                hit[done_a:p] = True
            else:
                for i, _ in _pairs(a[done_a:p], b[done_b:o]):
                    hit[done_a + i] = True
        hit[p:end] = a[p:end] == b[o : o + end - p]
        done_a, done_b = end, o + end - p
    n = min(len(a) - done_a, len(b) - done_b)
    hit[done_a : done_a + n] = a[done_a : done_a + n] == b[done_b : done_b + n]
    return hit


def runs(hit: np.ndarray, percent: int = PERCENT, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, hits) of all maximal scoring stretches (Ruzzo and Tompa) of ``least`` words or more, in order.

    Hits score 100-percent and misses -percent. No part of a stretch scores as much as the whole, and no longer stretch
    has that property; they are disjoint, and each has at least ``percent`` hits.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    total = np.concatenate([[0], np.cumsum(np.where(hit, 100 - percent, -percent))])
    held: list[tuple[int, int, int, int, int]] = []  # sum before, sum after, start, end, the last one before with a smaller sum before
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        low, high = int(total[start]), int(total[end])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= high:
                break
            low, start = held[j][0], held[j][2]
            del held[j:]
        held.append((low, high, start, end, j))
    return [(start, end, int(hit[start:end].sum())) for _, _, start, end, _ in held if end - start >= least]


_MATCH = "gram long, rid long, pos int, orid long, opos int"
_OWNED = _MATCH + ", local boolean"


@tk.trimmed
def _kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, rid, pos, orid, opos) of seeds. In each stretch of HELD seeds, those of later documents are matched with the first one's.

    The first document's seeds have no match yet; opos is SHARED for those that another document of the stretch has.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def linked() -> Iterator[pa.RecordBatch]:
        gram, rid_, pos = (np.concatenate([x[k] for x in held]) for k in range(3))
        held.clear()
        order = np.argsort(gram)
        like = gram[order][1:] == gram[order][:-1]
        many = np.append(like, False) | np.append(False, like)
        one, some = order[~many], order[many]  # most k-mers occur once
        yield _matches(gram[one], rid_[one], pos[one], rid_[one], pos[one], np.ones(len(one), bool), np.ones(len(one), bool))
        some = some[np.lexsort((pos[some], rid_[some], gram[some]))]
        gram, rid_, pos = gram[some], rid_[some], pos[some]
        first, alone = _firsts(gram, rid_)
        later = rid_ != rid_[first]
        none = ~later & alone
        yield _matches(gram, rid_, pos, rid_[first], np.where(later, pos[first], SHARED), ~later, none)

    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, off in tk.slices(batch.column(1)):
            h, d, p = tk.grams(tk.words(data, off, loose=True), K)
            pick = minimisers(h, np.searchsorted(d, np.arange(hi - lo + 1)), WINDOW)
            held.append((tk.signed(h[pick]), rids[lo:hi][d[pick]], p[pick].astype(np.int32)))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from linked()
    if held:
        yield from linked()


def _firsts(gram: np.ndarray, rid_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by gram, rid: the first row of the gram, and whether the gram is in one document only."""
    at = np.arange(len(gram))
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    first = np.maximum.accumulate(np.where(new, at, 0))
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(gram))[: len(starts)] - 1
    return first, np.repeat(rid_[starts] == rid_[last], np.diff(np.append(starts, len(gram))))


def _local(b: pa.RecordBatch, local: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, local))], names=[*b.schema.names, "local"])


def _matches(gram: np.ndarray, rid_: np.ndarray, pos: np.ndarray, orid: np.ndarray, opos: np.ndarray, no_orid: np.ndarray, no_opos: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(gram), pa.array(rid_), pa.array(pos.astype(np.int32)), pa.array(orid, mask=no_orid), pa.array(opos.astype(np.int32), mask=no_opos)], names=["gram", "rid", "pos", "orid", "opos"])


@tk.trimmed
def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of the first seeds of all stretches, sorted by gram, with the first document's; matches come as they are, as local ones.

    The first document's seeds stay, without a match, if another document has the k-mer.
    """
    held = pa.schema([("gram", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()), ("orid", pa.int64()), ("opos", pa.int32())]).empty_table()

    def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            gram, rid_, pos = (t.column(k).to_numpy() for k in range(3))
            known = t.column(4).is_valid().to_numpy()
            like = gram[1:] == gram[:-1]
            some = np.flatnonzero(known | np.append(like, False) | np.append(False, like))  # most k-mers occur once
            some = some[np.lexsort((pos[some], rid_[some], gram[some]))]
            gram, rid_, pos, known = gram[some], rid_[some], pos[some], known[some]
            first, alone = _firsts(gram, rid_)
            shared = np.zeros(len(gram), bool)
            np.logical_or.at(shared, first, known | ~alone)
            keep, later = shared[first], rid_ != rid_[first]
            yield _local(_matches(gram[keep], rid_[keep], pos[keep], rid_[first][keep], pos[first][keep], ~later[keep], ~later[keep]), False)

    for batch in batches:
        done = batch.column(3).is_valid()
        yield _local(batch.filter(done), True)
        t = pa.concat_tables([held, pa.Table.from_batches([batch.filter(pc.invert(done))]).cast(held.schema)])
        gram = t.column(0).to_numpy()
        whole = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0  # the last gram may go on
        yield from close(t.slice(0, whole))
        held = t.slice(whole).combine_chunks()
    yield from close(held)


_CHAIN = "rid long, chain int, orid long, lo int, hi int, olo int, ohi int, anchors binary"


@tk.trimmed
def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the matches of each pair of documents, in a stream sorted by rid. All pairs of a batch are merged to blocks at once."""
    for t in whole(batches, "rid"):
        rid_, orid, pos, other = (t.column(c).to_numpy().astype(np.int64) for c in ("rid", "orid", "pos", "opos"))
        order = np.lexsort((orid, rid_))
        new = np.ones(len(order), bool)
        new[1:] = (rid_[order][1:] != rid_[order][:-1]) | (orid[order][1:] != orid[order][:-1])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        found = blocks(pos, other, pair)
        starts = np.flatnonzero(np.diff(found[:, 4], prepend=-1))
        ends = np.append(starts[1:], len(found))
        some = (ends - starts > 1) | (found[starts, 3] >= MIN_SEEDS)
        rows: list[tuple] = []
        number, last = 0, None
        for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            at = first[found[a, 4]]
            own, source = int(rid_[at]), int(orid[at])
            if own != last:
                number, last = 0, own
            for c in chains(found[a:b, :4]) if b - a > 1 else (found[a:b, :4],):
                (p, o), (q, r, end) = c[0, :2].tolist(), c[-1, :3].tolist()
                lo, olo = max(0, p - PAD), max(0, o - PAD)
                rows.append((own, number, source, lo, end + PAD, olo, r + end - q + PAD, (c[:, :3] - np.array([lo, olo, lo])).astype(np.int32).tobytes()))
                number += 1
        yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["rid", "chain", "orid", "lo", "hi", "olo", "ohi", "anchors"])


@tk.trimmed
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes lo:hi of each stretch asked of a text (text, asked)."""
    for batch in batches:
        asked = batch.column(1)
        for a, b, data, off in tk.slices(batch.column(0)):
            w = tk.words(data, off, loose=True)
            small = w.hash.astype(np.uint32)
            rows = []
            for i in range(b - a):
                for r in asked[a + i].as_py():
                    rows.append((r["for_rid"], r["chain"], r["side"], small[w.first[i] + r["lo"] : min(w.first[i + 1], w.first[i] + r["hi"])].tobytes()))
                if len(rows) >= ASKED:
                    yield _piece_rows(rows)
                    rows = []
            yield _piece_rows(rows)


def _piece_rows(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["rid", "chain", "side", "words"])


@tk.trimmed
def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            a, b = np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint32)
            anchors = np.frombuffer(r["anchors"], np.int32).reshape(-1, 3)
            if len(anchors) > 1 and not runs(align(a, b, anchors, most=True)):
                continue  # a stretch of fewer hits lies within one of more
            for lo, hi, hits in runs(align(a, b, anchors)):
                rows.append((r["rid"], r["orid"], r["lo"] + lo, r["lo"] + hi, hits / (hi - lo)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()])], names=["rid", "source_rid", "first_word", "end_word", "identity"])


@tk.trimmed
def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared seeds (gram, rid, pos, owner, open), open: matched, but in no passage. Rows of a document: its passages (kind 0, pos to end), its seeds (1, or 2 as owner)."""
    for t in whole(batches, "rid"):
        rid_, pos, kind = t.column("rid").to_numpy(), t.column("pos").to_numpy().astype(np.int64), t.column("kind").to_numpy()
        place = (np.cumsum(np.diff(rid_, prepend=rid_[:1]) != 0) << 32) + pos  # documents one after the other
        seed, span = np.flatnonzero(kind > 0), np.flatnonzero(kind == 0)
        if not len(seed):
            continue
        seed = seed[np.argsort(place[seed])]
        at, owner = place[seed], kind[seed] == 2
        ends = place[span] - pos[span] + t.column("end").to_numpy()[span]
        inside = np.zeros(len(seed) + 1, np.int64)
        np.add.at(inside, np.searchsorted(at, place[span]), 1)
        np.add.at(inside, np.searchsorted(at, ends - K, side="right"), -1)
        left = ~owner & (np.cumsum(inside)[:-1] == 0)
        yield pa.record_batch([t.column("gram").combine_chunks().take(pa.array(seed)), pa.array(rid_[seed]), pa.array(pos[seed].astype(np.int32)), pa.array(owner), pa.array(left)], names=["gram", "rid", "pos", "owner", "open"])


def strings(gram: np.ndarray, pos: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first seed, last seed) of the pairs of seeds that start within MIN_WORDS words and have different owners ``low``,
    whatever stands between them, and of the strings of 4 and 8 consecutive seeds and of those that just span MIN_WORDS words.

    The seeds of a string lie at most MAX_GAP apart; the spacing counts in the last kind only.
    """
    n = len(gram)
    powers, inverse = tk._power_tables(n + 1)
    gap = np.diff(pos, prepend=pos[:1])
    part = np.cumsum(gap > MAX_GAP)
    out = []
    with np.errstate(over="ignore"):
        plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(gram) * powers[:n])])
        spaced = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(gram + gap.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * powers[:n])])
        count = np.searchsorted(pos, pos + MIN_WORDS, side="right") - np.arange(n) - 1
        i = np.repeat(np.arange(n), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        i, j = i[low[i] != low[j]], j[low[i] != low[j]]
        out.append((tk.mix(tk.mix(gram[i]) + gram[j]), i, j))
        for size in (4, 8):
            i = np.arange(max(0, n - size + 1))
            out.append((tk.mix((plain[i + size] - plain[i]) * inverse[i] + np.uint64(size)), i, i + size - 1))
        i = np.arange(n)
        j = np.searchsorted(pos, pos + MIN_WORDS - K)
        i, j = i[j < n], j[j < n]
        out.append((tk.mix(tk.mix((spaced[j + 1] - spaced[i + 1]) * inverse[i + 1]) + gram[i]), i, j))
    h, i, j = (np.concatenate([x[k] for x in out]) for k in range(3))
    ok = part[i] == part[j]
    return h[ok], i[ok], j[ok]


@tk.trimmed
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of each document (gram, rid, pos, width, open), open: some seed is open, and none is its owner's, whose strings no earlier document has."""
    for t in whole(batches, "rid"):
        order = np.lexsort((t.column("pos").to_numpy(), t.column("rid").to_numpy()))
        gram, rid_, pos, low, opens, owner = (t.column(c).to_numpy(zero_copy_only=False)[order] for c in ("gram", "rid", "pos", "low", "open", "owner"))
        pos = pos.astype(np.int64)
        turn = np.diff(rid_, prepend=rid_[:1]) != 0
        apart = np.cumsum(np.where(turn, np.roll(pos, 1) + MAX_GAP + MIN_WORDS + 1, 0))  # documents one after the other, too far apart for a string
        h, i, j = strings(gram.view(np.uint64), pos + apart, low)
        some, own = (np.concatenate([[0], np.cumsum(x)]) for x in (opens, owner))
        asks = (some[j + 1] > some[i]) & (own[j + 1] == own[i])
        yield pa.record_batch([pa.array(tk.signed(h)), pa.array(rid_[i]), pa.array(pos[i].astype(np.int32)), pa.array((pos[j] - pos[i]).astype(np.int32)), pa.array(asks)], names=["gram", "rid", "pos", "width", "open"])


def _passages(matches: DataFrame, source: DataFrame) -> DataFrame:
    """Aligned stretches (rid, source_rid, first_word, end_word, identity) of the chains of seeds (rid, orid, pos, opos), cut."""
    key = ["rid", "orid", "pos", "opos"]
    found = cut(matches.select(*key).repartition("rid").sortWithinPartitions("rid").mapInArrow(_chained, _CHAIN))
    release(source.sparkSession)
    asked = found.select("rid", F.col("rid").alias("for_rid"), "chain", F.lit(0).alias("side"), "lo", "hi").union(
        found.select("orid", "rid", "chain", F.lit(1), "olo", "ohi")
    )
    # a text goes with up to about ASKED stretches at once, so that a document that many others repeat is dealt out
    share = asked.groupBy("rid").count().select("rid", F.ceil(F.col("count") / ASKED).alias("of"))
    dealt = asked.join(share, "rid").groupBy("rid", F.pmod(F.xxhash64("for_rid", "chain"), F.col("of")).alias("part")).agg(F.collect_list(F.struct("for_rid", "chain", "side", "lo", "hi")).alias("asked"))
    pieces = dealt.join(source, "rid").select("text", "asked").mapInArrow(_pieces, "rid long, chain int, side int, words binary")
    both = pieces.groupBy("rid", "chain").agg(F.max(F.when(F.col("side") == 0, F.col("words"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("words"))).alias("b"))
    out = cut(both.join(found, ["rid", "chain"]).select("rid", "orid", "lo", "a", "b", "anchors").mapInArrow(_aligned, "rid long, source_rid long, first_word int, end_word int, identity double"))
    discard(found)
    return out


def _found(source: DataFrame) -> DataFrame:
    """(rid, source_rid, first_word, end_word, identity) over documents (rid, text)."""
    spark = source.sparkSession
    # matches are spread, what may still have an owner elsewhere meets by its k-mer
    deal = F.when(F.col("orid").isNull(), F.col("gram")).otherwise(F.xxhash64("rid", "pos"))
    matches = cut(source.mapInArrow(_kmers, _MATCH).repartition(deal).sortWithinPartitions("gram").mapInArrow(_owned, _OWNED))
    release(spark)
    # a stretch's first document is in that stretch alone, so a key of this join holds at most a stretch's seeds
    handed = matches.where("not local and orid is not null").groupBy("gram", F.col("rid").alias("orid")).agg(F.min("orid").alias("to_rid"), F.min("opos").alias("to_pos"))
    local = matches.where("local").join(handed, ["gram", "orid"], "left").select("rid", F.coalesce("to_rid", "orid").alias("orid"), "pos", F.coalesce("to_pos", "opos").alias("opos"))
    known = matches.where("not local and orid is not null").select("rid", "orid", "pos", "opos")
    passages = _passages(known.union(local), source)
    release(spark)
    # seeds that gave no passage with their owner meet again as strings, each string with its own owner
    spans = passages.select("rid", F.lit(0).alias("kind"), F.col("first_word").alias("pos"), F.col("end_word").alias("end"), F.lit(None).cast("long").alias("gram"))
    seeds = matches.select("rid", F.when(F.col("orid").isNull(), 2).otherwise(1), "pos", F.lit(0), "gram")
    marked = cut(spans.union(seeds).repartition("rid").sortWithinPartitions("rid").mapInArrow(_open, "gram long, rid long, pos int, owner boolean, open boolean"))
    discard(matches)
    release(spark)
    again = marked.groupBy("gram").agg(F.min("rid").alias("low"), F.max("open").alias("some")).where("some").select("gram", "low")
    spots = marked.join(again, "gram")
    chosen = cut(spots.repartition("rid").sortWithinPartitions("rid").mapInArrow(_strings, "gram long, rid long, pos int, width int, open boolean"))
    discard(marked)
    release(spark)
    owner = chosen.groupBy("gram").agg(F.min(F.struct("rid", "pos", "width")).alias("first"), F.max(F.when(F.col("open"), F.col("rid"))).alias("last")).where("first.rid < last")
    # as a table of its own, so that the join shuffles both sides itself and AQE can split a hot string
    owner = cut(owner.select("gram", F.col("first.rid").alias("orid"), F.col("first.pos").alias("opos"), F.col("first.width").alias("owidth")))
    release(spark)
    ends = F.inline(F.array(F.struct(F.col("pos").alias("pos"), F.col("opos").alias("opos")), F.struct((F.col("pos") + F.col("width")).alias("pos"), (F.col("opos") + F.col("owidth")).alias("opos"))))
    more = chosen.where("open").join(owner, "gram").where("rid > orid").select("rid", "orid", ends)
    again = _passages(more, source)
    discard(chosen, owner)
    release(spark)
    return passages.union(again).groupBy("rid", "source_rid", "first_word", "end_word").agg(F.max("identity").alias("identity"))


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per repeated passage: id, source_id, first_word, end_word, n_words, identity.

    The passage of the document with the larger key repeats one of ``source_id``: at least MIN_WORDS words of which
    PERCENT of a hundred are aligned to equal words. Words are lower-cased and parted by space and ASCII punctuation. Passages
    from several sources may overlap. Repeats within one document, and fully repeated rows, are not reported.
    Between two matched stretches more than 4 * MAX_GAP words apart, which share no seed, words count as different.
    Where ids repeat or are null the order is that of a digest of id and text, and rows are given for each such document
    once. Null, empty and short texts have no passages; an empty table gives no rows. Other columns are ignored.
    """
    source, unique = keyed(docs, id_col, text_col)
    if not unique:
        source = source.dropDuplicates(["rid"])
    found = _found(source)
    if unique:
        out = found.withColumnRenamed("rid", id_col).withColumnRenamed("source_rid", "source_id")
    else:
        ids = docs.select(rid(False, id_col, text_col), F.col(id_col)).dropDuplicates(["rid"])
        names = ids.select(F.col("rid").alias("source_rid"), F.col(id_col).alias("source_id"))
        out = found.join(ids, "rid").join(names, "source_rid")
    return out.select(id_col, "source_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "identity")


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from all documents but their source; same columns.

    Each passage goes with the space up to the next word. ``n_chars``, where there is such a column, is counted anew. Documents of which no word
    is left are dropped; those without words before stay as they are. Rows that repeat fully are cut alike.
    """
    source, unique = keyed(docs, id_col, text_col)
    spans = _found(source if unique else source.dropDuplicates(["rid"])).groupBy("rid").agg(F.collect_list(F.struct("first_word", "end_word")).alias("__spans")).withColumnRenamed("rid", "__rid")
    rows = docs.withColumn("__rid", rid(unique, id_col, text_col)).join(spans, "__rid", "left").drop("__rid")
    at, width = docs.columns.index(text_col), len(docs.columns)

    @tk.trimmed
    def erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = batch.column(at)
            spans = batch.column(width)
            some = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            new, keep = texts.to_pylist(), np.ones(batch.num_rows, bool)
            for i in some.tolist():
                data, off = tk.text_buffer(texts.slice(i, 1))
                w = tk.words(data, off, loose=True)
                gone = np.zeros(len(w.hash), bool)
                for s in spans[i].as_py():
                    gone[s["first_word"] : s["end_word"]] = True
                stop = np.append(w.start[1:], len(data))
                mask = np.ones(len(data), bool)
                for k in np.flatnonzero(gone):
                    mask[w.start[k] : stop[k]] = False
                new[i], keep[i] = data[mask].tobytes().decode("utf-8"), not gone.all()
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array(keep))

    out = rows.mapInArrow(erase, docs.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
