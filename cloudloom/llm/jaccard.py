"""Exact n-gram Jaccard join by vertical partitioning.

The distinct n-grams of a text are put in one global order: the most frequent ones last, else by hash. Two texts that
reach the threshold share a gram among the first n - ceil(t n) + 1 of each. Grams of a few texts make pairs, kept if the
pair shares as many as it must. All texts that share any other gram also share its centre, the smallest set that has
it, so groups by centre hold every candidate pair while their rows grow with the texts, not with the pairs.

The candidates of a group are then partitioned vertically: the gram order is cut into fragments, each set into
the segments that lie in them, and every fragment goes to a task of its own, which counts the partial overlaps of its
segments. The partial counts are shuffled by pair and summed. A pair whose segments differ by more in one fragment than
linked sets may differ at all is not passed on. Large groups are split into blocks of sets that meet pair by pair, so a
task holds a bounded number of sets and of grams. Links leave the sum as a spanning forest and as counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import components, cut, discard, groups, keyed, release
from .common import rid as key_of

OFTEN = 2  # uses of a gram by different texts of one stretch of a partition from which they are counted
STRETCH = 4_000_000  # grams in such a stretch
HOT_DF, HOT_GRAMS = 8, 8_000_000  # counted uses from which a gram goes to the end of the order, and how many at most, the most frequent ones; any choice is right
BITS = 27  # of the table that marks them, 16 MB
SMALL = 8  # sets with a gram up to which they meet as pairs, and not in a group
COLUMNS = 2048  # grams of a fragment that are counted together
BLOCK, FULL = 1024, 1_000_000  # sets in a block, grams of two blocks in a fragment
MIX = np.uint64(0x9FB21C651E98DF25)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rids, offsets, sorted distinct gram hashes) of slices of a batch (rid, text)."""
    rids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, off in tk.slices(batch.column(1)):
        h, d, _ = tk.grams(tk.words(data, off), n, short=True)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
        yield rids[lo:hi], np.searchsorted(d, np.arange(hi - lo + 1)), h


def _set_ids(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit digest of each set of grams; 0 for an empty set."""
    sums = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(tk.mix(h * MIX), out=sums[1:])
        total = tk.mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64))
    total[np.diff(off) == 0] = 0
    return tk.signed(total)


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _overlaps(grams: np.ndarray, left: np.ndarray, right: np.ndarray, nl: int, nr: int) -> np.ndarray:
    """How many grams each set of the left shares with each of the right, within a fragment.

    left, right: the set's number on that side for each gram, -1 if it isn't on it.
    """
    order = np.argsort(grams, kind="stable")
    grams, left, right = grams[order], left[order], right[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    rank = np.cumsum(new) - 1
    both = (np.bincount(rank, left >= 0) > 0) & (np.bincount(rank, right >= 0) > 0) & (np.bincount(rank) > 1)
    column = np.cumsum(both) - 1
    keep = both[rank]
    left, right, column = left[keep], right[keep], column[rank[keep]]
    total = np.zeros((nl, nr), np.float32)
    for lo in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x, y, c = left[a:b], right[a:b], column[a:b] - lo
        part = np.zeros((nl, COLUMNS), np.float32)
        part[x[x >= 0], c[x >= 0]] = 1
        other = np.zeros((nr, COLUMNS), np.float32)
        other[y[y >= 0], c[y >= 0]] = 1
        total += part @ other.T
    return total


def _need(total: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets that have ``total`` grams together."""
    return -(-percent * total // (100 + percent))


def _sides(side: np.ndarray, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of block bi and of block bj."""
    return np.flatnonzero(side == bi), np.flatnonzero(side == bj)


def _fragment(g: pa.Table, percent: int) -> bytes:
    """Pairs with the partial overlap of one fragment, as rows (left, right, count) of uint32."""
    n, size = g.column("n").to_numpy(), pc.binary_length(g.column("grams")).to_numpy() // 8
    left, right = _sides(g.column("side").to_numpy(), g.column("bi")[0].as_py(), g.column("bj")[0].as_py())
    place = np.full((2, len(n)), -1, np.int64)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    grams = np.frombuffer(b"".join(g.column("grams").to_pylist()), np.uint64)
    count = _overlaps(grams, np.repeat(place[0], size), np.repeat(place[1], size), len(left), len(right))
    total = n[left][:, None] + n[right][None, :]
    differ = size[left][:, None] + size[right][None, :] - 2 * count
    ok = (count > 0) & (differ <= total - 2 * _need(total, percent))
    if g.column("bi")[0] == g.column("bj")[0]:
        ok &= np.tri(len(left), k=-1, dtype=bool).T
    i, j = np.nonzero(ok)
    return np.stack([i, j, count[i, j]], axis=1).astype(np.uint32).tobytes()


def _forest(count: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what all the links connect."""
    parent = np.arange(count)
    while True:  # minimum labels with pointer jumping, so thousands of links cost a few array passes
        low = np.minimum(parent[left], parent[right])
        new = parent.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, parent[left], low)
        np.minimum.at(new, parent[right], low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    return [(int(i), int(p)) for i, p in enumerate(parent) if i != p]


def _links(sets: list[tuple], cells: list[bytes], centre: int, bi: int, bj: int, percent: int) -> tuple[list, list]:
    """Forest edges and link counts of a pair of blocks from the partial counts of its fragments.

    sets: (side, rid, n, centres) in the order that the fragments had.
    """
    side, rid, n = (np.array([x[k] for x in sets], np.int64) for k in range(3))
    at = _sides(side, bi, bj)
    total = np.zeros((len(at[0]), len(at[1])), np.uint32)
    for raw in cells:
        c = np.frombuffer(raw, np.uint32).reshape(-1, 3)
        total[c[:, 0], c[:, 1]] += c[:, 2]  # a pair comes once in a fragment
    i, j = np.nonzero(total)
    left, right = at[0][i], at[1][j]
    ok = total[i, j] >= _need(n[left] + n[right], percent)
    left, right = left[ok], right[ok]
    if not len(left):
        return [], []
    size = len(sets)
    smaller = [[c for c in x[3] if c < centre] for x in sets]
    known = {c: i for i, c in enumerate(sorted({c for cs in smaller for c in cs}))}
    fresh = np.ones(len(left), bool)
    for lo in range(0, len(known), COLUMNS):  # a pair that also meets under a smaller centre is counted there
        belongs = np.zeros((size, COLUMNS), np.float32)
        for i, cs in enumerate(smaller):
            belongs[i, [known[c] - lo for c in cs if lo <= known[c] < lo + COLUMNS]] = 1
        fresh &= (belongs @ belongs.T)[left, right] == 0
    degree = np.bincount(left[fresh], minlength=size) + np.bincount(right[fresh], minlength=size)
    return [(int(rid[a]), int(rid[b])) for a, b in _forest(size, left, right)], [(int(rid[i]), int(degree[i])) for i in np.flatnonzero(degree)]


_STEPS = 16  # bands of size within a factor of 100 / percent, at 80


def _band(n: Column) -> Column:
    return F.floor(F.log(n) * float(_STEPS / np.log(1.25)))


def _with_partner(met: DataFrame, percent: int) -> DataFrame:
    """Members (sid, centre, n, shared, band) of groups that also have a member of a size that they could be linked with.

    Linked sets of s and l >= s grams share at least c s - (d - c) l grams that lie in the prefixes of both, with
    c = percent / (100 + percent) and d = percent / 100, as d l of the larger one's are outside. A set shares ``shared``
    grams of its prefix with any other, so with few of them only much larger or smaller partners are left, or none.
    """
    c, d = percent / (100 + percent), percent / 100
    n, t = F.col("n"), F.col("shared")
    most = F.greatest(F.least((t + (d - c) * n) / c, n), d * n)  # of smaller partners
    least = F.least(F.greatest((c * n - t) / (d - c), n), n / d) if d > c else n  # of larger ones
    span = lambda lo, hi: F.sequence(_band(lo * (1 - 1e-9)), _band(hi * (1 + 1e-9)))
    own = F.col("band")
    wanted = met.select("sid", "centre", "n", own.alias("own"), F.explode(F.array_union(span(d * n, most), span(least, n / d))).alias("band"))
    there = met.groupBy("centre", "band").agg(F.count("*").alias("k"))
    able = wanted.join(there, ["centre", "band"]).where((F.col("k") > 1) | (F.col("band") != F.col("own")))
    return able.select("sid", "centre", "n").distinct()


_KEY = ["centre", "bi", "bj"]
_SEGMENT = "centre long, bi int, bj int, frag int, side int, rid long, n long, centres array<long>, grams binary"


@tk.trimmed
def _segments(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per block pair of each set, and one for each segment of it there; rows in: rid, text, places, centres."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = ["centre", "bi", "bj", "frag", "side", "rid", "n", "centres", "grams"]
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        at = 0
        for rids, off, h in _sets(batch, n):
            deal = tk.mix(rids.astype(np.int64).view(np.uint64))
            for k, (rid, places, centres) in enumerate(zip(rids.tolist(), batch.column(2).slice(at, len(rids)).to_pylist(), batch.column(3).slice(at, len(rids)).to_pylist(), strict=True)):
                grams = h[off[k] : off[k + 1]]
                for p in places:
                    nb, nf = p["nb"], p["nf"]
                    own = int(deal[k] % np.uint64(nb))
                    edge = np.searchsorted((grams >> np.uint64(32)) * np.uint64(nf) >> np.uint64(32), np.arange(nf + 1))
                    parts = [grams[edge[f] : edge[f + 1]].tobytes() for f in range(nf)]
                    for other in range(nb):
                        head = (p["centre"], min(own, other), max(own, other))
                        rows.append((*head, -1, own, rid, len(grams), centres, None))
                        rows += [(*head, f, own, rid, len(grams), None, x) for f, x in enumerate(parts)]
                        held += 8 * len(grams) + 200
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)
                        rows, held = [], 0
            at += len(rids)
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)


@tk.trimmed
def _partial(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of sets as they are, and a row of partial counts for each fragment of a block pair."""
    for g in groups(batches, [*_KEY, "frag"]):
        frag = g.column("frag")[0].as_py()
        if frag < 0:
            yield from g.to_batches()
            continue
        head = g.slice(0, 1).select([*_KEY, "frag", "side", "rid", "n"]).append_column("centres", pa.nulls(1, pa.list_(pa.int64())))
        yield from head.append_column("grams", pa.array([_fragment(g, percent)], pa.binary())).combine_chunks().to_batches()


@tk.trimmed
def _summed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Forest edges (a, b, null) and link counts (a, null, links) of the block pairs; rows are sorted by pair of blocks and fragment."""
    key, sets, cells, rows = None, [], [], []

    def close() -> None:
        if key and cells:
            edges, degrees = _links(sets, cells, *key, percent)
            rows.extend((a, b, None) for a, b in edges)
            rows.extend((a, None, c) for a, c in degrees)

    for batch in batches:
        for r in batch.to_pylist():
            if (own := (r["centre"], r["bi"], r["bj"])) != key:
                close()
                key, sets, cells = own, [], []
            if r["frag"] < 0:
                sets.append((r["side"], r["rid"], r["n"], r["centres"]))
            elif r["grams"]:
                cells.append(r["grams"])
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "links"])


def _joined(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid, n_shingles, comp_rid, n_links, class_rid) of each row, and whether rid is the id."""
    spark = docs.sparkSession
    source, unique = keyed(docs, id_col, text_col)

    @tk.trimmed
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (rid, n, set id) per text; with null rid the times and hash of a gram frequent here."""
        held: list[np.ndarray] = []
        sets: set[int] = set()

        def frequent() -> pa.RecordBatch:
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            held.clear()
            return pa.record_batch([pa.nulls(int(often.sum()), pa.int64()), pa.array(times[often]), pa.array(tk.signed(gram[often]))], names=["rid", "n", "sid"])

        for batch in batches:
            for rids, off, h in _sets(batch, n):
                ids = _set_ids(off, h)
                new = np.array([not (i in sets or sets.add(i)) for i in ids.tolist()], bool)
                held.append(h[np.repeat(new, np.diff(off))])
                yield pa.record_batch([pa.array(rids), pa.array(np.diff(off).astype(np.int64)), pa.array(ids)], names=["rid", "n", "sid"])
                if sum(map(len, held)) >= STRETCH:
                    yield frequent()
        if held:
            yield frequent()

    surveyed = cut(source.mapInArrow(survey, "rid long, n long, sid long"))
    often = surveyed.where("rid is null").groupBy("sid").agg(F.sum("n").alias("times")).where(F.col("times") >= HOT_DF).orderBy(F.desc("times"), "sid").limit(HOT_GRAMS)
    place = often.select(F.shiftrightunsigned("sid", 64 - BITS).cast("int").alias("at")).toArrow().column(0).to_numpy()  # at most HOT_GRAMS
    marks = np.zeros(1 << (BITS - 3), np.uint8)
    np.bitwise_or.at(marks, place >> 3, (128 >> (place & 7)).astype(np.uint8))
    table = spark.sparkContext.broadcast(marks)
    texts = surveyed.where("rid is not null")
    classes = cut(texts.where("n > 0").groupBy("sid", "n").agg(F.min("rid").alias("rid")))

    @tk.trimmed
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, set id, size) of the prefix of each text; a set seen before in this task is passed over."""
        marks = table.value
        sets: set[int] = set()
        for batch in batches:
            for _, off, h in _sets(batch, n):
                size = np.diff(off)
                ids = _set_ids(off, h)
                new = np.array([s > 0 and not (i in sets or sets.add(i)) for i, s in zip(ids.tolist(), size.tolist(), strict=True)], bool)
                d = np.repeat(np.arange(len(size)), size)
                bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
                late = marks[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1
                order = np.lexsort((h, late, d))
                rank = np.arange(len(h)) - np.repeat(off[:-1], size)
                keep = (rank < _prefix_length(size, percent)[d]) & new[d]
                yield pa.record_batch([pa.array(tk.signed(h[order][keep])), pa.array(ids[d[keep]]), pa.array(size[d[keep]].astype(np.int32))], names=["gram", "sid", "n"])

    rows = source.mapInArrow(prefixes, "gram long, sid long, n int")
    lists = rows.groupBy("gram").agg(F.min("sid").alias("centre"), F.max("sid").alias("other"), F.count("*").alias("rows"))
    lists = cut(lists.where("centre < other").drop("other"))
    release(spark)
    pairs_met = met = cut(rows.join(lists.hint("merge"), "gram"))  # the same plan at every size
    release(spark)
    large = met.where(F.col("rows") > SMALL).where("sid <> centre").select("sid", "centre").distinct()
    # Sets that meet under rare grams only share all of these in their prefixes, so fewer than linked sets must share rule them out.
    few = met.where(F.col("rows") <= SMALL).select("gram", "sid", "n", "centre")
    other = few.select("gram", F.col("sid").alias("sid2"), F.col("n").alias("n2"))
    size_fits = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    pairs = few.join(other, "gram").where("sid < sid2").where(size_fits).groupBy("sid", "sid2", "n", "n2").agg(F.countDistinct("gram").alias("k"), F.min("centre").alias("centre"))
    up = lambda num, den: F.expr(f"({num} + {den} - 1) div {den}")
    must = up(f"{percent} * (n + n2)", 100 + percent) + 1 - up(f"{percent} * greatest(n, n2)", 100)
    pairs = cut(pairs.where(F.col("k") >= must).select("sid", "sid2", "centre"))
    # a pair that meets in a group anyway is left to it; any other goes to the smallest centre of its grams, where it meets others like it
    large = cut(large.union(large.select("centre", "centre")).distinct())
    grouped_pairs = pairs.select("sid", "sid2").join(large, "sid").join(large.select(F.col("sid").alias("sid2"), "centre"), ["sid2", "centre"]).select("sid", "sid2").distinct()
    rest = pairs.join(grouped_pairs, ["sid", "sid2"], "left_anti")
    met = large.union(rest.select("sid", "centre")).union(rest.select("sid2", "centre"))
    met = grouped = cut(met.distinct())
    met = met.union(met.select("centre", "centre")).distinct().join(classes.select("sid", "n"), "sid")
    shares = pairs_met.groupBy("sid").agg(F.countDistinct("gram").alias("shared"))
    met = banded = cut(met.join(shares, "sid", "left").na.fill(0, ["shared"]).withColumn("band", _band(F.col("n"))))
    met = cut(_with_partner(met, percent))
    # a centre whose members all belong to one smaller centre adds no pair
    size = met.groupBy("centre").agg(F.count("*").alias("size"))
    also = met.join(met.select("sid", F.col("centre").alias("smaller")), "sid").where("smaller < centre").groupBy("centre", "smaller").agg(F.count("*").alias("size"))
    members = cut(met.join(also.join(size, ["centre", "size"]).select("centre").distinct(), "centre", "left_anti"))
    total = members.groupBy("centre").agg(F.sum("n").alias("grams"), F.count("*").alias("sets"))
    nb = F.ceil(F.col("sets") / BLOCK)
    nf = F.ceil(F.col("grams") * F.least(F.lit(2), nb) / nb / FULL)
    # the blocks of its centres go with each member, so that its text is read once
    placed = members.join(total.select("centre", nb.cast("int").alias("nb"), nf.cast("int").alias("nf")), "centre").groupBy("sid").agg(F.collect_list(F.struct("centre", "nb", "nf")).alias("places")).join(classes, "sid")
    wanted = cut(placed.select("rid", "places", F.col("places.centre").alias("centres")))
    discard(lists, pairs_met, pairs, large, grouped, banded, members)
    del placed, few, other, grouped_pairs, rest
    release(spark)

    once = source if unique else source.dropDuplicates(["rid"])
    sets = once.join(wanted.hint("merge"), "rid").select("rid", "text", "places", "centres").mapInArrow(lambda b: _segments(b, n), _SEGMENT)
    counted = cut(sets.repartition(*_KEY, "frag").sortWithinPartitions(*_KEY, "frag", "side", "rid").mapInArrow(lambda b: _partial(b, percent), _SEGMENT))
    del sets
    release(spark)
    found = cut(counted.repartition(*_KEY).sortWithinPartitions(*_KEY, "frag", "side", "rid").mapInArrow(lambda b: _summed(b, percent), "a long, b long, links long"))
    discard(counted, wanted)
    release(spark)
    degree = found.where("links is not null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("n_links"))
    label = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rid")
    named = classes.join(label, "rid", "left").join(degree, "rid", "left")
    by_class = named.select("sid", "n", F.col("rid").alias("class_rid"), F.coalesce("component", "rid").alias("comp_rid"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = texts if unique else texts.dropDuplicates(["rid"])
    own = F.col("rid")
    return rows.join(by_class, ["sid", "n"], "left").select(
        "rid", F.col("n").alias("n_shingles"), F.coalesce("comp_rid", own).alias("comp_rid"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_rid", own).alias("class_rid")
    ), unique


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), n_links, class_id.

    Texts are linked when 100 * |A & B| >= percent * |A | B| over their sets of distinct n-word grams (a text of
    fewer words is one gram). Texts with equal sets form a class, named by its smallest id; n_links counts
    the other classes that a class is linked with. A null or empty text, or one without words, has 0
    grams and is linked with nothing. Repeated rows and ids: rows get what their class gets; where ids repeat or
    are null, component_id is the smallest id of the component and null only if all its ids are.
    An empty table gives no rows. Other columns are ignored.
    """
    per, unique = _joined(docs, n, percent, id_col, text_col)
    if unique:  # the key is the id, so the smallest key is the smallest id
        return per.select(F.col("rid").alias(id_col), "n_shingles", F.col("comp_rid").alias("component_id"), "n_links", F.col("class_rid").alias("class_id"))
    rows = docs.select(F.col(id_col), key_of(False, id_col, text_col)).join(per, "rid")
    comp = rows.groupBy("comp_rid").agg(F.min(id_col).alias("component_id"))
    klass = rows.groupBy("class_rid").agg(F.min(id_col).alias("class_id"))
    return rows.join(comp, "comp_rid").join(klass, "class_rid").select(id_col, "n_shingles", "component_id", "n_links", "class_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those linked, however remotely, with a smaller id.

    Texts without words stay. Where ids repeat or are null, the order is that of a digest of id and text; full repeats of
    the row that stays stay with it.
    """
    per, unique = _joined(docs, n, percent, id_col, text_col)
    gone = per.where("rid <> comp_rid").select(F.col("rid").alias("__rid"))
    return docs.withColumn("__rid", key_of(unique, id_col, text_col)).join(gone, "__rid", "left_anti").drop("__rid").select(*docs.columns)
