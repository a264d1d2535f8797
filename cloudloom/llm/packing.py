"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_order

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass
class Plan:
    """Runs of equal items in rank order, and fill and capacity of runs of equal bins.

    runs: first rank, length, first bin, items per bin, offset of the first item in each bin.
    bins: first bin, fill, capacity; sorted by first bin.
    """

    runs: np.ndarray
    bins: np.ndarray
    n_bins: int
    cost: float


def _best_fit(hist: Sequence[tuple[int, int]], sizes: Sequence[int], price: dict[int, float], permitted: Sequence[int]) -> Plan:
    """Best-fit decreasing over a length histogram; whole runs of equal bins are filled at once.

    A length goes to the open bins with the least room that still fits it. If none does, bins of
    the size with the least price per item of that length open. At the end each bin takes the
    smallest permitted capacity that holds its contents. The work depends on the number of lengths
    and bin states, not on the number of items.
    """
    room: dict[int, deque] = {}
    order: list[int] = []
    runs, rank, opened = [], 0, 0

    def put(left: int, lo: int, hi: int, fill: int) -> None:
        if hi > lo:
            if left not in room:
                room[left] = deque()
                insort(order, left)
            room[left].append((lo, hi, fill))

    for length, count in sorted(hist, reverse=True):
        usable = [s for s in sizes if s >= length] or [min(s for s in permitted if s >= length)]
        size = min(usable, key=lambda s: (price[s] / (s // length), s))
        while count:
            at = bisect_left(order, length)
            if at < len(order):
                left = order[at]
                lo, hi, fill = room[left].popleft()
                if not room[left]:
                    del room[left]
                    order.pop(at)
            else:
                left, fill, lo = size, 0, opened
                opened += -(-count // (size // length))
                hi = opened
            each = left // length
            full = min(hi - lo, count // each)
            if full:
                runs.append((rank, length, lo, each, fill))
                rank, count = rank + full * each, count - full * each
                put(left - each * length, lo, lo + full, fill + each * length)
                lo += full
            if lo < hi and count and count < each:
                runs.append((rank, length, lo, count, fill))
                put(left - count * length, lo, lo + 1, fill + count * length)
                rank, count, lo = rank + count, 0, lo + 1
            put(left, lo, hi, fill)
    final = sorted((lo, fill, min(s for s in permitted if s >= fill), hi - lo) for parts in room.values() for lo, hi, fill in parts)
    cost = sum(price[cap] * n for _, _, cap, n in final)
    return Plan(np.array(runs, np.int64).reshape(-1, 5), np.array([x[:3] for x in final], np.int64).reshape(-1, 3), opened, cost)


def plan_bins(hist: Sequence[tuple[int, int]], capacities: Sequence[int], bin_cost: float = 0.0) -> Plan:
    """The cheapest of the best-fit packings that open bins of each set of the permitted sizes.

    A bin costs its final capacity plus ``bin_cost``. All sets are tried at any number of sizes, so the plans double with each size.
    """
    caps = sorted(set(capacities))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    price = {c: c + bin_cost for c in caps}
    opened = [c for k in range(len(caps), 0, -1) for c in combinations(caps, k)]
    return min((_best_fit(hist, sizes, price, caps) for sizes in opened), key=lambda p: p.cost)


def pack(docs: DataFrame, capacities: Sequence[int] = (512, 1024, 2048, 4096), length: Column | None = None, bin_cost: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, n_tokens, bin_id, capacity, offset (of the piece in its bin).

    ``length`` is a count of tokens (default: words). A text longer than the largest capacity is cut into
    pieces of that capacity and a rest, so nothing is lost. A null or empty text is one piece of 0 tokens
    without a bin. Equal lengths are placed by id; repeated rows take a place each. An empty table gives
    no rows. Only the histogram of piece lengths, at most the largest capacity in size, reaches the driver.
    """
    spark, top = docs.sparkSession, max(capacities)
    tokens = F.coalesce(length if length is not None else F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col), tokens.alias("__n"))
    pieces = sized.select(
        id_col, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("__n") / top) - 1, F.lit(0)))).alias("piece")
    ).select(id_col, "piece", F.least(F.lit(top), F.col("__n") - F.col("piece") * top).alias("n_tokens"))
    ranked, _ = global_order(pieces, [F.col("n_tokens").desc(), F.col(id_col), F.col("piece")], "__rank")
    hist = [(r[0], r[1]) for r in ranked.where("n_tokens > 0").groupBy("n_tokens").count().collect()]
    plan = plan_bins(hist, capacities, bin_cost)
    runs, bins = plan.runs, plan.bins

    @F.pandas_udf("bin_id long, capacity int, offset int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rank in batches:
            g = rank.to_numpy()
            r = runs[np.searchsorted(runs[:, 0], g, side="right") - 1]
            at = g - r[:, 0]
            bin_id = r[:, 2] + at // r[:, 3]
            cap = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 2]
            yield pd.DataFrame({"bin_id": bin_id, "capacity": cap.astype("int32"), "offset": (r[:, 4] + at % r[:, 3] * r[:, 1]).astype("int32")})

    filled = ranked.where("n_tokens > 0").withColumn("__p", place("__rank")).select(id_col, "piece", "n_tokens", "__p.*")
    none = ranked.where("n_tokens = 0").select(id_col, "piece", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("offset"))
    return filled.unionByName(none)
