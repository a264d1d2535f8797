"""Filter interaction audit: what each filter of a chain removes in every order of the filters, from masks of the filters a text fails.

Duplicates come from a sort: rows are put in order by text fingerprint, full text and id, and each is compared with its predecessor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hostrules import WORD, let

#: What a text fails, over the columns text and w (n words, d distinct words); E, the duplicates, is found by the sort.
FILTERS: dict[str, str] = {
    "A": "w.n < 50",
    "B": "100 * w.d < 65 * w.n",
    "C": "100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text)",
    "D": "length(translate(text, '#$%&*|', '')) < length(text)",
}
DUPLICATE = "E"
ROW, PENDING, LAST = 0, 1, 2


def _words(text: Column) -> Column:
    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))


def _equal_to_before(table: pa.Table) -> np.ndarray:
    """Whether each row but the first has the fingerprint and text of the row before."""
    same = np.diff(table.column("fp").to_numpy()) == 0
    at = np.flatnonzero(same) + 1
    if len(at):
        text = table.column("text")
        same[at - 1] = pc.equal(text.take(pa.array(at)), text.take(pa.array(at - 1))).to_numpy(zero_copy_only=False)
    return same


def _compare(batches: Iterator[pa.RecordBatch], bit: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, part, mask, fp, text) of one partition with ``bit`` where a smaller id has the same text.

    The first row of the run of equal texts that has an id is carried from batch to batch. Whether the least ids of the partition's first
    fingerprint are duplicates depends on earlier partitions: they leave as PENDING. Texts of the last fingerprint leave once more, as LAST.
    """
    pid, first, carry, tails = TaskContext.get().partitionId(), None, None, []

    def made(kind: int, t: pa.Table, mask: np.ndarray, texts: bool) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        blank = pa.nulls(n, pa.string())
        columns = [pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, pid, np.int32)), t.column("id"), t.column("part"), pa.array(mask.astype(np.int32)), t.column("fp"), t.column("text") if texts else blank]
        yield from pa.table(columns, names=["kind", "pid", "id", "part", "mask", "fp", "text"]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        skip = 0 if carry is None else 1
        if skip:
            t = pa.concat_tables([carry, t])
        start = np.concatenate([[True], ~_equal_to_before(t)])
        at, valid = np.arange(len(start)), t.column("id").is_valid().to_numpy()
        runs = np.flatnonzero(start)
        least = np.minimum.reduceat(np.where(valid, at, len(at)), runs)  # of each run, the place of its first id
        run = np.cumsum(start) - 1
        known = least[run] < len(at)
        own = pc.fill_null(pc.equal(t.column("id"), t.column("id").take(pa.array(np.where(known, least[run], 0)))), False).to_numpy()
        duplicate = valid & known & ~own
        fp = t.column("fp").to_numpy()
        first = fp[0] if first is None else first
        mask = t.column("mask").to_numpy() | np.where(duplicate, bit, 0)
        wait = (fp == first) & valid & own
        wait[:skip] = False
        done = ~wait
        done[:skip] = False
        yield from made(ROW, t.filter(pa.array(done)), mask[done], False)
        if wait.any():
            yield from made(PENDING, t.filter(pa.array(wait)), mask[wait], True)
        ends = [int(x) for x in least[fp[runs] == fp[-1]] if x < len(at)]
        tails = [] if tails and tails[0].column("fp")[0].as_py() != fp[-1] else tails
        tails += [t.slice(x, 1) for x in ends if x >= skip]  # a carried row with an id is among them already
        carry = t.slice(int(least[-1]) if least[-1] < len(at) else len(at) - 1, 1)
    if tails:
        t = pa.concat_tables(tails)
        yield from made(LAST, t, np.zeros(t.num_rows, np.int32), True)


def failures(docs: DataFrame, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", fingerprint: str = "xxhash64(text)") -> DataFrame:
    """(id, part, mask) of every document: bit i for the i-th of ``filters``, the next bit for a text that a smaller id has as well.

    Ranges are cut by fingerprint and id, so that a group of copies spreads over tasks, and full texts are compared within them:
    texts of equal fingerprints never count as equal unread. Repeated rows of the least id are no duplicates of one another; a null id is
    neither a duplicate nor makes one. A null text is empty, a null part the empty string.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", F.expr(fingerprint))
    placed = rows.repartitionByRange(parts, F.col("fp"), F.col("id").asc_nulls_first()).sortWithinPartitions("fp", "text", F.col("id").asc_nulls_first())
    bits = [F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    masked = placed.withColumn("w", _words(F.col("text"))).select("id", "part", sum(bits, F.lit(0)).cast("int").alias("mask"), "fp", "text")
    bit = 1 << len(filters)
    kind = rows.schema["id"].dataType.simpleString()
    compared = cut(masked.mapInArrow(lambda it: _compare(it, bit), f"kind byte, pid int, id {kind}, part string, mask int, fp long, text string"))
    before = compared.where(F.col("kind") == LAST).groupBy("fp", "text").agg(F.min("pid").alias("seen"))
    late = compared.where(F.col("kind") == PENDING).join(before, ["fp", "text"], "left")
    late = late.select("id", "part", F.when(F.col("seen") < F.col("pid"), F.col("mask").bitwiseOR(bit)).otherwise(F.col("mask")).alias("mask"))
    return compared.where(F.col("kind") == ROW).select("id", "part", "mask").union(late)


def counters(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and toxic ones; sums of any rows' counters are those of all."""
    mark = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0).cast("long"))).alias(c)
    return failed.join(mark, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters ``letters`` (bit i of a mask is the i-th letter) and every step of it, for each part."""
    k = len(letters)
    orders = ["".join(x) for x in permutations(letters)]
    earlier = [sum(1 << letters.index(c) for c in o[:s]) for o in orders for s in range(k)]
    table = lambda values: F.array(*[F.lit(v) for v in values])
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 2^k masks at most
    steps = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumn("filter_order", table(orders)[F.col("o")]).withColumn("before", table(earlier)[F.col("o") * k + F.col("step") - 1])
    steps = steps.withColumn("own", table([1 << i for i in range(k)])[F.instr(F.lit(letters), F.expr("substring(filter_order, step, 1)")) - 1])
    before, own, zero = F.col("before"), F.col("own"), F.lit(0).cast("long")
    has = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    count = lambda name, when, what=lambda x: x["n"]: F.aggregate("m", zero, lambda t, x: t + F.when(when(x), what(x)).otherwise(zero)).alias(name)
    removed = lambda x: has(x, own) & ~has(x, before)
    share = lambda x: x["n"] * (F.lit(factorial(k)) / F.bit_count(x["mask"])).cast("long")  # of the orders, those in which this filter is the first of all that fail
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        count("kept", lambda x: ~has(x, before.bitwiseOR(own))), count("removed", removed), count("redundant", lambda x: has(x, own) & has(x, before)),
        count("unique_fails", lambda x: x["mask"] == own), count("good_lost", removed, lambda x: x["good"]), count("toxic_lost", removed, lambda x: x["toxic"]),
        count("shapley", lambda x: has(x, own), share),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, duplicate: str = DUPLICATE, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` sums what the filter removes over all orders. Rows of part, order and step are there even where all counts are zero.
    Several labels of one id count as one that has each mark of any. Nulls as in ``failures``; an empty table has no parts and
    gives no rows; further columns are ignored.
    """
    found = failures(docs, filters, id_col, text_col, part_col)
    return interactions(counters(found, labels, id_col), "".join(filters) + duplicate)
