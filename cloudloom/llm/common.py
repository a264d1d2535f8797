"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import cut, discard, fixed, global_order, release, shared_dir

__all__ = ["components", "cut", "discard", "fixed", "global_order", "groups", "keyed", "release", "rid", "shared_dir", "whole"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid, text), and whether rid is the id: one long key per document, the id itself where ids are integers, unique and not null.

    Otherwise a digest of id and text, so fully repeated rows count as one document.
    """
    unique = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") and docs.groupBy(id_col).count().where(F.col("count").__gt__(1) | F.col(id_col).isNull()).limit(1).count() == 0
    return docs.select(rid(unique, id_col, text_col), F.col(text_col).alias("text")), unique


def rid(unique: bool, id_col: str, text_col: str) -> Column:
    return (F.col(id_col).cast("long") if unique else F.xxhash64(F.col(id_col), F.col(text_col))).alias("rid")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the undirected edges (a, b); nodes without edges are left out.

    Rounds of minimum labels over neighbours followed by pointer jumping; each round is written to the shared
    folder, and only a count of changed labels comes to the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))


def groups(batches, keys: list[str]):
    """Record batches of each run of equal keys in a stream sorted by them; holds one group and one batch."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        turn = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            turn[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            piece = batch.slice(lo, hi - lo)
            if held and (lo or any(held[-1].column(k)[0] != piece.column(k)[0] for k in keys)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole(batches, key: str):
    """Tables of whole runs of equal keys in a stream sorted by that integer column: about a batch each, or one run that is longer."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(key)
        v = batch.column(k).to_numpy()
        at = int(np.searchsorted(v, v[-1]))  # the last run may go on
        if held and (at or held[-1].column(k)[0].as_py() != v[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held = [batch.slice(at)]
        elif at:
            yield pa.Table.from_batches([batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
