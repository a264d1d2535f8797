"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_order
from .textkit import mix

ROUNDS = 6


class Feistel:
    """Bijection of 0..n-1: alternating Feistel rounds on Z_a x Z_b with a*b >= n, walked until back below n.

    a*b exceeds n by less than a, so a walk rarely takes a second step. The inverse runs the rounds
    backwards, which makes the row of any (shard, slot) computable.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n, self.seed = n, seed
        self.a = max(1, int(np.ceil(np.sqrt(n))))
        self.b = max(1, -(-n // self.a))

    def _f(self, k: int, x: np.ndarray, modulus: int) -> np.ndarray:
        key = (self.seed * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) % (1 << 64)
        with np.errstate(over="ignore"):
            return (mix(x.astype(np.uint64) + np.uint64(key)) % np.uint64(modulus)).astype(np.int64)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self._f(k, left, self.b)) % self.b
            else:
                left = (left + sign * self._f(k, right, self.a)) % self.a
        return left * self.b + right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.int64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, True)


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law ``rows``, shard, slot, grown_shard (null) and row_number.

    Global row numbers follow (id, text size, text CRC, text digest); the permuted number p gives shard p mod n_shards
    and slot p div n_shards, so shard counts differ by one at most and slots have no gaps. A null text
    has size 1 and the CRC of the empty text; null ids sort first. Repeated rows get a place each; as they
    are equal it does not matter which. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__digest"))
    numbered, n = global_order(rows, [F.col(id_col), F.col("size"), F.col("text_crc32"), F.col("__digest")])
    feistel = Feistel(n, seed)

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(feistel.forward(x.to_numpy()))

    return numbered.withColumn("__place", permuted("row_number")).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"cast(__place % {n_shards} as int)").alias("shard"), F.expr(f"__place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
