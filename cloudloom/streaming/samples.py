"""Farthest-point samples of the windows of a stream of points: state by window, sampled and dropped by an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import metric as m
from ..operators.sampling import farthest

SCHEMA = "window_end timestamp, batch long, slot int, idx long"


def _sampled(end: int, batch: int, idx: np.ndarray, pos: np.ndarray, npoint: int) -> pd.DataFrame:
    """The sample of the points of a window, each index once (its first row by coordinates), in order of index."""
    order = np.lexsort((pos[:, 2], pos[:, 1], pos[:, 0], idx))
    idx, pos = idx[order], pos[order]
    new = np.ones(len(idx), bool)
    new[1:] = idx[1:] != idx[:-1]
    idx, pos = idx[new], pos[new]
    at = farthest(pos, npoint)
    return pd.DataFrame({"window_end": pd.Timestamp(end, unit="ms"), "batch": batch, "slot": np.arange(len(at), dtype=np.int32), "idx": idx[at]})


class Sampler(StatefulProcessor):
    """Keeps the points of a (window, batch) until the watermark passes the end of the window."""

    def __init__(self, npoint: int):
        self.npoint = npoint

    def init(self, handle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "idx long, x float, y float, z float")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[0])
        if end <= timerValues.getCurrentWatermarkInMs():  # the window is over
            return iter(())
        if not self.points.exists():
            self.handle.registerTimer(end)
        for part in rows:
            values = zip(part["idx"].tolist(), part["x"].tolist(), part["y"].tolist(), part["z"].tolist(), strict=True)
            self.points.appendList(list(values))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.points.get())
        self.points.clear()
        if held:
            idx, pos = np.array([p[0] for p in held], np.int64), np.array([p[1:] for p in held], np.float32)
            yield _sampled(int(key[0]), int(key[1]), idx, pos, self.npoint)

    def close(self) -> None:
        pass


def windowed_samples(stream: DataFrame, npoint: int, time_col: str = "ts", window: str = "10 minutes", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """(window_end, batch, slot, idx): npoint farthest points of each window and batch of points (batch, idx, pos, time).

    The first of a window is its smallest index; a window with fewer points repeats some, as ``furthest_point_sample`` does. Points that are
    not finite and rows with a null batch, index, place or time take no part. On a stream (RocksDB state store) a window is given out once, when the watermark passes its end,
    and its state is dropped; rows later than that are left out. Works on static tables too, with the same rows. State and memory of a task are the points of one window and batch.
    """
    m.check_count(npoint, "npoint")
    timed = stream.withWatermark(time_col, watermark) if stream.isStreaming else stream
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    fine = m.all_finite(F.slice("pos", 1, 3)) & (F.size("pos") >= 3) & F.col("batch").isNotNull() & F.col("idx").isNotNull() & F.col(time_col).isNotNull()
    axes = [F.col("pos")[i].cast("float").alias(c) for i, c in enumerate("xyz")]
    groups = timed.where(fine).select(F.unix_millis(span["end"]).alias("end"), F.col("batch").cast("long").alias("batch"), F.col("idx").cast("long").alias("idx"), *axes).groupBy("end", "batch")
    if stream.isStreaming:
        return groups.transformWithStateInPandas(Sampler(npoint), SCHEMA, "Append", "EventTime")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _sampled(int(key[0]), int(key[1]), pdf["idx"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(np.float32), npoint)

    return groups.applyInPandas(one, SCHEMA)
