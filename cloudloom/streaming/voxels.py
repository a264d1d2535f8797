"""Windowed voxel counts and means over a stream of points with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metric as m
from ..operators.voxel import vector


def windowed_voxels(stream: DataFrame, size, dim: int = 3, start=0.0, time_col: str = "ts", window: str = "10 minutes", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """(window, batch, c0.., count, pos) of points (batch, pos, time): tumbling or sliding windows; later rows than the watermark are dropped.

    Works on static tables too. State is one row per open window and occupied voxel.
    """
    size, start = vector(size, dim), vector(start, dim)
    cells = [F.floor(((F.col("pos")[i] - m.flit(start[i])) / m.flit(size[i])).cast("float")).alias(f"c{i}") for i in range(dim)]
    timed = stream.withWatermark(time_col, watermark) if stream.isStreaming else stream
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    mean = F.array(*[F.avg(F.col("pos")[i]).cast("float") for i in range(dim)])
    return timed.select(time_col, "batch", "pos", *cells).groupBy(span.alias("window"), "batch", *[f"c{i}" for i in range(dim)]).agg(F.count("*").alias("count"), mean.alias("pos"))
