"""Point and mesh files: XYZ, ASCII PLY and STL, one cloud per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def parse(path: str, content: bytes) -> np.ndarray:
    """Vertices of a file in file order, as float32 rows."""
    name = path.lower()
    if name.endswith(".stl"):
        if len(content) >= 84 and len(content) == 84 + 50 * struct.unpack_from("<I", content, 80)[0]:
            faces = np.frombuffer(content, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
            return faces["v"].reshape(-1, 3)
        rows = [line.split()[1:4] for line in content.decode().splitlines() if line.strip().startswith("vertex")]
    else:
        lines = content.decode().splitlines()
        if name.endswith(".ply"):
            end = next(i for i, line in enumerate(lines) if line.strip() == "end_header")
            count = next(int(line.split()[2]) for line in lines[:end] if line.startswith("element vertex"))
            lines = lines[end + 1 : end + 1 + count]
        rows = [line.split()[:3] for line in lines if line.strip() and not line.startswith("#")]
    return np.array(rows, np.float32).reshape(-1, 3)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, pos) of all files under a path or pattern; files are read by executors through Spark."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                xyz = parse(p, content)
                yield pd.DataFrame({"path": p, "row": np.arange(len(xyz)), "pos": list(xyz)})

    return files.mapInPandas(rows, "path string, row long, pos array<float>")


def centred(clouds: DataFrame) -> DataFrame:
    """(path, idx, pos): distinct vertices in order of first appearance, moved so that each cloud's mean is the origin."""
    first = clouds.groupBy("path", "pos").agg(F.min("row").alias("row"))
    mean = first.groupBy("path").agg(*[F.avg(F.col("pos")[i]).alias(f"m{i}") for i in range(3)])
    idx = F.row_number().over(Window.partitionBy("path").orderBy("row")) - 1
    moved = F.array(*[(F.col("pos")[i] - F.col(f"m{i}")).cast("float") for i in range(3)])
    return first.join(mean, "path").select("path", idx.cast("long").alias("idx"), moved.alias("pos"))
