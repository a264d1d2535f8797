"""Point files as a Spark data source: ``spark.read.format("points").load(path)``.

XYZ text is cut in byte ranges, binary PLY and STL in ranges of records, so that a large file is read by many tasks; text forms of PLY and STL are
read by one task each, a line at a time.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20  # bytes of a range
ROWS = 65_536  # of a batch
SUFFIXES = (".xyz", ".ply", ".stl")
# names of scalar types in PLY headers, fixed by the format
SCALARS = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


@dataclass
class Range(InputPartition):
    """Bytes from lo to hi of a file; ``form`` is xyz, ply, stl (text) or records."""

    path: str
    lo: int
    hi: int
    form: str
    count: int = 0  # of vertices in a text PLY
    record: tuple = ()  # (name, type, length) of the fields of a record


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(where.open_input_file(name), 1 << 20)


def _header(path: str) -> tuple[list[str], int]:
    """Lines of a PLY header and the place of its first byte of data."""
    with _open(path) as f:
        head = b""
        while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
            more = f.read(4096)
            if not more:
                raise ValueError(f"{path}: no end of header")
            head += more
    end = head.index(b"\n", head.index(b"end_header")) + 1
    return [line.strip() for line in head[:end].decode("ascii", "replace").splitlines()], end


def _ply(path: str, size: int, split: int) -> Iterator[Range]:
    lines, start = _header(path)
    order = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}[next(line.split()[1] for line in lines if line.startswith("format "))]
    elements = [(line.split()[1], int(line.split()[2]), [p.split() for p in lines[i + 1 :]]) for i, line in enumerate(lines) if line.startswith("element ")]
    name, count, after = elements[0]
    if name != "vertex":
        raise ValueError(f"{path}: vertices must come first")
    fields = []
    for words in after:
        if words[:1] == ["element"]:
            break
        if words[:1] == ["property"]:
            if words[1] == "list":
                raise ValueError(f"{path}: lists in vertices are not supported")
            fields.append((words[2], order + SCALARS[words[1]], 1))
    if not {"x", "y", "z"} <= {f[0] for f in fields}:
        raise ValueError(f"{path}: vertices need x, y and z")
    if order:
        yield from _records(path, start, count, tuple(fields), split)
    else:
        yield Range(path, start, size, "ply", count, tuple(fields))


def _records(path: str, start: int, count: int, fields: tuple, split: int) -> Iterator[Range]:
    width = np.dtype([(n, t, k) if k > 1 else (n, t) for n, t, k in fields]).itemsize
    step = max(split // width, 1)
    for at in range(0, count, step):
        yield Range(path, start + at * width, start + min(at + step, count) * width, "records", 0, fields)


def _stl(path: str, size: int, split: int) -> Iterator[Range]:
    with _open(path) as f:
        head = f.read(84)
    faces = struct.unpack_from("<I", head, 80)[0] if len(head) == 84 else -1
    if size == 84 + 50 * faces:
        yield from _records(path, 84, faces, (("normal", "<f4", 3), ("v", "<f4", 9), ("attribute", "<u2", 1)), split)
    else:
        yield Range(path, 0, size, "stl")


def _lines(part: Range) -> Iterator[tuple[int, list[str]]]:
    """(place, words) of the lines that begin in a range."""
    with _open(part.path) as f:
        at = part.lo
        if at:  # the line that began earlier is the range's before
            f.seek(at - 1)
            at = at - 1 + len(f.readline())
        f.seek(at)
        while at < part.hi:
            line = f.readline()
            if not line:
                return
            yield at, line.decode("utf-8", "replace").split()
            at += len(line)


class PointsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        if not self.path:
            raise ValueError("a path is needed")
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def partitions(self) -> list[Range]:
        uri = self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}"
        where, name = fs.FileSystem.from_uri(uri)
        info = where.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File]
        prefix = uri[: len(uri) - len(name)] if uri.endswith(name) else ""
        out: list[Range] = []
        for f in sorted(files, key=lambda f: f.path):
            path, kind = prefix + f.path, f.path.lower()
            if not kind.endswith(SUFFIXES) or not f.size:
                continue
            if kind.endswith(".ply"):
                out += _ply(path, f.size, self.split)
            elif kind.endswith(".stl"):
                out += _stl(path, f.size, self.split)
            else:
                out += [Range(path, lo, min(lo + self.split, f.size), "xyz") for lo in range(0, f.size, self.split)]
        return out or [Range("", 0, 0, "none")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.form == "none":
            return
        if part.form == "records":
            yield from self._binary(part)
            return
        at, rows = [], []
        for place, xyz in self._text(part):
            at.append(place)
            rows.append(xyz)
            if len(at) == ROWS:
                yield _batch(part.path, np.array(at), np.array(rows, np.float32))
                at, rows = [], []
        if at:
            yield _batch(part.path, np.array(at), np.array(rows, np.float32))

    @staticmethod
    def _text(part: Range) -> Iterator[tuple[int, list[str]]]:
        if part.form == "stl":
            yield from ((at, w[1:4]) for at, w in _lines(part) if w[:1] == ["vertex"])
        elif part.form == "xyz":
            yield from ((at, w[:3]) for at, w in _lines(part) if w and not w[0].startswith("#"))
        else:
            names = [f[0] for f in part.record]
            axes = [names.index(c) for c in "xyz"]
            left = part.count
            for at, w in _lines(part):
                if not left:
                    return
                if w:
                    left -= 1
                    yield at, [w[i] for i in axes]

    @staticmethod
    def _binary(part: Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([(n, t, k) if k > 1 else (n, t) for n, t, k in part.record])
        with _open(part.path) as f:
            f.seek(part.lo)
            at = part.lo
            while at < part.hi:
                data = f.read(min(ROWS * kind.itemsize, part.hi - at))
                if len(data) % kind.itemsize or not data:
                    raise ValueError(f"{part.path}: ends within a record")
                got = np.frombuffer(data, kind)
                places = at + np.arange(len(got)) * kind.itemsize
                if "v" in kind.names:  # three corners a face
                    corner = kind.fields["v"][1] + 12 * np.arange(3)
                    yield _batch(part.path, (places[:, None] + corner).ravel(), got["v"].reshape(-1, 3))
                else:
                    yield _batch(part.path, places, np.stack([got[c].astype(np.float32) for c in "xyz"], axis=1))
                at += len(data)


def _batch(path: str, at: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(pos, np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(pos) + 1, 3, dtype=np.int32)), flat)
    return pa.record_batch([pa.array([path] * len(pos), pa.string()), pa.array(at.astype(np.int64)), lists], names=["path", "row", "pos"])


class PointsSource(DataSource):
    """(path, row, pos) of XYZ, PLY and STL files of a file or folder (with its subfolders; others are passed over).

    ``row`` is the place in bytes of a point in its file: it increases in file order and is known without reading what comes before. Lines of XYZ
    that begin with # and empty ones are no points. Option splitBytes: bytes of a range.
    """

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return "path string, row long, pos array<float>"

    def reader(self, schema) -> PointsReader:
        return PointsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PointsSource)
