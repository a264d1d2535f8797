"""Point files as a data source."""

import random
import struct

import numpy as np
import pytest

from cloudloom.sources import points


def read(spark, path, **options):
    points.register(spark)
    return spark.read.format("points").options(**options).load(str(path))


def test_text_is_cut_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    xyz = [[rng.randrange(1000) / 8 for _ in range(3)] for _ in range(500)]
    lines = [" ".join(map(str, p)) + (" 7" if i % 3 == 0 else "") + ("\r\n" if i % 5 == 0 else "\n") + ("\n# note\n" if i % 7 == 0 else "") for i, p in enumerate(xyz)]
    (tmp_path / "a.xyz").write_text("".join(lines).rstrip("\n"), newline="")
    for split in (1, 37, 1000, 1 << 20):
        df = read(spark, tmp_path, splitBytes=split) if split > 1 else read(spark, tmp_path, splitBytes=13)
        assert [r["pos"] for r in df.orderBy("row").collect()] == xyz
    assert read(spark, tmp_path, splitBytes=1000).rdd.getNumPartitions() > 5


def test_records(spark, tmp_path):
    xyz = np.arange(300, dtype="<f4").reshape(-1, 3)
    for order, name in (("<", "binary_little_endian"), (">", "binary_big_endian")):
        kind = np.dtype([("x", order + "f8"), ("q", "u1"), ("z", order + "f4"), ("y", order + "f4")])
        data = np.zeros(100, kind)
        data["x"], data["y"], data["z"] = xyz.T
        head = f"ply\nformat {name} 1.0\nelement vertex 100\nproperty double x\nproperty uchar q\nproperty float z\nproperty float32 y\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
        (tmp_path / "p.ply").write_bytes(head.encode() + data.tobytes() + b"\3" + struct.pack("<3i", 0, 1, 2))
        df = read(spark, tmp_path / "p.ply", splitBytes=200)
        assert df.rdd.getNumPartitions() > 5 and [r["pos"] for r in df.orderBy("row").collect()] == xyz.tolist()
    faces = np.zeros(20, np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")]))
    faces["v"] = np.arange(180).reshape(20, 9)
    (tmp_path / "s.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 20) + faces.tobytes())
    got = [r["pos"] for r in read(spark, tmp_path / "s.stl", splitBytes=120).orderBy("row").collect()]
    assert got == np.arange(180.0).reshape(-1, 3).tolist()


def test_folders_and_faults(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.PLY").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float y\nproperty float x\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1 2 3\n\n4 5 6\n3 0 1 0\n")
    (tmp_path / "d.stl").write_text("solid\n  vertex 5 5 5\n  vertex 6 5 5\nendsolid\n")
    (tmp_path / "empty.xyz").write_text("")
    (tmp_path / "note.txt").write_text("no points")
    got = sorted(tuple(r["pos"]) for r in read(spark, tmp_path).collect())
    assert got == [(2, 1, 3), (5, 4, 6), (5, 5, 5), (6, 5, 5)]
    assert read(spark, tmp_path / "empty.xyz").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read(spark, tmp_path / "nowhere").count()
    (tmp_path / "bad.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n")
    with pytest.raises(Exception, match="x, y and z"):
        read(spark, tmp_path / "bad.ply").count()
