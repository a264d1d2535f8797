"""Sources, sinks, SQL surface, streaming, and the driver contract."""

import struct

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from cloudloom import ingest
from cloudloom.plans.register import register
from cloudloom.sources import files, sinks
from cloudloom.streaming.voxels import windowed_voxels


def test_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# points\n0 0 0\n2 0 0\n0 0 0\n")
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nend_header\n1 2 3\n3 2 1\n")
    tri = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4")
    (tmp_path / "c.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 1) + np.zeros(3, "<f4").tobytes() + tri.tobytes() + b"\0\0")
    (tmp_path / "d.stl").write_text("solid\nvertex 5 5 5\nvertex 6 5 5\nendsolid\n")
    got = files.read_clouds(spark, str(tmp_path))
    assert got.count() == 10
    mid = files.centred(got).where("path like '%a.xyz'").orderBy("idx").collect()
    assert [r["pos"] for r in mid] == [[-1, 0, 0], [1, 0, 0]]


def test_sinks_and_sql(spark):
    pts = ingest.points(spark, [(0, i, [float(x), 0.0, 0.0]) for i, x in enumerate((0, 2, 5))])
    one = sinks.KNN(2)(pts, pts).orderBy("q").collect()
    assert [r["idx"] for r in one] == [[0, 1], [1, 0], [2, 1]]
    f = pts.withColumn("feat", F.array(F.col("idx").cast("float"), F.lit(1.0).cast("float")))
    assert [r["values"] for r in sinks.channel_first(f, 2).orderBy("c").collect()] == [[0, 1, 2], [1, 1, 1]]
    register(spark, points=pts)
    rows = spark.sql("SELECT * FROM farthest_points(TABLE(SELECT idx, pos FROM points) WITH SINGLE PARTITION, 2) ORDER BY slot").collect()
    assert [r["idx"] for r in rows] == [0, 2]
    assert spark.sql("SELECT d2(array(cast(1 as float)), array(cast(3 as float))) d, l1(array(cast(1 as float)), array(cast(3 as float))) l").first() == (4.0, 2.0)


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 0, [0.5, 0.5, 0.5]), ("2024-01-01 00:02:00", 0, [0.75, 0.5, 0.5]), ("2024-01-01 00:12:00", 0, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "ts string, batch long, pos array<float>").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windowed_voxels(stream, 1.0).writeStream.format("memory").queryName("vox").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r["count"] for r in spark.sql("SELECT * FROM vox ORDER BY window").collect()] == [2, 1]
    assert windowed_voxels(df, 1.0).count() == 2


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    assert __spark_entry__.entry(spark).count() > 0
