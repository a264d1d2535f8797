"""Farthest points of windows of a stream."""

import random

from pyspark.sql import functions as F

from cloudloom.operators.sampling import furthest_point_sample
from cloudloom.streaming.samples import windowed_samples

SCHEMA = "ts string, batch long, idx long, pos array<float>"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    point = lambda: [rng.random() * 8 for _ in range(3)]
    first = [(f"2024-01-01 00:0{rng.randrange(10)}:30", i % 2, i, point()) for i in range(40)]
    second = [(f"2024-01-01 00:{rng.randrange(5, 20):02d}:30", i % 2, i, point()) for i in range(40, 80)]  # part of them in the first window
    odd = [("2024-01-01 00:03:00", 0, 900, [float("nan"), 0.0, 0.0]), ("2024-01-01 00:03:00", None, 901, [0.0, 0.0, 0.0]), ("2024-01-01 00:03:00", 0, None, [0.0, 0.0, 0.0]), ("2024-01-01 00:03:00", 0, 902, None)]
    ahead = [("2024-01-01 03:00:00", 0, 100, [0.0, 0.0, 0.0])]
    late = [("2024-01-01 00:01:00", 0, 101, [99.0, 99.0, 99.0])]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frame(first + odd).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame(first).schema).parquet(f"{tmp_path}/in")
        q = windowed_samples(stream, 5).writeStream.format("memory").queryName("samples").outputMode("append").start()
        for rows in (None, second, ahead, late):
            if rows:
                frame(rows).write.mode("append").parquet(f"{tmp_path}/in")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.table("samples").collect())
    static = windowed_samples(frame(first + second + odd), 5)
    assert got == sorted(tuple(r) for r in static.collect()) and len(got) == 2 * 2 * 5
    # the first window beside the sample of the same points as clouds
    cloud = frame(first + second).where("ts < '2024-01-01 00:10:00'").select("batch", "idx", "pos")
    want = sorted((r["batch"], r["slot"], r["idx"]) for r in furthest_point_sample(cloud, 5).collect())
    assert [tuple(r[1:]) for r in got if r[0].minute == 10] == want
