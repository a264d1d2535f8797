"""Clouds, graphs and sparse sites drawn from the driver's tables; all coordinates are dyadic, hence exact in single precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.order import tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, idx, pos, feat) of all events: user and minute of day and value as coordinates, value and hour as features."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    axes = [(F.col("user_id") % 64) / 8, F.floor(F.hour("ts") * 60 + F.minute("ts")) / 16, F.floor("value") / 8]
    return e.select(
        (F.col("user_id") % 4).alias("batch"), F.col("event_id").alias("idx"), F.array(*[a.cast("double").cast("float") for a in axes]).alias("pos"),
        F.array(F.floor("value").cast("float"), F.hour("ts").cast("float")).alias("feat"),
    )


def cell_cloud(cloud: DataFrame) -> DataFrame:
    """(batch, idx, pos) of the corners of occupied 2 x 8 x 8 cells, numbered within each batch."""
    cell = [F.floor(F.col("pos")[i] / s).alias(f"c{i}") for i, s in enumerate((2, 8, 8))]
    distinct = cloud.select("batch", *cell).distinct()
    idx = F.row_number().over(Window.partitionBy("batch").orderBy("c0", "c1", "c2")) - 1
    pos = F.array(*[(F.col(f"c{i}") * s).cast("float") for i, s in enumerate((2, 8, 8))])
    return distinct.select("batch", idx.cast("long").alias("idx"), pos.alias("pos"))


def embeddings_cloud(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("label") if by_label else F.lit(0)).cast("long").alias("batch"), F.col("vec_id").alias("idx"), F.col("embedding").alias("pos"))


def parts_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, weight): distinct part-supplier pairs of all line items with their number; suppliers follow the parts."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    li = li.repartition(tasks(spark, li.count()), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("float").alias("weight"))
    return li.select((F.col("l_partkey") * 2).alias("row"), (F.col("l_suppkey") * 2 + 1).alias("col"), "weight")


def both_ways(one: DataFrame) -> DataFrame:
    return one.union(one.select("col", "row", "weight"))


def parts_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parts_edges`` in both directions."""
    return both_ways(parts_edges(spark, sf_dir))


def event_sites(cloud: DataFrame) -> DataFrame:
    """(row, b, a0, a1, a2, features): occupied 1 x 4 x 4 cells with count and sum of values; one row per cell."""
    cell = [F.floor(F.col("pos")[i] / s).cast("int").alias(f"a{i}") for i, s in enumerate((1, 4, 4))]
    g = cloud.select(F.col("batch").cast("int").alias("b"), *cell, F.col("feat")[0].alias("v")).groupBy("b", "a0", "a1", "a2").agg(F.array(F.count("*").cast("float"), F.sum("v").cast("float")).alias("features"))
    row = F.expr("((cast(b as bigint) * 64 + a0) * 64 + a1) * 4096 + a2")
    return g.select(row.alias("row"), "b", "a0", "a1", "a2", "features")
