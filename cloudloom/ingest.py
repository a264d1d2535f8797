"""Canonical tables from padded, ragged, pointer- and offset-coded clouds.

point: (batch BIGINT, idx BIGINT, pos ARRAY<FLOAT>). idx restarts per batch for dense clouds and is global for flat ones.
cloud: (batch BIGINT, n BIGINT) keeps empty clouds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.order import cut, global_order, running_sum

STRETCH = 64  # indices under which ranges are listed
POINT = T.StructType([T.StructField("batch", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("pos", T.ArrayType(T.FloatType()))])
EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
COO = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("weight", T.FloatType())])


def points(spark: SparkSession, rows, schema: T.StructType = POINT) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def drop_padding(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Valid points of a padded cloud; lengths: (batch, n). Padding may hold anything."""
    return df.join(lengths.select("batch", "n"), "batch").where("idx < n").drop("n")


def clouds(df: DataFrame, batches: int | None = None) -> DataFrame:
    """(batch, n), with the empty clouds below ``batches``."""
    counted = df.groupBy("batch").agg(F.count("*").alias("n"))
    if batches is None:
        return counted
    return df.sparkSession.range(batches).select(F.col("id").alias("batch")).join(counted, "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("n"))


def offsets_to_ptr(offsets: DataFrame) -> DataFrame:
    """(batch, lo, hi) from inclusive offsets (batch, hi) without a leading 0. One row per cloud."""
    rows, _ = global_order(offsets.select("batch", "hi"), [F.col("batch")], "__n")
    rows = cut(rows)
    before = rows.select((F.col("__n") + 1).alias("__n"), F.col("hi").alias("lo"))
    return rows.join(before, "__n", "left").select("batch", F.coalesce("lo", F.lit(0)).alias("lo"), "hi")


def with_batch(flat: DataFrame, ptr: DataFrame) -> DataFrame:
    """Points (idx, ...) with the batch of the range lo <= idx < hi they are in, null in none.

    Ranges are listed under the stretches of STRETCH indices that they meet, so a point is compared with at most that many, and
    the join is on equal stretches, whatever the number of clouds.
    """
    each = F.explode(F.sequence(F.expr(f"lo div {STRETCH}"), F.expr(f"(hi - 1) div {STRETCH}")))
    ranges = ptr.where("hi > lo").select("batch", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), each.alias("__s"))
    points = flat.drop("batch").withColumn("__s", F.expr(f"idx div {STRETCH}"))
    inside = (points["__s"] == ranges["__s"]) & (F.col("idx") >= F.col("__lo")) & (F.col("idx") < F.col("__hi"))
    return points.join(ranges, inside, "left").select(*[points[c] for c in points.columns if c != "__s"], "batch")


def ptr_of(cloud: DataFrame) -> DataFrame:
    """(batch, lo, hi) exclusive prefix sums of (batch, n); one row per cloud."""
    return running_sum(cloud.select("batch", "n"), [F.col("batch")], "n", "hi").select("batch", (F.col("hi") - F.col("n")).alias("lo"), "hi")


def csr(coo: DataFrame, num_nodes: int) -> DataFrame:
    """(row, lo, hi) of the sorted edges, for all nodes."""
    degree = coo.groupBy("row").agg(F.count("*").alias("n"))
    nodes = coo.sparkSession.range(num_nodes).select(F.col("id").alias("row"))
    return ptr_of(nodes.join(degree, "row", "left").select(F.col("row").alias("batch"), F.coalesce("n", F.lit(0)).alias("n"))).withColumnRenamed("batch", "row")


def violations(df: DataFrame, **checks) -> dict[str, int]:
    """Rows that break each named boolean condition, in one pass."""
    row = df.agg(*[F.sum(F.when(~c, 1).otherwise(0)).alias(name) for name, c in checks.items()]).first()
    return {name: int(row[name] or 0) for name in checks}


def validate(df: DataFrame, **checks) -> DataFrame:
    bad = {k: v for k, v in violations(df, **checks).items() if v}
    if bad:
        raise ValueError(f"invalid rows: {bad}")
    return df
