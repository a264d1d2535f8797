"""Durable cuts of lineage and global row numbers without a one-task window."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

TASK_ROWS = 1_000_000
_RECORDS: ContextVar[tuple[list[str], ...]] = ContextVar("records", default=())  # each thread has its own


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _RECORDS.get():
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``cut`` in ``parts`` buckets by ``key``: a join on it does not shuffle this table again, however often it is read."""
    name = f"table_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.repartition(parts, key).write.option("path", path).bucketBy(parts, key).saveAsTable(name, format="parquet")
    for made in _RECORDS.get():
        made.append(path)
    out = df.sparkSession.table(name)
    out._cut_path, out._cut_name = path, name
    return out


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of all tables that this thread cuts within, for a caller who knows when what reads them is done."""
    made: list[str] = []
    token = _RECORDS.set((*_RECORDS.get(), made))
    try:
        yield made
    finally:
        _RECORDS.reset(token)


def remove(spark: SparkSession, *paths: str) -> None:
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the tables behind results of ``cut`` and ``bucketed``; only once all that is read from them has been cut again."""
    for df in tables:
        if hasattr(df, "_cut_name"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._cut_name}")
        remove(df.sparkSession, df._cut_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver's plans of them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions of at most about TASK_ROWS rows, which sorts and hash tables hold without spilling; a set number is not merged again."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def fixed(df: DataFrame) -> DataFrame:
    """Checkpoint that keeps partitions and their row order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def global_order(df: DataFrame, keys: Sequence[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number rows 0..n-1 by ``keys``: range partitions, checkpoint, partition offsets.

    Only one count per partition comes to the driver. Rows equal in all keys get their numbers in no set order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = fixed(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = spark.createDataFrame(offsets, "__part long, __offset long")
    out = (
        ordered.withColumn("__part", part)
        .join(F.broadcast(table), "__part")  # one row per partition
        .withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1))
    )
    return out.drop("__at", "__part", "__offset"), total


def permutation(df: DataFrame, id_col: str, seed: int = 0, name: str = "place") -> DataFrame:
    """``df`` with a place 0..n-1 of each row in an order that ``seed`` shuffles; the same for the same ids, however rows are dealt to tasks.

    The order is that of the MD5 of "seed:id" and then of the id, so any engine with MD5 gives it. Ids must be unique for the places
    to be set: rows that repeat an id follow each other in no set order. A null id counts as the empty string. An empty table gives no rows.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return global_order(df.withColumn("__digest", digest), [F.col("__digest"), F.col(id_col)], name)[0].drop("__digest")


def running_sum(df: DataFrame, keys: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the inclusive sum of ``value`` up to each row in the order of ``keys``, which part all rows: partition sums and offsets."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = fixed(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sums = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).agg(F.sum(value)).collect()}  # one row per partition
    offsets, total = [], 0
    for p in sorted(sums):
        offsets.append((p, total))
        total += sums[p] or 0
    table = spark.createDataFrame(offsets, "__part long, __offset long")
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumn("__part", part).withColumn(name, F.sum(value).over(own)).join(F.broadcast(table), "__part")
    return out.withColumn(name, F.col(name) + F.col("__offset")).drop("__at", "__part", "__offset")
