"""SQL surface: point views and table functions under fixed names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import farthest


@F.udtf(returnType="slot: int, idx: bigint")
class FarthestPoints:
    """SELECT * FROM farthest_points(TABLE(points) WITH SINGLE PARTITION, n): columns idx and pos in any order."""

    def __init__(self):
        self.rows, self.n = [], 0

    def eval(self, row, n: int):
        self.rows.append((row["idx"], row["pos"]))
        self.n = n

    def terminate(self):
        self.rows.sort(key=lambda r: r[0])
        if self.rows:
            for slot, at in enumerate(farthest([r[1] for r in self.rows], self.n)):
                yield slot, self.rows[at][0]


_CELL = "floor(pos[{i}] / cell)"
VOXELS = f"""CREATE OR REPLACE TEMPORARY FUNCTION voxels(cell DOUBLE)
RETURNS TABLE (batch BIGINT, v0 BIGINT, v1 BIGINT, v2 BIGINT, n BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)
RETURN SELECT batch, {", ".join(f"{_CELL.format(i=i)} AS v{i}" for i in range(3))}, count(*) AS n, {", ".join(f"avg(pos[{i}]) AS {c}" for i, c in enumerate("xyz"))}
FROM points GROUP BY batch, v0, v1, v2"""
# queries look in the cells of the radius around their own; the test on the distance follows
BALL_QUERY = f"""CREATE OR REPLACE TEMPORARY FUNCTION ball_query(radius DOUBLE, k INT)
RETURNS TABLE (batch BIGINT, q BIGINT, slot INT, ref BIGINT, dist2 FLOAT)
RETURN SELECT batch, q, CAST(rn - 1 AS INT) AS slot, ref, dist2 FROM (
  SELECT *, row_number() OVER (PARTITION BY batch, q ORDER BY ref) AS rn FROM (
    SELECT a.batch, a.idx AS q, b.idx AS ref, d2(a.pos, b.pos) AS dist2
    FROM (SELECT batch, idx, pos, c0 + o0 AS c0, c1 + o1 AS c1, c2 + o2 AS c2 FROM (
            SELECT *, {", ".join(f"floor(pos[{i}] / radius) AS c{i}" for i in range(3))} FROM queries)
          {" ".join(f"LATERAL VIEW explode(array(-1, 0, 1)) t{i} AS o{i}" for i in range(3))}) a
    JOIN (SELECT *, {", ".join(f"floor(pos[{i}] / radius) AS c{i}" for i in range(3))} FROM points) b USING (batch, c0, c1, c2))
  WHERE dist2 < CAST(radius AS FLOAT) * CAST(radius AS FLOAT)) WHERE rn <= k"""


def register(spark: SparkSession, **views: DataFrame) -> None:
    """Temp views by name, the table function ``farthest_points`` and SQL functions ``d2`` and ``l1`` of ARRAY<FLOAT>.

    Over a view ``points`` also voxels(cell), and over ``points`` and ``queries`` ball_query(radius, k): SQL table functions that Spark plans
    as an aggregation and as an equi-join on cells.
    """
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.udtf.register("farthest_points", FarthestPoints)
    zero = "cast(0 as float)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION d2(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN aggregate(zip_with(a, b, (x, y) -> (y - x) * (y - x)), {zero}, (s, t) -> s + t)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l1(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN aggregate(zip_with(a, b, (x, y) -> abs(y - x)), {zero}, (s, t) -> s + t)")
    if "points" in views:
        spark.sql(VOXELS)
    if {"points", "queries"} <= views.keys():
        spark.sql(BALL_QUERY)
