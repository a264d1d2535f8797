"""Registered queries of the point, graph, voxel and sparse operators, each over whole tables, with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest
from .functions import metric as m
from .functions import morton
from .operators import gather, graph, index, knn, loss, radius, rings, sampling, sparse, voxel
from .plans.order import cut, discard, global_order, permutation, shared_dir
from .sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- SQL building blocks ---------------------------------------------------------------------------------------------

CLOUD = """cloud AS (SELECT user_id % 4 AS batch, event_id AS idx, ((user_id % 64) / 8::DOUBLE)::FLOAT AS x,
  (floor(hour(ts) * 60 + minute(ts)) / 16::DOUBLE)::FLOAT AS y, (floor(value) / 8::DOUBLE)::FLOAT AS z,
  floor(value)::FLOAT AS f0, hour(ts)::FLOAT AS f1 FROM events)"""
CELLS = f"""{CLOUD}, cells0 AS (SELECT DISTINCT batch, floor(x / 2) AS c0, floor(y / 8) AS c1, floor(z / 8) AS c2 FROM cloud),
cells AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY c0, c1, c2) - 1 AS idx, (c0 * 2)::FLOAT AS x, (c1 * 8)::FLOAT AS y, (c2 * 8)::FLOAT AS z FROM cells0)"""
D2 = "(((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) + (b.z - a.z) * (b.z - a.z))"
L1 = "((abs(b.x - a.x) + abs(b.y - a.y)) + abs(b.z - a.z))"


def top(a: str, b: str, k: int, d: str = D2, where: str = "", order: str = "d, ref") -> str:
    """Rows (batch, q, slot, ref, d) of the first k pairs of each query."""
    return f"SELECT batch, q, rn - 1 AS slot, ref, d FROM (SELECT *, row_number() OVER (PARTITION BY batch, q ORDER BY {order}) AS rn FROM (SELECT a.batch, a.idx AS q, b.idx AS ref, {d} AS d FROM {a} a JOIN {b} b ON a.batch = b.batch {where})) WHERE rn <= {k}"


def slots(q: str, k: int) -> str:
    return f"SELECT batch, idx AS q, s AS slot FROM {q}, (SELECT unnest(range(0, {k})) AS s)"


def _d64(name: str = "embedding") -> str:
    return "(" * 63 + f"(b.{name}[1] - a.{name}[1]) * (b.{name}[1] - a.{name}[1])" + "".join(f" + (b.{name}[{i}] - a.{name}[{i}]) * (b.{name}[{i}] - a.{name}[{i}]))" for i in range(2, 65))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- nearest-neighbour joins -----------------------------------------------------------------------------------------


@query("feature_knn", f"""SELECT q, rn - 1 AS slot, ref, sqrt(d)::FLOAT AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, ref) AS rn
 FROM (SELECT a.vec_id AS q, b.vec_id AS ref, {_d64()} AS d FROM embeddings a, embeddings b)) WHERE rn <= 8""")
def feature_knn(spark, d):
    e = t.embeddings_cloud(spark, d)
    return knn.knn(e, e, 8, 64).select("q", "slot", "ref", "dist")


@query("knn_events", f"WITH {CLOUD} SELECT batch, q, slot, ref, sqrt(d)::FLOAT AS dist FROM ({top('cloud', 'cloud', 8)})")
def knn_events(spark, d):
    cloud = t.events_cloud(spark, d)
    return index.SpatialIndex.build(cloud).knn(cloud, 8)


@query("bvh_knn", f"WITH {CELLS} SELECT batch, q, slot, ref, sqrt(d)::FLOAT AS dist FROM ({top('cells', 'cells', 4)})")
def bvh_knn(spark, d):
    cells = cut(t.cell_cloud(t.events_cloud(spark, d)))
    return index.SpatialIndex.build(cells, "blocks").knn(cells, 4)


@query("knn_cells", f"WITH {CELLS} SELECT batch, q, slot, ref, sqrt(d)::FLOAT AS dist FROM ({top('cells', 'cloud', 8)})")
def knn_cells(spark, d):
    cloud = t.events_cloud(spark, d)
    return knn.knn(t.cell_cloud(cloud), cloud, 8)


@query("grid_knn", f"WITH {CELLS} SELECT batch, q, slot, ref, sqrt(d)::FLOAT AS dist FROM ({top('cells', 'cloud', 5)})")
def grid_knn(spark, d):
    cloud = t.events_cloud(spark, d)
    return rings.grid_knn(t.cell_cloud(cloud), cloud, 5, 2.0)


@query("grid_knn_far", f"WITH {CELLS}, far AS (SELECT batch, idx, x + 512::FLOAT AS x, y - 512::FLOAT AS y, z FROM cells) SELECT batch, q, slot, ref, sqrt(d)::FLOAT AS dist FROM ({top('far', 'cloud', 2)})")
def grid_knn_far(spark, d):
    cloud = t.events_cloud(spark, d)
    moved = t.cell_cloud(cloud).withColumn("pos", F.array(F.col("pos")[0] + m.flit(512), F.col("pos")[1] - m.flit(512), F.col("pos")[2]))
    return rings.grid_knn(moved, cloud, 2, 4.0)


def _flat(cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat points (idx, pos) in the order of batch and idx, and their pointers (batch, lo, hi)."""
    numbered, _ = global_order(cloud.select("batch", "idx", "pos"), [F.col("batch"), F.col("idx")], "g")
    flat = cut(numbered.select("batch", F.col("g").alias("idx"), "pos"))
    return flat.select("idx", "pos"), cut(ingest.ptr_of(ingest.clouds(flat)))


_FLAT = "fx AS (SELECT batch, row_number() OVER (ORDER BY batch, idx) - 1 AS idx, x, y, z FROM cells), fy AS (SELECT batch, row_number() OVER (ORDER BY batch, idx) - 1 AS idx, x, y, z FROM cloud)"


@query("ptr_knn", f"WITH {CELLS}, {_FLAT} SELECT q, ref, slot FROM ({top('fx', 'fy', 3)})")
def ptr_knn(spark, d):
    cloud = t.events_cloud(spark, d)
    (x, ptr_x), (y, ptr_y) = _flat(t.cell_cloud(cloud)), _flat(cloud)
    return knn.ptr_knn(x, y, ptr_x, ptr_y, 3)


@query("ptr_radius", f"WITH {CELLS}, {_FLAT} SELECT q, ref, rn - 1 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ref) AS rn FROM (SELECT a.idx AS q, b.idx AS ref FROM fx a JOIN fy b ON a.batch = b.batch WHERE {D2} < 4::FLOAT)) WHERE rn <= 8")
def ptr_radius(spark, d):
    cloud = t.events_cloud(spark, d)
    (x, ptr_x), (y, ptr_y) = _flat(t.cell_cloud(cloud)), _flat(cloud)
    return radius.ptr_radius(x, y, ptr_x, ptr_y, 2.0, 8)


@query("knn_graph", f"""SELECT ref AS src, q AS dst FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, ref) AS rn
 FROM (SELECT a.vec_id AS q, b.vec_id AS ref, {_d64()} AS d FROM embeddings a JOIN embeddings b ON a.label = b.label)) WHERE rn <= 6 AND q <> ref""")
def knn_graph(spark, d):
    return knn.knn_graph(t.embeddings_cloud(spark, d, by_label=True), 5, 64)


@query("flat_knn", f"WITH {CELLS} SELECT q, ref, slot FROM ({top('cells', 'cells', 3)})")
def flat_knn(spark, d):
    cells = t.cell_cloud(t.events_cloud(spark, d))
    return knn.flat_knn(cells, cells, 3)


@query("three_nn", f"WITH {CELLS} SELECT batch, q, slot, ref::INT AS ref, sqrt(d)::FLOAT AS dist FROM ({top('cloud', 'cells', 3)})")
def three_nn(spark, d):
    cloud = t.events_cloud(spark, d)
    return knn.three_nn(cloud, t.cell_cloud(cloud))


@query("nearest_1024lane", f"""WITH {CELLS}, base AS (SELECT batch, min(idx) AS lo FROM cloud GROUP BY 1), flat AS (SELECT a.batch, row_number() OVER (ORDER BY a.batch, a.idx) - 1 AS idx, x, y, z FROM cells a),
n AS (SELECT a.idx AS q, b.idx AS ref, row_number() OVER (PARTITION BY a.idx ORDER BY {D2}, (b.idx - lo) % 1024, b.idx - lo) AS rn FROM flat a JOIN cloud b ON a.batch = b.batch JOIN base ON base.batch = a.batch WHERE {D2} < 1e38)
SELECT flat.idx, coalesce(ref, 0) AS nearest FROM flat LEFT JOIN (SELECT * FROM n WHERE rn = 1) ON q = flat.idx""")
def nearest_1024lane(spark, d):
    cloud = t.events_cloud(spark, d)
    flat, _ = global_order(t.cell_cloud(cloud).withColumnRenamed("idx", "local"), [F.col("batch"), F.col("local")], "idx")
    return knn.nearest(flat.select("batch", "idx", "pos"), cloud)


@query("pointcept_knn", f"""WITH {CELLS}, f AS ({top('cells', 'cloud', 4, where=f'WHERE {D2} < 1e10')})
SELECT batch, q, slot, coalesce(ref, -1)::INT AS ref, coalesce(sqrt(d)::FLOAT, 1e5::FLOAT) AS dist FROM ({slots('cells', 4)}) LEFT JOIN f USING (batch, q, slot)""")
def pointcept_knn(spark, d):
    cloud = t.events_cloud(spark, d)
    return knn.offset_knn(t.cell_cloud(cloud), cloud, 4).select("batch", "q", "slot", "ref", "dist")


# ---- range joins -----------------------------------------------------------------------------------------------------

_BALL = top("cells", "cloud", 16, where=f"WHERE {D2} < (2.1::FLOAT * 2.1::FLOAT)::FLOAT", order="ref")
_BALL4 = top("cells", "cloud", 4, where=f"WHERE {D2} < (2.1::FLOAT * 2.1::FLOAT)::FLOAT", order="ref")


@query("ball_query_dense", f"WITH {CELLS} SELECT batch, q, slot, ref, d AS dist2 FROM ({_BALL})")
def ball_query_dense(spark, d):
    cloud = t.events_cloud(spark, d)
    return radius.ball_query(t.cell_cloud(cloud), cloud, 2.1, 16)


@query("ball_query_padded", f"WITH {CELLS}, f AS ({_BALL4}) SELECT batch, q, slot, coalesce(ref, -1) AS ref, coalesce(d, 0) AS dist2 FROM ({slots('cells', 4)}) LEFT JOIN f USING (batch, q, slot)")
def ball_query_padded(spark, d):
    cloud = t.events_cloud(spark, d)
    return radius.padded_ball_query(t.cell_cloud(cloud), cloud, 2.1, 4)


@query("ball_query_return_nn", f"""WITH {CELLS}, f AS ({_BALL4}), g AS (SELECT batch, q, slot, coalesce(ref, -1) AS ref, coalesce(d, 0) AS dist2 FROM ({slots('cells', 4)}) LEFT JOIN f USING (batch, q, slot))
SELECT g.batch, q, slot, ref, dist2, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM g LEFT JOIN cloud c ON c.batch = g.batch AND c.idx = ref""")
def ball_query_return_nn(spark, d):
    cloud = t.events_cloud(spark, d)
    return radius.ball_query_points(t.cell_cloud(cloud), cloud, 2.1, 4).select("batch", "q", "slot", "ref", "dist2", *[F.col("nn")[i].alias(c) for i, c in enumerate("xyz")])


@query("ball_query_pointnet2_pad", f"""WITH {CELLS}, f AS ({_BALL4}), g AS (SELECT batch, q, slot, ref FROM ({slots('cells', 4)}) LEFT JOIN f USING (batch, q, slot)), h AS (SELECT batch, q, ref AS r0 FROM f WHERE slot = 0)
SELECT batch, q, slot, coalesce(ref, r0, 0)::INT AS ref FROM g LEFT JOIN h USING (batch, q)""")
def ball_query_pointnet2_pad(spark, d):
    cloud = t.events_cloud(spark, d)
    return radius.repeat_first_ball_query(t.cell_cloud(cloud), cloud, 2.1, 4)


@query("radius_flat", f"WITH {CLOUD} SELECT q, ref, slot FROM ({top('cloud', 'cloud', 16, where=f'WHERE {D2} < (1.05::DOUBLE * 1.05::DOUBLE)::FLOAT', order='ref')})")
def radius_flat(spark, d):
    cloud = t.events_cloud(spark, d)
    return radius.flat_radius(cloud, cloud, 1.05, 16)


@query("radius_ignore_same", f"WITH {CLOUD} SELECT q, ref, slot FROM ({top('cloud', 'cloud', 4, where=f'WHERE a.idx <> b.idx AND {D2} < (0.7::DOUBLE * 0.7::DOUBLE)::FLOAT', order='ref')})")
def radius_ignore_same(spark, d):
    cloud = t.events_cloud(spark, d)
    return radius.flat_radius(cloud, cloud, 0.7, 4, ignore_same_index=True)


@query("radius_graph", f"WITH {CLOUD} SELECT ref AS src, q AS dst FROM ({top('cloud', 'cloud', 9, where=f'WHERE {D2} < (0.6::DOUBLE * 0.6::DOUBLE)::FLOAT', order='ref')}) WHERE q <> ref")
def radius_graph(spark, d):
    return radius.radius_graph(t.events_cloud(spark, d), 0.6, 8)


# ---- gather, grouping, interpolation ---------------------------------------------------------------------------------


@query("gather", f"WITH {CELLS} SELECT q, slot, s.batch, ref, f0, f1 FROM ({top('cells', 'cloud', 4)}) s JOIN cloud c ON c.batch = s.batch AND c.idx = ref")
def gather_query(spark, d):
    cloud = t.events_cloud(spark, d)
    found = knn.knn(t.cell_cloud(cloud), cloud, 4).drop("dist")
    return gather.gather(cloud, found).select("batch", "q", "slot", "ref", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"))


@query("grouping_relative_xyz", f"""WITH {CELLS} SELECT s.batch, q, slot, ref, c.x - e.x AS x, c.y - e.y AS y, c.z - e.z AS z, c.f0, c.f1
FROM ({top('cells', 'cloud', 4)}) s JOIN cloud c ON c.batch = s.batch AND c.idx = ref JOIN cells e ON e.batch = s.batch AND e.idx = q""")
def grouping_relative_xyz(spark, d):
    cloud = t.events_cloud(spark, d)
    out = gather.query_and_group(cloud.select("batch", "idx", "feat"), cloud, t.cell_cloud(cloud), 4, 2)
    return out.select("batch", "q", "slot", F.col("ref").cast("long").alias("ref"), *[F.col("feat")[i].alias(c) for i, c in enumerate(("x", "y", "z", "f0", "f1"))])


@query("selected_pair_d2", f"WITH {CELLS} SELECT batch, q, slot, ref, d FROM ({_BALL4})")
def selected_pair_d2(spark, d):
    cloud = t.events_cloud(spark, d)
    cells = t.cell_cloud(cloud)
    return gather.pair_d2(cells, cloud, radius.ball_query(cells, cloud, 2.1, 4))


_W = f"w AS (SELECT batch, q, slot, ref, (1 / (sqrt(d)::FLOAT + 1e-8::DOUBLE)) AS r FROM ({top('cloud', 'cells', 3)})), ww AS (SELECT batch, q, slot, ref, (r / greatest(sum(r) OVER (PARTITION BY batch, q), 1e-20))::FLOAT AS w FROM w)"


def _cell_features(cells):
    return cells.select("batch", "idx", F.array(F.col("pos")[0] + F.col("pos")[1], F.col("pos")[2] * m.flit(2)).alias("feat"))


@query("interpolate_idw", f"WITH {CELLS}, {_W} SELECT ww.batch, q, round(sum(((c.x + c.y) * w)::DOUBLE), 1) AS f0, round(sum(((c.z * 2)::FLOAT * w)::DOUBLE), 1) AS f1 FROM ww JOIN cells c ON c.batch = ww.batch AND c.idx = ref GROUP BY ALL")
def interpolate_idw(spark, d):
    cloud = t.events_cloud(spark, d)
    cells = t.cell_cloud(cloud)
    out = gather.interpolation(cells, cloud, _cell_features(cells), 2, kind="double")
    return out.select("batch", "q", *[F.round(F.col("feat")[i], 1).alias(f"f{i}") for i in range(2)])


def _three(spark, d):
    cloud = t.events_cloud(spark, d)
    cells = t.cell_cloud(cloud)
    return cloud, cells, gather.inverse_distance_weights(knn.three_nn(cloud, cells)).drop("dist")


@query("three_interpolate", f"""WITH {CELLS}, {_W}, v AS (SELECT ww.batch, q, slot, (c.x + c.y) * w AS a, (c.z * 2)::FLOAT * w AS b FROM ww JOIN cells c ON c.batch = ww.batch AND c.idx = ref)
SELECT u.batch, u.q, round(((u.a + v.a) + s.a)::DOUBLE, 4) AS f0, round(((u.b + v.b) + s.b)::DOUBLE, 4) AS f1 FROM v u JOIN v ON u.batch = v.batch AND u.q = v.q AND v.slot = 1 JOIN v s ON s.batch = u.batch AND s.q = u.q AND s.slot = 2 WHERE u.slot = 0""")
def three_interpolate(spark, d):
    _, cells, w = _three(spark, d)
    return gather.three_interpolate(_cell_features(cells), w).select("batch", "q", *[F.round(F.col("feat")[i].cast("double"), 4).alias(f"f{i}") for i in range(2)])


@query("three_interpolate_grad", f"WITH {CELLS}, {_W} SELECT ww.batch, ref, round(sum((c.f0 * w)::DOUBLE), 1) AS g0, round(sum((c.f1 * w)::DOUBLE), 1) AS g1 FROM ww JOIN cloud c ON c.batch = ww.batch AND c.idx = q GROUP BY ALL")
def three_interpolate_grad(spark, d):
    cloud, _, w = _three(spark, d)
    g, _ = gather.three_interpolate_grad(cloud.select("batch", F.col("idx").alias("q"), "feat"), w, "double")
    return g.select("batch", F.col("ref").cast("long").alias("ref"), *[F.round(F.col("feat")[i], 1).alias(f"g{i}") for i in range(2)])


@query("edge_conv", f"""WITH {CELLS}, n AS (SELECT s.batch, q, a.x AS ax, a.y AS ay, a.z AS az, greatest(b.x - a.x, 0) AS x, greatest(b.y - a.y, 0) AS y, greatest(b.z - a.z, 0) AS z FROM ({top('cells', 'cells', 5)}) s JOIN cells a ON a.batch = s.batch AND a.idx = q JOIN cells b ON b.batch = s.batch AND b.idx = ref)
SELECT batch, q, max(ax) AS f0, max(ay) AS f1, max(az) AS f2, max(x) AS f3, max(y) AS f4, max(z) AS f5 FROM n GROUP BY ALL""")
def edge_conv(spark, d):
    out = gather.edge_features(t.cell_cloud(t.events_cloud(spark, d)), 5, 3)
    return out.select("batch", "q", *[F.col("feat")[i].alias(f"f{i}") for i in range(6)])


# ---- voxels, clusters, pooling ---------------------------------------------------------------------------------------

_VOX = f"{CLOUD}, v0 AS (SELECT *, floor((x / 1::FLOAT)::FLOAT)::BIGINT AS c0, floor((y / 4::FLOAT)::FLOAT)::BIGINT AS c1, floor((z / 4::FLOAT)::FLOAT)::BIGINT AS c2 FROM cloud), v1 AS (SELECT batch, c0, c1, c2, count(*) AS count FROM v0 GROUP BY ALL), v AS (SELECT row_number() OVER (ORDER BY batch, c0, c1, c2) - 1 AS voxel_id, *, sum(count) OVER (ORDER BY batch, c0, c1, c2) AS hi FROM v1)"
_SIZE = (1.0, 4.0, 4.0)


@query("voxelize", f"WITH {_VOX} SELECT voxel_id, batch, c0, c1, c2, count, (hi - count)::BIGINT AS ptr_lo, hi::BIGINT AS ptr_hi FROM v")
def voxelize(spark, d):
    return voxel.voxelize(t.events_cloud(spark, d), _SIZE).voxel


@query("voxel_inverse", f"WITH {_VOX} SELECT idx, voxel_id, row_number() OVER (ORDER BY v0.batch, c0, c1, c2, idx) - 1 AS pos_in_order FROM v0 JOIN v USING (batch, c0, c1, c2)")
def voxel_inverse(spark, d):
    return voxel.voxelize(t.events_cloud(spark, d), _SIZE).point


_MEAN = ", ".join(f"round(avg({c})::FLOAT::DOUBLE, 4) AS {c}" for c in "xyz")


@query("voxel_downsample_mean", f"WITH {_VOX} SELECT batch, c0, c1, c2, count(*) AS count, {_MEAN}, round(avg(f0)::FLOAT::DOUBLE, 3) AS f0, round(avg(f1)::FLOAT::DOUBLE, 3) AS f1 FROM v0 GROUP BY ALL")
def voxel_downsample_mean(spark, d):
    out = voxel.voxel_downsample(t.events_cloud(spark, d), _SIZE, channels=2)
    return out.select("batch", "c0", "c1", "c2", "count", *[F.round(F.col("pos")[i].cast("double"), 4).alias(c) for i, c in enumerate("xyz")], *[F.round(F.col("feat")[i].cast("double"), 3).alias(f"f{i}") for i in range(2)])


@query("voxel_downsample_sum", f"WITH {_VOX} SELECT batch, c0, c1, c2, sum(f0)::FLOAT AS f0, sum(f1)::FLOAT AS f1 FROM v0 GROUP BY ALL")
def voxel_downsample_sum(spark, d):
    out = voxel.voxel_downsample(t.events_cloud(spark, d), _SIZE, feature_reduce="sum", channels=2)
    return out.select("batch", "c0", "c1", "c2", *[F.col("feat")[i].alias(f"f{i}") for i in range(2)])


@query("voxel_grad", f"WITH {_VOX} SELECT idx, ((c0 + c1)::FLOAT / count)::FLOAT AS g0, (c2::FLOAT / count)::FLOAT AS g1 FROM v0 JOIN v USING (batch, c0, c1, c2)")
def voxel_grad(spark, d):
    vox = voxel.voxelize(t.events_cloud(spark, d), _SIZE)
    g = vox.voxel.select("voxel_id", F.array((F.col("c0") + F.col("c1")).cast("float"), F.col("c2").cast("float")).alias("feat"))
    return voxel.voxel_pool_grad(g, vox).select("idx", F.col("feat")[0].alias("g0"), F.col("feat")[1].alias("g1"))


def _cluster_sql(axes: str, sizes: tuple) -> str:
    total, stride = [], "1"
    for c, s in zip(axes, sizes, strict=True):
        total.append(f"trunc((({c} - lo_{c}) / {s}::FLOAT)::FLOAT)::BIGINT * {stride}")
        stride += f" * (trunc(((hi_{c} - lo_{c}) / {s}::FLOAT)::FLOAT)::BIGINT + 1)"
    box = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in axes)
    return f"g AS (SELECT idx, batch, f0, f1, {' + '.join(total)} AS cluster FROM cloud, (SELECT {box} FROM cloud))"


@query("grid_cluster_legacy", f"WITH {CLOUD}, {_cluster_sql('xyz', (1.5, 7, 3))} SELECT idx, cluster FROM g")
def grid_cluster_legacy(spark, d):
    return voxel.grid_cluster(t.events_cloud(spark, d), (1.5, 7.0, 3.0))


@query("grid_cluster_pyg", f"WITH {CLOUD}, {_cluster_sql('xy', (1.5, 7))} SELECT idx, cluster FROM g")
def grid_cluster_pyg(spark, d):
    return voxel.grid_cluster(t.events_cloud(spark, d), (1.5, 7.0), 2)


_GRID = f"{CLOUD.replace('user_id % 4 AS batch,', 'user_id % 4 AS batch, (user_id % 4)::FLOAT AS b,')}, {_cluster_sql('xyzb', (2, 16, 4, 1))}"


def _clustered(spark, d):
    cloud = t.events_cloud(spark, d)
    return cloud.join(voxel.voxel_grid(cloud, (2.0, 16.0, 4.0)), "idx")


@query("voxel_grid", f"WITH {_GRID} SELECT idx, cluster FROM g")
def voxel_grid(spark, d):
    return voxel.voxel_grid(t.events_cloud(spark, d), (2.0, 16.0, 4.0))


@query("avg_pool_x", f"WITH {_GRID} SELECT cluster, max_by(batch, idx) AS batch, round(avg(f0)::FLOAT::DOUBLE, 3) AS f0, round(avg(f1)::FLOAT::DOUBLE, 3) AS f1 FROM g GROUP BY ALL")
def avg_pool_x(spark, d):
    return voxel.avg_pool_x(_clustered(spark, d), 2).select("cluster", "batch", *[F.round(F.col("feat")[i].cast("double"), 3).alias(f"f{i}") for i in range(2)])


@query("avg_pool_x_fixed", f"WITH {_GRID}, n AS (SELECT unnest(range(0, 2000)) AS cluster), p AS (SELECT cluster, round(avg(f0)::FLOAT::DOUBLE, 3) AS f0, round(avg(f1)::FLOAT::DOUBLE, 3) AS f1 FROM g GROUP BY ALL) SELECT cluster, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1 FROM n LEFT JOIN p USING (cluster)")
def avg_pool_x_fixed(spark, d):
    return voxel.avg_pool_x_fixed(_clustered(spark, d), 2, 2000).select("cluster", *[F.round(F.col("feat")[i].cast("double"), 3).alias(f"f{i}") for i in range(2)])


_PAIRS = top("cloud", "cloud", 9, where=f"WHERE {D2} < (0.6::DOUBLE * 0.6::DOUBLE)::FLOAT", order="ref")


@query("avg_pool_graph_edges", f"""WITH {_GRID.replace('cloud AS', 'cloud AS MATERIALIZED', 1)}, e AS (SELECT ref AS src, q AS dst FROM ({_PAIRS}) WHERE q <> ref), r AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS node FROM (SELECT DISTINCT cluster FROM g)), nn AS (SELECT idx, node FROM g JOIN r USING (cluster))
SELECT u.node AS src, v.node AS dst, count(*)::FLOAT AS a0, sum(e.src % 8)::FLOAT AS a1 FROM e JOIN nn u ON u.idx = e.src JOIN nn v ON v.idx = e.dst WHERE u.node <> v.node GROUP BY ALL""")
def avg_pool_graph_edges(spark, d):
    edges = radius.radius_graph(t.events_cloud(spark, d), 0.6, 8).withColumn("attr", F.array(m.flit(1), (F.col("src") % 8).cast("float")))
    _, out = voxel.avg_pool_graph(_clustered(spark, d), edges, 2, 2)
    return out.select("src", "dst", F.col("attr")[0].alias("a0"), F.col("attr")[1].alias("a1"))


def _scatter(how: str) -> None:
    sql = {
        "sum": "round(sum(o_totalprice), 2)", "mean": "round(avg(o_totalprice), 8)", "max": "max(o_totalprice)", "min": "min(o_totalprice)",
        "argmax": "arg_max(o_orderkey, (o_totalprice, -o_orderkey))", "argmin": "arg_min(o_orderkey, (o_totalprice, o_orderkey))",
    }[how]

    @query(f"scatter_{how}", f"SELECT o_custkey AS dst, {sql} AS value FROM orders GROUP BY ALL")
    def run(spark, d):
        rows = t.table(spark, d, "orders").select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("value"))
        out = voxel.scatter(rows, how)
        return out.withColumn("value", F.round("value", 8 if how == "mean" else 2)) if how in ("sum", "mean") else out


for _how in ("sum", "mean", "max", "min", "argmax", "argmin"):
    _scatter(_how)


# ---- losses ----------------------------------------------------------------------------------------------------------


def _two(spark, d):
    cloud = t.events_cloud(spark, d)
    return t.cell_cloud(cloud), cloud.select("batch", "idx", "pos")


def _sizes(df):
    return df.groupBy("batch").agg(F.count("*").alias("n"))


def _chamfer_sql(d: str, reduce: str) -> str:
    one = lambda a, b: f"SELECT batch, {reduce}(d::DOUBLE) AS loss FROM (SELECT a.batch, a.idx, min({d}) AS d FROM {a} a JOIN {b} b ON a.batch = b.batch GROUP BY ALL) GROUP BY ALL"
    return f"WITH {CELLS}, xy AS ({one('cells', 'cloud')}), yx AS ({one('cloud', 'cells')})"


@query("chamfer_l2", f"{_chamfer_sql(D2, 'avg')} SELECT round(avg(xy.loss + yx.loss), 4) AS loss FROM xy JOIN yx USING (batch)")
def chamfer_l2(spark, d):
    x, y = _two(spark, d)
    return loss.chamfer_distance(x, y, _sizes(x), _sizes(y)).select(F.round("loss", 4).alias("loss"))


@query("chamfer_l1", f"{_chamfer_sql(L1, 'avg')} SELECT round(avg(xy.loss + yx.loss), 4) AS loss FROM xy JOIN yx USING (batch)")
def chamfer_l1(spark, d):
    x, y = _two(spark, d)
    return loss.chamfer_distance(x, y, _sizes(x), _sizes(y), norm=1).select(F.round("loss", 4).alias("loss"))


@query("chamfer_reductions", f"""{_chamfer_sql(D2, 'sum')}, mx AS ({_chamfer_sql(D2, 'max')} SELECT batch, greatest(xy.loss, yx.loss) AS loss FROM xy JOIN yx USING (batch))
SELECT 'sum' AS kind, batch, round((xy.loss + yx.loss) * (1 + batch), 3) AS loss FROM xy JOIN yx USING (batch) UNION ALL SELECT 'max', batch, round(loss, 3) FROM mx""")
def chamfer_reductions(spark, d):
    x, y = _two(spark, d)
    weights = _sizes(x).select("batch", (F.col("batch") + 1).cast("double").alias("w"))
    s = loss.chamfer_distance(x, y, _sizes(x), _sizes(y), point_reduction="sum", batch_reduction=None, weights=weights)
    mx = loss.chamfer_distance(x, y, _sizes(x), _sizes(y), point_reduction="max", batch_reduction=None)
    return s.withColumn("kind", F.lit("sum")).unionByName(mx.withColumn("kind", F.lit("max"))).select("kind", "batch", F.round("loss", 3).alias("loss"))


_NN = f"nn AS ({top('cells', 'cloud', 1)})"


@query("chamfer_normals", f"""WITH {CELLS}, {_NN}, p AS (SELECT nn.batch, q, a.x + 1 AS nx, a.y + 1 AS ny, a.z + 1 AS nz, b.x + 1 AS mx, b.y + 1 AS my, b.z + 1 AS mz FROM nn JOIN cells a ON a.batch = nn.batch AND a.idx = q JOIN cloud b ON b.batch = nn.batch AND b.idx = ref)
SELECT batch, q, round(1 - abs((nx::DOUBLE * mx + ny::DOUBLE * my + nz::DOUBLE * mz) / (greatest(sqrt(nx::DOUBLE * nx + ny::DOUBLE * ny + nz::DOUBLE * nz), 1e-6) * greatest(sqrt(mx::DOUBLE * mx + my::DOUBLE * my + mz::DOUBLE * mz), 1e-6))), 6) AS d FROM p""")
def chamfer_normals(spark, d):
    x, y = _two(spark, d)
    shift = lambda df: df.withColumn("pos", F.transform("pos", lambda v: v + m.flit(1)))
    return loss.normal_losses(loss.point_losses(x, y), shift(x), shift(y)).select("batch", "q", F.round("d", 6).alias("d"))


_GRAD = "SELECT nn.batch, ref AS idx, round(sum(-2 * (a.x::DOUBLE - b.x)), 3) AS gx, round(sum(-2 * (a.y::DOUBLE - b.y)), 3) AS gy, round(sum(-2 * (a.z::DOUBLE - b.z)), 3) AS gz FROM {} nn JOIN cells a ON a.batch = nn.batch AND a.idx = q JOIN cloud b ON b.batch = nn.batch AND b.idx = ref GROUP BY ALL"


def _xyz(df):
    return df.select("batch", "idx", *[(F.round(F.col("feat")[i].cast("double"), 3) + 0.0).alias(f"g{c}") for i, c in enumerate("xyz")])


@query("chamfer_empty", f"WITH {CELLS}, nn AS ({top('cells', 'cloud', 1, where='AND b.batch < 2')}) SELECT c.batch, c.idx AS q, coalesce(nn.ref, -1) AS ref, coalesce(nn.d, 0::FLOAT) AS d FROM cells c LEFT JOIN nn ON nn.batch = c.batch AND nn.q = c.idx")
def chamfer_empty(spark, d):
    """Half of the reference clouds are empty."""
    x, y = _two(spark, d)
    return loss.point_losses(x, y.where("batch < 2"))


@query("zero_weight_anchor", f"WITH {CELLS}, b AS (SELECT DISTINCT batch FROM cells) SELECT x.batch, y.batch AS other, 0::DOUBLE AS loss FROM b x, b y")
def zero_weight_anchor(spark, d):
    return loss.zero_weight_anchor(_sizes(t.cell_cloud(t.events_cloud(spark, d))))


@query("chamfer_grad_y", f"WITH {CELLS}, {_NN} {_GRAD.format('nn')}")
def chamfer_grad_y(spark, d):
    x, y = _two(spark, d)
    return _xyz(loss.pair_gradients(loss.point_losses(x, y).withColumn("g", F.lit(1.0)), x, y)[1])


_PART = "SELECT nn.batch, {0} AS idx, {1} * (nn.batch + 1) * (a.x::DOUBLE - b.x) AS gx, {1} * (nn.batch + 1) * (a.y::DOUBLE - b.y) AS gy, {1} * (nn.batch + 1) * (a.z::DOUBLE - b.z) AS gz FROM {2} nn JOIN {3} a ON a.batch = nn.batch AND a.idx = q JOIN {4} b ON b.batch = nn.batch AND b.idx = ref"


@query("chamfer_grad_weighted", f"WITH {CELLS}, {_NN}, mm AS ({top('cloud', 'cells', 1)}), g AS ({_PART.format('q', '2', 'nn', 'cells', 'cloud')} UNION ALL {_PART.format('ref', '-2', 'mm', 'cloud', 'cells')}) SELECT batch, idx, round(sum(gx), 3) AS gx, round(sum(gy), 3) AS gy, round(sum(gz), 3) AS gz FROM g GROUP BY ALL")
def chamfer_grad_weighted(spark, d):
    x, y = _two(spark, d)
    weights = _sizes(x).select("batch", (F.col("batch") + 1).alias("w"))
    return _xyz(loss.chamfer_gradients(x, y, _sizes(x), _sizes(y), point_reduction="sum", batch_reduction="sum", weights=weights)[0])


_FARTHEST = "SELECT batch, q, ref, d FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY d DESC, q) AS far FROM ({0})) WHERE far = 1"
_SHARE = "SELECT {5}.batch, {0} AS idx, {1} * CASE WHEN {5}.d > {6}.d THEN 1 WHEN {5}.d = {6}.d THEN 0.5 ELSE 0 END * (a.x::DOUBLE - b.x) AS gx, {1} * CASE WHEN {5}.d > {6}.d THEN 1 WHEN {5}.d = {6}.d THEN 0.5 ELSE 0 END * (a.y::DOUBLE - b.y) AS gy, {1} * CASE WHEN {5}.d > {6}.d THEN 1 WHEN {5}.d = {6}.d THEN 0.5 ELSE 0 END * (a.z::DOUBLE - b.z) AS gz, {5}.d >= {6}.d AS own FROM {5} JOIN {6} USING (batch) JOIN {3} a ON a.batch = {5}.batch AND a.idx = {5}.q JOIN {4} b ON b.batch = {5}.batch AND b.idx = {5}.ref"


@query("chamfer_grad_max", f"WITH {CELLS}, fx AS ({_FARTHEST.format(top('cells', 'cloud', 1))}), fy AS ({_FARTHEST.format(top('cloud', 'cells', 1))}), g AS ({_SHARE.format('fx.q', '2', '', 'cells', 'cloud', 'fx', 'fy')} UNION ALL {_SHARE.format('fy.ref', '-2', '', 'cloud', 'cells', 'fy', 'fx')}) SELECT batch, idx, round(sum(gx), 3) AS gx, round(sum(gy), 3) AS gy, round(sum(gz), 3) AS gz FROM g WHERE own GROUP BY ALL")
def chamfer_grad_max(spark, d):
    x, y = _two(spark, d)
    return _xyz(loss.chamfer_gradients(x, y, _sizes(x), _sizes(y), point_reduction="max", batch_reduction="sum")[0])


@query("chamfer_grad_x_l1", f"WITH {CELLS}, nn AS ({top('cells', 'cloud', 1, L1)}) SELECT nn.batch, q AS idx, CASE WHEN a.x > b.x THEN 1.0 ELSE -1.0 END AS gx, CASE WHEN a.y > b.y THEN 1.0 ELSE -1.0 END AS gy, CASE WHEN a.z > b.z THEN 1.0 ELSE -1.0 END AS gz FROM nn JOIN cells a ON a.batch = nn.batch AND a.idx = q JOIN cloud b ON b.batch = nn.batch AND b.idx = ref")
def chamfer_grad_x_l1(spark, d):
    x, y = _two(spark, d)
    return _xyz(loss.pair_gradients(loss.point_losses(x, y, norm=1).withColumn("g", F.lit(1.0)), x, y, norm=1)[0])


@query("ball_query_grad", f"WITH {CELLS}, nn AS ({_BALL4}) {_GRAD.format('nn')}")
def ball_query_grad(spark, d):
    x, y = _two(spark, d)
    return _xyz(loss.pair_gradients(radius.ball_query(x, y, 2.1, 4).withColumn("g", F.lit(1.0)), x, y)[1])


# ---- sampling --------------------------------------------------------------------------------------------------------


def _fps_sql(count: str, skip: bool = False) -> str:
    bar = "CASE WHEN (x * x + y * y) + z * z < 1e-3::FLOAT THEN -1e30::FLOAT END" if skip else "NULL::FLOAT"
    return f"""WITH RECURSIVE {CLOUD}, p AS (SELECT batch, list(idx ORDER BY idx) AS ids, list(x ORDER BY idx) AS xs, list(y ORDER BY idx) AS ys, list(z ORDER BY idx) AS zs, list({bar} ORDER BY idx) AS bar, len(ids) AS n FROM cloud GROUP BY 1),
f(batch, slot, pick, least) AS (SELECT batch, 0, 1::BIGINT, list_transform(xs, lambda v: 'infinity'::FLOAT) FROM p
 UNION ALL SELECT batch, slot + 1, list_position(list_transform(low, lambda v, i: coalesce(bar[i], v)), list_max(list_transform(low, lambda v, i: coalesce(bar[i], v))))::BIGINT, low
 FROM (SELECT f.batch, slot, bar, list_transform(range(1, n + 1), lambda i: least(least[i], ((xs[i] - xs[pick]) * (xs[i] - xs[pick]) + (ys[i] - ys[pick]) * (ys[i] - ys[pick])) + (zs[i] - zs[pick]) * (zs[i] - zs[pick]))) AS low, {count} AS m FROM f JOIN p ON f.batch = p.batch WHERE slot + 1 < {count}))
SELECT f.batch, slot, ids[pick] AS idx FROM f JOIN p USING (batch)"""


@query("fps", _fps_sql("24"))
def fps(spark, d):
    return sampling.furthest_point_sample(t.events_cloud(spark, d), 24)


@query("fps_skip_origin", _fps_sql("16", True).replace("ids[pick] AS idx", "ids[pick]::INT AS idx"))
def fps_skip_origin(spark, d):
    return sampling.sampled_from_origin_free(t.events_cloud(spark, d), 16)


@query("fps_ratio", _fps_sql("ceil((n::FLOAT * 0.01::FLOAT)::FLOAT)"))
def fps_ratio(spark, d):
    return sampling.ratio_fps(t.events_cloud(spark, d), 0.01)


@query("fps_offset", _fps_sql("(f.batch + 6)").replace("ids[pick] AS idx", "ids[pick]::INT AS idx"))
def fps_offset(spark, d):
    cloud = t.events_cloud(spark, d)
    return sampling.offset_fps(cloud, cloud.select("batch").distinct().withColumn("m", F.col("batch") + 6))


@query("fps_distributed", _fps_sql("8").replace(CLOUD, CELLS).replace("FROM cloud GROUP BY 1", "FROM cells GROUP BY 1"))
def fps_distributed(spark, d):
    return sampling.distributed(cut(t.cell_cloud(t.events_cloud(spark, d))), 8)


@query("ptr_fps", _fps_sql("ceil((n::FLOAT * 0.05::FLOAT)::FLOAT)").replace(CLOUD, f"{CELLS}, {_FLAT}").replace("FROM cloud GROUP BY 1", "FROM fx GROUP BY 1"))
def ptr_fps(spark, d):
    return sampling.ptr_fps(*_flat(t.cell_cloud(t.events_cloud(spark, d))), 0.05, random_start=False)


def point_group(spark: SparkSession, d: str, centres: int = 32, k: int = 16) -> DataFrame:
    """Group pipeline: farthest points, their positions, the k nearest points of each, positions relative to the centre."""
    cloud = t.events_cloud(spark, d)
    picked = cut(sampling.furthest_point_sample(cloud, centres).distinct())
    at = picked.join(cloud.select("batch", "idx", "pos"), ["batch", "idx"]).select("batch", F.col("slot").cast("long").alias("idx"), "pos")
    found = index.SpatialIndex.build(cloud).knn(at, k)
    out = gather.grouping(found.drop("dist"), cloud.select("batch", "idx", "feat"), cloud, at, 2)
    return out.select("batch", "q", "slot", "ref", *[F.col("feat")[i].alias(c) for i, c in enumerate(("x", "y", "z", "f0", "f1"))])


@query("point_group_pipeline", f"""WITH picked AS (SELECT DISTINCT batch, slot, idx FROM ({_fps_sql("32")})), {CLOUD}, at_ AS (SELECT p.batch, p.slot AS idx, c.x, c.y, c.z FROM picked p JOIN cloud c USING (batch, idx)),
 near AS ({top('at_', 'cloud', 16)})
 SELECT n.batch, n.q, n.slot, n.ref, r.x - a.x AS x, r.y - a.y AS y, r.z - a.z AS z, r.f0, r.f1 FROM near n JOIN at_ a ON a.batch = n.batch AND a.idx = n.q JOIN cloud r ON r.batch = n.batch AND r.idx = n.ref""")
def point_group_pipeline(spark, d):
    return point_group(spark, d)


# ---- spatial index ---------------------------------------------------------------------------------------------------


def _bits_sql(v: str, at: int) -> str:
    return " + ".join(f"((({v}) >> {i}) & 1) * {1 << (3 * i + at)}" for i in range(12))


_KEY = f"k AS (SELECT batch, idx, floor((x / 0.125::FLOAT)::FLOAT)::BIGINT AS c0, floor((y / 0.125::FLOAT)::FLOAT)::BIGINT AS c1, floor((z / 0.125::FLOAT)::FLOAT)::BIGINT AS c2, x < 0 OR y < 0 OR z < 0 AS invalid FROM cloud), kk AS (SELECT batch, idx, invalid, CASE WHEN invalid THEN 0 ELSE {_bits_sql('c0', 0)} + {_bits_sql('c1', 1)} + {_bits_sql('c2', 2)} END AS key FROM k)"


@query("morton_key", f"WITH {CLOUD}, {_KEY} SELECT batch, idx, key::BIGINT AS key, invalid FROM kk")
def morton_key(spark, d):
    return index.morton_keys(t.events_cloud(spark, d), (0.0,) * 3, (0.125,) * 3).drop("pos")


@query("morton_decode", f"WITH {CLOUD}, {_KEY} SELECT batch, idx, CASE WHEN invalid THEN 0 ELSE c0 END AS c0, CASE WHEN invalid THEN 0 ELSE c1 END AS c1, CASE WHEN invalid THEN 0 ELSE c2 END AS c2 FROM k")
def morton_decode(spark, d):
    out = index.morton_keys(t.events_cloud(spark, d), (0.0,) * 3, (0.125,) * 3).withColumn("c", morton.decode(F.col("key")))
    return out.select("batch", "idx", *[F.col(f"c.{a}").alias(f"c{i}") for i, a in enumerate("xyz")])


@query("hot_cell_fraction", f"WITH {CLOUD}, k AS (SELECT floor((x / 1::FLOAT)::FLOAT) a, floor((y / 4::FLOAT)::FLOAT) b, floor((z / 4::FLOAT)::FLOAT) c, count(*) n FROM cloud GROUP BY ALL) SELECT round(max(n) / sum(n), 9) AS fraction FROM k")
def hot_cell_fraction(spark, d):
    return index.hot_cell_fraction(t.events_cloud(spark, d), (0.0,) * 3, _SIZE).select(F.round("fraction", 9).alias("fraction"))


@query("bvh_blocks", f"WITH {CLOUD} SELECT batch, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z, min(idx) AS min_idx FROM cloud GROUP BY ALL")
def bvh_blocks(spark, d):
    """The root box of each batch, merged from its blocks."""
    b = index.SpatialIndex.build(t.events_cloud(spark, d)).blocks
    box = [f(F.col(c)[i]).alias(f"{c}_{a}") for i, a in enumerate("xyz") for f, c in ((F.min, "lo"), (F.max, "hi"))]
    return b.groupBy("batch").agg(F.sum("n").alias("n"), *box, F.min("min_idx").alias("min_idx"))


@query("bvh_reopened", f"WITH {CELLS} SELECT batch, q, slot, ref, sqrt(d)::FLOAT AS dist FROM ({top('far', 'cloud', 4)})".replace(" SELECT batch, q, slot", ", far AS (SELECT batch, idx, (x + 64)::FLOAT AS x, (y + 256)::FLOAT AS y, z FROM cells) SELECT batch, q, slot", 1))
def bvh_reopened(spark, d):
    """A written index opened by its path, asked from far outside the cloud."""
    cloud = t.events_cloud(spark, d)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.SpatialIndex.build(cloud, path=path)
    away = F.array(*[(F.col("pos")[i] + F.lit(s)).cast("float") for i, s in enumerate((64.0, 256.0, 0.0))])
    return index.SpatialIndex.open(spark, path).knn(t.cell_cloud(cloud).withColumn("pos", away), 4)


@query("bvh_radius", f"WITH {CELLS} SELECT batch, q, slot, ref, d AS dist2 FROM ({_BALL})")
def bvh_radius(spark, d):
    cloud = t.events_cloud(spark, d)
    return index.SpatialIndex.build(cloud, "blocks").ball_query(t.cell_cloud(cloud), 2.1, 16)


# ---- sparse convolution ----------------------------------------------------------------------------------------------

_SITES = f"{CLOUD}, s0 AS (SELECT batch::INT AS b, floor(x)::INT AS a0, floor(y / 4)::INT AS a1, floor(z / 4)::INT AS a2, count(*)::FLOAT AS f0, sum(f0)::FLOAT AS f1 FROM cloud GROUP BY ALL), sites AS (SELECT ((b::BIGINT * 64 + a0) * 64 + a1) * 4096 + a2 AS row, * FROM s0)"
_KER = "ker AS (SELECT (i * 3 + j) * 3 + k AS o, i, j, k FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 3)) AS j), (SELECT unnest(range(0, 3)) AS k))"
_SUBM = f"WITH {_SITES}, {_KER}, rules AS (SELECT o AS koff, n.row AS in_row, s.row AS out_row FROM sites s, ker JOIN sites n ON n.b = s.b AND n.a0 = s.a0 + i - 1 AND n.a1 = s.a1 + j - 1 AND n.a2 = s.a2 + k - 1)"
_SHAPE = (16, 32, 4096)
_REACH = f"""WITH {_SITES}, {_KER}, reach AS (SELECT o AS koff, row AS in_row, b, (a0 + 1 - i) // 2 AS a0, (a1 + 1 - j) // 2 AS a1, (a2 + 1 - k) // 2 AS a2 FROM sites, ker
 WHERE (a0 + 1 - i) % 2 = 0 AND (a1 + 1 - j) % 2 = 0 AND (a2 + 1 - k) % 2 = 0 AND a0 + 1 - i >= 0 AND a1 + 1 - j >= 0 AND a2 + 1 - k >= 0 AND (a0 + 1 - i) // 2 < 8 AND (a1 + 1 - j) // 2 < 16 AND (a2 + 1 - k) // 2 < 2048),
outs AS (SELECT row_number() OVER (ORDER BY b, a0, a1, a2) - 1 AS row, * FROM (SELECT DISTINCT b, a0, a1, a2 FROM reach)), rules AS (SELECT koff, in_row, outs.row AS out_row FROM reach JOIN outs USING (b, a0, a1, a2))"""
_WEIGHT = "(((koff * 4 + cin * 2 + cout) % 7 - 3) / 4::DOUBLE)"
_CH = "ch AS (SELECT row, 0 AS cin, f0 AS x FROM sites UNION ALL SELECT row, 1, f1 FROM sites), co AS (SELECT unnest([0, 1]) AS cout)"
_CONV = f"{_CH}, y AS (SELECT out_row AS row, cout, sum(x * {_WEIGHT}) AS v FROM rules JOIN ch ON ch.row = in_row, co GROUP BY ALL)"


def _weights(spark):
    r = spark.range(27 * 4).select(F.expr("cast(id div 4 as int)").alias("offset"), F.expr("cast(id div 2 % 2 as int)").alias("cin"), F.expr("cast(id % 2 as int)").alias("cout"))
    return r.withColumn("w", ((F.pmod(F.col("offset") * 4 + F.col("cin") * 2 + F.col("cout"), F.lit(7)) - 3) / 4.0).cast("float"))


def _sites(spark, d):
    return t.event_sites(t.events_cloud(spark, d))


@query("subm_rulebook", f"{_SUBM} SELECT koff::INT AS \"offset\", in_row, out_row FROM rules")
def subm_rulebook(spark, d):
    return sparse.subm_rulebook(_sites(spark, d))


@query("subm_conv", f"{_SUBM}, {_CONV} SELECT row, round(max(CASE WHEN cout = 0 THEN v END) + 0.5, 2) AS y0, round(max(CASE WHEN cout = 1 THEN v END) - 1, 2) AS y1 FROM y GROUP BY ALL")
def subm_conv(spark, d):
    x = sparse.SparseConvTensor(_sites(spark, d), _SHAPE, 4)
    y = sparse.SubMConv3d(_weights(spark), 2, bias=[0.5, -1.0], key="s")(x)
    return y.sites.select("row", *[F.round(F.col("features")[i].cast("double"), 2).alias(f"y{i}") for i in range(2)])


@query("sparse_conv_rulebook", f"{_REACH} SELECT koff::INT AS \"offset\", in_row, out_row FROM rules")
def sparse_conv_rulebook(spark, d):
    return sparse.conv_rulebook(_sites(spark, d), _SHAPE, 3, 2, 1)[1]


@query("sparse_conv", f"{_REACH}, {_CONV} SELECT row, round(max(CASE WHEN cout = 0 THEN v END), 2) AS y0, round(max(CASE WHEN cout = 1 THEN v END), 2) AS y1 FROM y GROUP BY ALL")
def sparse_conv(spark, d):
    x = sparse.SparseConvTensor(_sites(spark, d), _SHAPE, 4)
    y = sparse.SparseConv3d(_weights(spark), 2, stride=2, padding=1)(x)
    return y.sites.select("row", *[F.round(F.col("features")[i].cast("double"), 2).alias(f"y{i}") for i in range(2)])


@query("sparse_inverse_conv", f"""{_REACH}, {_CONV}, o2 AS (SELECT row, cout AS cin, v::FLOAT AS x FROM y), z AS (SELECT in_row AS row, cout, sum(x * {_WEIGHT}) AS v FROM rules JOIN o2 ON o2.row = out_row, co GROUP BY ALL)
SELECT sites.row, round(coalesce(max(CASE WHEN cout = 0 THEN v END), 0), 1) AS y0, round(coalesce(max(CASE WHEN cout = 1 THEN v END), 0), 1) AS y1 FROM sites LEFT JOIN z ON z.row = sites.row GROUP BY ALL""")
def sparse_inverse_conv(spark, d):
    x = sparse.SparseConvTensor(_sites(spark, d), _SHAPE, 4)
    w = _weights(spark)
    y = sparse.SparseSequential(sparse.SparseConv3d(w, 2, stride=2, padding=1, key="k"), sparse.SparseInverseConv3d(w, 2, key="k"))(x)
    return y.sites.select("row", *[F.round(F.col("features")[i].cast("double"), 1).alias(f"y{i}") for i in range(2)])


@query("sparse_conv_grads", f"""{_REACH}, {_CH}, g AS (SELECT row, cout, ((row + cout) % 5 - 2)::FLOAT AS g FROM outs, co)
SELECT 'w' AS kind, koff::BIGINT AS a, cin::BIGINT AS b, cout::BIGINT AS c, round(sum(g::DOUBLE * x), 1) AS v FROM rules JOIN ch ON ch.row = in_row JOIN g ON g.row = out_row GROUP BY ALL
UNION ALL SELECT 'b', 0, 0, cout, round(sum(g::DOUBLE), 1) FROM g GROUP BY ALL
UNION ALL SELECT 'x', in_row, cin, 0, round(sum(g::DOUBLE * {_WEIGHT}), 1) FROM rules JOIN g ON g.row = out_row, (SELECT unnest([0, 1]) AS cin) GROUP BY ALL""")
def sparse_conv_grads(spark, d):
    sites = _sites(spark, d)
    outputs, rules, _ = sparse.conv_rulebook(sites, _SHAPE, 3, 2, 1)
    grad = outputs.select("row", F.array(*[((F.col("row") + c) % 5 - 2).cast("float") for c in range(2)]).alias("features"))
    dx, dw, db = sparse.gradients(sites, rules, _weights(spark), grad)
    long = lambda c: F.col(c).cast("long") if isinstance(c, str) else F.lit(c).cast("long")
    row = lambda df, kind, a, b, c, v: df.select(F.lit(kind).alias("kind"), long(a).alias("a"), long(b).alias("b"), long(c).alias("c"), F.round(F.col(v).cast("double"), 1).alias("v"))
    x = dx.select("row", F.posexplode("feat").alias("cin", "g"))
    return row(dw, "w", "offset", "cin", "cout", "w").union(row(db, "b", 0, 0, "cout", "g")).union(row(x, "x", "row", "cin", 0, "g"))


_GRID = ", ".join(f"(SELECT unnest(range(0, {n}))::INT AS {c})" for c, n in zip(("b", "a0", "a1", "a2"), (4, 16, 32, 16), strict=True))


@query("sparse_dense", f"WITH {_SITES} SELECT b, a0, a1, a2, coalesce(2 * f0, 0)::FLOAT AS f0, coalesce(2 * f1, 0)::FLOAT AS f1 FROM (SELECT * FROM {_GRID}) LEFT JOIN (SELECT b, a0, a1, a2, f0, f1 FROM sites WHERE a2 < 16) USING (b, a0, a1, a2)")
def sparse_dense(spark, d):
    """Sites within a grid, checked, with doubled features, as a dense grid."""
    sites = sparse.validate_sites(cut(t.event_sites(t.events_cloud(spark, d)).where("a2 < 16")), (16, 32, 16), 4)
    tensor = sparse.SparseConvTensor(sites, (16, 32, 16), 4)
    doubled = sites.select("row", F.transform("features", lambda v: v * F.lit(2).cast("float")).alias("features"))
    grid = tensor.replace_feature(doubled).dense(2)
    return grid.select("b", "a0", "a1", "a2", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


# ---- graphs ----------------------------------------------------------------------------------------------------------

_EDGES = "e0 AS (SELECT l_partkey * 2 AS r, l_suppkey * 2 + 1 AS c FROM lineitem GROUP BY ALL), e1 AS (SELECT r, c FROM e0 UNION ALL SELECT c, r FROM e0), e AS (SELECT row_number() OVER (ORDER BY r, c) - 1 AS edge_id, r, c, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS rn, count(*) OVER (PARTITION BY r) AS degree FROM e1)"


def _lcg_sql(x: str) -> str:
    return f"(({x}) * {graph.A} + {graph.C}) % {graph.M}"


def _u_sql(step: str) -> str:
    return f"(({_lcg_sql(_lcg_sql(_lcg_sql(f'(walk_id * 7919 + ({step}) * 104729) % {graph.M}')))}) / {graph.M}::DOUBLE)"


def _starts(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("walk_id"), (F.col("p_partkey") * 2).alias("node"))


@query("random_walk_uniform", f"""WITH RECURSIVE {_EDGES}, w(walk_id, step, node, edge_id) AS (SELECT p_partkey, 0, p_partkey * 2, NULL::BIGINT FROM part
 UNION ALL SELECT walk_id, step + 1, coalesce(e.c, node), coalesce(e.edge_id, -1) FROM (SELECT w.*, least(floor({_u_sql('step + 1')} * dg.degree), dg.degree - 1)::BIGINT AS k FROM w LEFT JOIN (SELECT DISTINCT r, degree FROM e) dg ON dg.r = node WHERE step < 6) s LEFT JOIN e ON e.r = node AND e.rn = k)
SELECT * FROM w""")
def random_walk_uniform(spark, d):
    return graph.random_walk(t.parts_graph(spark, d), _starts(spark, d), 6)


def _biased_sql(steps: int) -> str:
    """Walks with p = 2 and q = 4, a step after the other: the weights 1/2, 1 and 1/4 and their running sums are exact."""
    parts = ["w0 AS (SELECT p_partkey AS walk_id, p_partkey * 2 AS node, NULL::BIGINT AS edge_id, NULL::BIGINT AS prev FROM part)",
             f"w1 AS (SELECT walk_id, coalesce(e.c, node) AS node, coalesce(e.edge_id, -1) AS edge_id, node AS prev FROM (SELECT w0.*, least(floor({_u_sql('1')} * dg.degree), dg.degree - 1)::BIGINT AS k FROM w0 LEFT JOIN (SELECT DISTINCT r, degree FROM e) dg ON dg.r = node) s LEFT JOIN e ON e.r = node AND e.rn = k)"]
    for t_ in range(2, steps + 1):
        parts += [
            f"c{t_} AS (SELECT w.walk_id, e.rn, e.c AS nxt, e.edge_id, CASE WHEN e.c = w.prev THEN 0.5 WHEN b.r IS NOT NULL THEN 1 ELSE 0.25 END::DOUBLE AS wt FROM w{t_ - 1} w JOIN e ON e.r = w.node LEFT JOIN (SELECT DISTINCT r, c FROM e) b ON b.r = e.c AND b.c = w.prev)",
            f"d{t_} AS (SELECT *, sum(wt) OVER (PARTITION BY walk_id ORDER BY rn) AS cum, sum(wt) OVER (PARTITION BY walk_id) AS total, max(rn) OVER (PARTITION BY walk_id) AS last FROM c{t_})",
            f"k{t_} AS (SELECT walk_id, min(rn) AS rn FROM d{t_} WHERE cum > {_u_sql(str(t_))} * total OR rn = last GROUP BY 1)",
            f"w{t_} AS (SELECT w.walk_id, coalesce(d.nxt, w.node) AS node, coalesce(d.edge_id, -1) AS edge_id, w.node AS prev FROM w{t_ - 1} w LEFT JOIN (SELECT d.* FROM d{t_} d JOIN k{t_} USING (walk_id, rn)) d ON d.walk_id = w.walk_id)",
        ]
    return f"WITH {_EDGES}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT walk_id, {i} AS step, node, edge_id FROM w{i}" for i in range(steps + 1))


@query("random_walk_biased", _biased_sql(4))
def random_walk_biased(spark, d):
    return graph.random_walk(t.parts_graph(spark, d), _starts(spark, d), 4, p=2.0, q=4.0)


def _nodes(edges: DataFrame) -> int:
    return int(edges.agg(F.max(F.greatest("row", "col"))).first()[0] or 0) + 1


@query("graclus")
def graclus(spark, d):
    one = cut(t.parts_edges(spark, d))  # several passes read the edges
    out = graph.graclus(t.both_ways(one), _nodes(one), weighted=True)
    discard(one)
    return out


@query("mutual_matching")
def mutual_matching(spark, d):
    one = cut(t.parts_edges(spark, d))
    out = graph.mutual_matching(one, _nodes(one))  # either direction stands for both
    discard(one)
    return out


@query("sorted_edges", f"WITH {_EDGES} SELECT edge_id, r AS row, c AS col, rn, degree FROM e")
def sorted_edges(spark, d):
    return graph.sorted_edges(t.parts_graph(spark, d))


@query("permutation", "SELECT event_id, row_number() OVER (ORDER BY md5('7:' || event_id::VARCHAR), event_id) - 1 AS place FROM events")
def shuffled(spark, d):
    return permutation(spark.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id", seed=7)
