"""The registered remapping queries over the driver's tables, and the same in DuckDB SQL by cross join.

The tables have no geography: coordinates come from their dense keys, on a spiral over the sphere or on a
regular grid. Field values are whole numbers, so means are the same double in any order of summation.
"""

from __future__ import annotations

import math
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import axes as A
from ..operators import quadrature as Q
from ..operators import remap as R
from ..operators.nearest import grid_knn, knn, linear_nearest, radius_knn
from ..operators.radius import Axis, Grid, grid_radius_join, radius_join
from ..sources import ncgrid, sinks
from ..work import shared_path

GOLD, GOLD2 = 137.50776405003785, 222.49223594996215


#: lon, lat, radius: both poles, a point at a pole row's edge, and one far from any.
POLE_TARGETS = [(10, 90, 0.5), (200, -90, 0.5), (77, 80, 0.5), (5, 1, 0.25)]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spiral(k: str, n: str, turn: float) -> list[str]:
    return [f"degrees(asin(cast(2.0 as double) * ({k} + cast(0.5 as double)) / {n} - cast(1.0 as double))) as lat", f"({k} * cast({turn!r} as double)) % cast(360.0 as double) as lon"]


FIELDS = {"orders": "cast(cast(round(o_totalprice * 100) as bigint) as double) as v, cast(cast(round(o_totalprice) as bigint) as double) as u",
          "customer": "cast(cast(round(c_acctbal * 100) as bigint) as double) as v"}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}


def _sql_points(table: str, kind: str) -> str:
    k, n = KEYS[table], f"(select count(*) from {table})"
    cols = [f"cast({k} as bigint) as {'pid' if kind == 'cloud' else 'tid'}", *_spiral(k, n, GOLD if kind == "cloud" else GOLD2)]
    cols.append(FIELDS[table] if kind == "cloud" else f"cast(4 as double) * pi() / {n} * (cast(0.5 as double) + ({k} % 7) * cast(0.25 as double)) as area")
    return f"select {', '.join(cols)} from {table}"


def _points(spark: SparkSession, sf: str, table: str, kind: str) -> DataFrame:
    df = _read(spark, sf, table)
    df.createOrReplaceTempView(f"sw_{table}")
    sql = _sql_points(table, kind).replace(f"(select count(*) from {table})", str(df.count()))
    return spark.sql(sql.replace(f" from {table}", f" from sw_{table}"))


def _grid_shape(n: int) -> tuple[int, int]:
    nlon = math.floor(math.sqrt(n * 5 / 3))
    return nlon, n // nlon


def _grid(spark: SparkSession, sf: str, poles: bool) -> tuple[DataFrame, Axis, Axis]:
    df = _read(spark, sf, "orders")
    nlon, nlat = _grid_shape(df.count())
    lat = Axis(-90.0, 180.0 / (nlat - 1), nlat) if poles else Axis(-90 + 90.0 / nlat, 180.0 / nlat, nlat)
    lon = Axis(0.0, 360.0 / nlon, nlon) if poles else Axis(180.0 / nlon, 360.0 / nlon, nlon)
    k = F.col("o_orderkey").cast("long")
    ilat, ilon = F.floor(k / nlon).cast("long"), F.pmod(k, F.lit(nlon))
    if poles:
        la, lo = F.lit(-90.0) + ilat * 180.0 / (nlat - 1), ilon * 360.0 / nlon
    else:
        la, lo = F.lit(-90.0) + (ilat + 0.5) * 180.0 / nlat, (ilon + 0.5) * 360.0 / nlon
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("double")
    g = df.where(k < nlon * nlat).select(k.alias("pid"), ilat.alias("ilat"), ilon.alias("ilon"), la.alias("lat"), lo.alias("lon"), cents.alias("v"))
    return g, lat, lon


def _sql_grid(poles: bool) -> str:
    la = "cast(-90 as double) + ilat * cast(180.0 as double) / (nlat - 1)" if poles else "cast(-90 as double) + (ilat + cast(0.5 as double)) * cast(180.0 as double) / nlat"
    lo = "ilon * cast(360.0 as double) / nlon" if poles else "(ilon + cast(0.5 as double)) * cast(360.0 as double) / nlon"
    return f"""select pid, ilat, ilon, {la} as lat, {lo} as lon, v from (
  select cast(o_orderkey as bigint) as pid, cast(floor(o_orderkey / nlon) as bigint) as ilat, o_orderkey % nlon as ilon, nlon, nlat, cast(cast(round(o_totalprice * 100) as bigint) as double) as v
  from orders, (select nlon, cast(floor(n / nlon) as bigint) as nlat from (select cast(floor(sqrt(count(*) * 5 / cast(3 as double))) as bigint) as nlon, count(*) as n from orders))
  where o_orderkey < nlon * nlat)"""


def _mesh_rows(ne: int = 2) -> list[tuple[int, list[tuple[float, float, float]]]]:
    """A cubed sphere of 6 * ne * ne quads with equal angles on each face."""
    faces = [((1, 0, 0), (0, 1, 0), (0, 0, 1)), ((0, 1, 0), (-1, 0, 0), (0, 0, 1)), ((-1, 0, 0), (0, -1, 0), (0, 0, 1)),
             ((0, -1, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 1), (0, 1, 0), (-1, 0, 0)), ((0, 0, -1), (0, 1, 0), (1, 0, 0))]
    t = [math.tan(math.pi / 4 * (2 * i / ne - 1)) if 2 * i != ne else 0.0 for i in range(ne + 1)]

    def node(c, u, v, a, b):
        p = [c[k] + a * u[k] + b * v[k] for k in range(3)]
        r = math.sqrt(sum(x * x for x in p))
        return tuple(x / r for x in p)

    return [(f * ne * ne + j * ne + i, [node(*faces[f], t[i + x], t[j + y]) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
            for f in range(6) for j in range(ne) for i in range(ne)]


def _mesh(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_mesh_rows(), "eid long, nodes array<struct<x:double,y:double,z:double>>")


def _sql_mesh() -> str:
    num = lambda v: f"cast({v!r} as double)"
    rows = [f"({e}, " + ", ".join(num(c) for p in nodes for c in p) + ")" for e, nodes in _mesh_rows()]
    return f"mesh(eid, {', '.join(f'{a}{k}' for k in range(4) for a in 'xyz')}) as (values {', '.join(rows)})"


def _sql_gll() -> str:
    x, w = Q.gauss_lobatto(Q.NP)
    rows = [f"({j * 4 + i}, cast({x[i]!r} as double), cast({x[j]!r} as double), cast({w[i] * w[j]!r} as double))" for j in range(4) for i in range(4)]
    return f"gll(node, a, b, w) as (values {', '.join(rows)})"


def _sql_nodes() -> str:
    dot = lambda p, q: " + ".join(f"{p}{c} * {q}{c}" for c in "xyz")
    pos = ", ".join(f"{c}0 * (1 - a) * (1 - b) + {c}1 * a * (1 - b) + {c}2 * a * b + {c}3 * (1 - a) * b as p{c}" for c in "xyz")
    da = ", ".join(f"({c}1 - {c}0) * (1 - b) + ({c}2 - {c}3) * b as g{c}" for c in "xyz")
    db = ", ".join(f"({c}3 - {c}0) * (1 - a) + ({c}2 - {c}1) * a as h{c}" for c in "xyz")
    proj = ", ".join(f"({d}{c} * r * r - p{c} * ({dot('p', d)})) / (r * r * r) as {e}{c}" for d, e in (("g", "u"), ("h", "v")) for c in "xyz")
    return f"""{_sql_mesh()}, {_sql_gll()},
m1 as (select eid, node, w, {pos}, {da}, {db} from mesh, gll), m2 as (select *, sqrt({dot('p', 'p')}) as r from m1), m3 as (select *, {proj} from m2),
qn as (select eid, node, w, px / r as x, py / r as y, pz / r as z, w * sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) as jac from m3)"""


def _xyz(p: str) -> str:
    return f"cos(radians({p}lat)) * cos(radians({p}lon)) as x, cos(radians({p}lat)) * sin(radians({p}lon)) as y, sin(radians({p}lat)) as z"


_CHORD = "sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)"
_HAV = """degrees(2 * atan2(sqrt(least(1, sin(radians(s.lat - t.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(t.lat)) * sin(radians(s.lon - t.lon) / 2) ** 2)),
 sqrt(1 - least(1, sin(radians(s.lat - t.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(t.lat)) * sin(radians(s.lon - t.lon) / 2) ** 2))))"""


def _sql_pairs(cloud: str, target: str) -> str:
    return f"s as (select *, {_xyz('')} from ({cloud})), t as (select *, {_xyz('')} from ({target}))"


def _sql_disk(alpha: float, fields: list[str], cloud: str = "", target: str = "") -> str:
    r = f"cast({alpha} as double) * sqrt(t.area / pi())"
    avg = ", ".join(f"avg({f}) as {f}" for f in fields)
    near = ", ".join(f"arg_min({f}, d) as {f}" for f in fields)
    pick = ", ".join(f"coalesce(m.{f}, n.{f}) as {f}" for f in fields)
    return f"""with {_sql_pairs(cloud or _sql_points('orders', 'cloud'), target or _sql_points('part', 'target'))},
d as (select t.tid, {r} as r, s.*, {_CHORD} as d from t, s),
m as (select tid, count(*) as n_matches, {avg} from d where d < 2 * sin(least(r, pi()) / 2) group by tid),
n as (select tid, {near} from d group by tid)
select n.tid, coalesce(n_matches, 0) as n_matches, {pick} from n left join m using (tid)"""


def disk_average(spark, sf):
    return R.disk_average(_points(spark, sf, "orders", "cloud"), _points(spark, sf, "part", "target"), ["v"])


def disk_average_alpha(spark, sf):
    return R.disk_average(_points(spark, sf, "orders", "cloud"), _points(spark, sf, "part", "target"), ["v"], alpha=0.3)


def disk_average_squared(spark, sf):
    c = R.squared_fields(_points(spark, sf, "orders", "cloud").drop("v"), ["u"], ["u"])
    return R.disk_average(c, _points(spark, sf, "part", "target"), ["u", "u_squared"])


def subgrid_variance(spark, sf):
    return R.subgrid_variance(disk_average_squared(spark, sf), "u").select("tid", F.round("u_variance", 3).alias("u_variance"))


def nearest_neighbor(spark, sf):
    return R.nearest(_points(spark, sf, "orders", "cloud"), _points(spark, sf, "part", "target"), ["v"])


def knn_k5(spark, sf):
    return knn(_points(spark, sf, "orders", "cloud"), _points(spark, sf, "part", "target"), 5).select("tid", F.col("rank").cast("long").alias("rank"), "pid")


def radius_match_count(spark, sf):
    t = _points(spark, sf, "part", "target").withColumn("radius", G.area_radius(F.col("area")))
    m = radius_join(_points(spark, sf, "orders", "cloud").select("pid", "lon", "lat"), t)
    return m.groupBy("tid").agg(F.count("*").alias("n_matches"), F.sum("pid").alias("pid_sum"))


def grid_disk_average(spark, sf):
    g, lat, lon = _grid(spark, sf, False)
    return R.disk_average(g, _points(spark, sf, "part", "target"), ["v"], grid=(lat, lon))


def grid_nearest(spark, sf):
    g, lat, lon = _grid(spark, sf, True)
    return R.nearest(g, _points(spark, sf, "part", "target"), ["v"], (lat, lon))


def grid_pole_dedup(spark, sf):
    g, lat, lon = _grid(spark, sf, True)
    t = _points(spark, sf, "part", "target").select("tid", "lon", "lat", (G.area_radius(F.col("area")) * 3).alias("radius"))
    return grid_radius_join(g, t, lat, lon).groupBy("tid").agg(F.count("*").alias("n_matches"), F.sum("pid").alias("pid_sum"))


def self_smooth(spark, sf):
    c = _points(spark, sf, "customer", "cloud")
    return R.self_smooth(c, 50.0 * 4 * math.pi / c.count(), ["v"])


def self_smooth_grid(spark, sf):
    g, lat, lon = _grid(spark, sf, True)
    return R.self_smooth(g, 40.0 * math.pi / (lat.n * lon.n), ["v"], (lat, lon))


def spectral_average(spark, sf):
    return R.spectral_average(_points(spark, sf, "orders", "cloud"), _mesh(spark), ["v"]).select("eid", F.round("v", 1).alias("v"))


def gll_jacobian_area(spark, sf):
    return Q.quad_nodes(_mesh(spark)).groupBy("eid").agg(F.round(F.sum("jac"), 12).alias("area"))


def gll_nodes(spark, sf):
    return Q.quad_nodes(_mesh(spark)).select("eid", F.col("node").cast("long").alias("node"), *[(F.round(c, 10) + 0.0).alias(c) for c in ("x", "y", "z", "jac")])


def rll_to_xyz(spark, sf):
    x, y, z = G.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    return _points(spark, sf, "orders", "cloud").select("pid", F.round(x, 10).alias("x"), F.round(y, 10).alias("y"), F.round(z, 10).alias("z"))


def xyz_to_rll(spark, sf):
    c = _points(spark, sf, "orders", "cloud")
    x, y, z = G.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    lon, lat = G.xyz_to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    return c.select("pid", x.alias("x"), y.alias("y"), z.alias("z")).select("pid", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def haversine(spark, sf):
    c = _points(spark, sf, "orders", "cloud")
    return c.select("pid", F.round(G.haversine_degrees(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(45.0)), 9).alias("degrees"))


def element_centroid(spark, sf):
    return Q.element_centroid(_mesh(spark)).select("eid", *[(F.round(c, 10) + 0.0).alias(c) for c in "xyz"])


def field_stats(spark, sf):
    return R.field_stats(disk_average(spark, sf), ["v"]).select("field", F.round("min", 4).alias("min_v"), F.round("max", 4).alias("max_v"), F.round("mean", 3).alias("mean_v"), F.col("count").alias("n"))


def structured_expand(spark, sf):
    n = _read(spark, sf, "orders").count()
    nlon, nlat = _grid_shape(n)
    p = spark.range(nlon * nlat).withColumnRenamed("id", "pid")
    ilat, ilon = G.grid_indices(F.col("pid"), nlon)
    return p.select("pid", F.round(F.lit(-90.0) + (ilat + 0.5) * 180.0 / nlat, 9).alias("lat"), F.round((ilon + 0.5) * 360.0 / nlon, 9).alias("lon"))


def typed_cast(spark, sf):
    c = _read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("pid"), F.col("o_totalprice").cast("double").alias("v"), (F.col("o_totalprice") / 1000.0 - 200.0).cast("double").alias("w"))
    return R.typed_cast(c, {"v": "int", "w": "smallint"}).select("pid", F.col("v").cast("long").alias("v"), F.col("w").cast("long").alias("w"))


def axis_summary(spark, sf):
    g, _, _ = _grid(spark, sf, False)
    return A.axis_summary(g).select("axis", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "spacing")], "n")


def axis_recovery(spark, sf):
    g, _, _ = _grid(spark, sf, False)
    return A.recover_axes(g.select("pid", "lon", "lat")).select("pid", "ilat", "ilon")


def nearest_axis_index(spark, sf):
    _, lat, lon = _grid(spark, sf, False)
    return _points(spark, sf, "part", "target").select("tid", A.nearest_index(lat, F.col("lat")).alias("ilat"), A.nearest_index(lon, F.col("lon")).alias("ilon"))


def radius_knn_k3(spark, sf):
    t = _points(spark, sf, "part", "target").withColumn("radius", G.area_radius(F.col("area"), 0.5))
    m = radius_knn(_points(spark, sf, "orders", "cloud").select("pid", "lon", "lat"), t, 3)
    return m.select("tid", F.col("rank").cast("long").alias("rank"), "pid")


def grid_pole_query(spark, sf):
    g, lat, lon = _grid(spark, sf, True)
    t = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(POLE_TARGETS)], "tid long, lon double, lat double, radius double")
    return grid_radius_join(g, t, lat, lon, compat=True).groupBy("tid").agg(F.count("*").alias("n_matches"), F.sum("pid").alias("pid_sum"))


def gll_bubble_area(spark, sf):
    return Q.quad_nodes(_mesh(spark), bubble=True).groupBy("eid").agg(F.round(F.sum("jac"), 10).alias("area"))


def chord_angle(spark, sf):
    t = _points(spark, sf, "part", "target").select("tid", G.area_radius(F.col("area")).alias("radius"))
    t = t.withColumn("chord", G.angle_to_chord(F.col("radius"))).withColumn("angle", G.chord_to_angle(F.col("chord")))
    return t.select("tid", *[F.round(c, 10).alias(c) for c in ("radius", "chord", "angle")])


def great_circle(spark, sf):
    p, q = G.lonlat_to_xyz(F.col("lon"), F.col("lat")), G.lonlat_to_xyz(F.lit(10.0), F.lit(45.0))
    return _points(spark, sf, "orders", "cloud").select("pid", F.round(G.great_circle(*p, *q, radius=G.EARTH_KM), 4).alias("km"))


def cloud_as_target(spark, sf):
    c = _points(spark, sf, "customer", "cloud").withColumn("area", F.when(F.col("v") > 0, F.col("v") / 1e9))
    return R.as_target(c, 0.001).select("tid", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round("area", 12).alias("area"))


def error_count(spark, sf):
    c = _points(spark, sf, "customer", "cloud").select(F.col("pid").alias("tid"), F.when(F.col("v") > 0, F.col("v")).alias("v"), F.lit(1.0).alias("one"))
    return R.error_count(c, ["v", "one"])


def knn_grid_k5(spark, sf):
    _, lat, lon = _grid(spark, sf, True)
    return grid_knn(_points(spark, sf, "part", "target"), lat, lon, 5).select("tid", F.col("rank").cast("long").alias("rank"), "pid")


def _uneven(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid]:
    """The grid with rows of equal area, whose latitudes are not evenly spaced."""
    g, lat, lon = _grid(spark, sf, False)
    g = g.withColumn("lat", F.degrees(F.asin((F.col("ilat") + 0.5) * 2.0 / lat.n - 1.0)))
    return g, Grid.of([math.degrees(math.asin((k + 0.5) * 2.0 / lat.n - 1.0)) for k in range(lat.n)], [lon.first + k * lon.step for k in range(lon.n)])


def grid_uneven(spark, sf):
    g, axes = _uneven(spark, sf)
    return R.disk_average(g, _points(spark, sf, "part", "target"), ["v"], grid=axes)


def spectral_grid(spark, sf):
    g, lat, lon = _grid(spark, sf, True)
    return R.spectral_average(g, _mesh(spark), ["v"], grid=(lat, lon)).select("eid", F.round("v", 1).alias("v"))


def element_nearest(spark, sf):
    return R.element_average(_points(spark, sf, "orders", "cloud"), _mesh(spark), ["v"], "nn")


def brute_force_nearest(spark, sf):
    return linear_nearest(_points(spark, sf, "customer", "cloud"), _points(spark, sf, "supplier", "target")).select("tid", "pid")


def bounding_box(spark, sf):
    return R.bounding_box(_points(spark, sf, "customer", "cloud")).select(*[F.round(c, 9).alias(c) for c in ("lon_lo", "lon_hi", "lat_lo", "lat_hi")])


def metric_distance(spark, sf):
    at = [F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(45.0)]
    return _points(spark, sf, "orders", "cloud").select("pid", *[F.round(G.distance(m, *at), 9).alias(m) for m in ("haversine", "cartesian")])


def sample_values(spark, sf):
    return R.sample_values(disk_average(spark, sf), "tid", ["v"])


def _nc_path(spark: SparkSession, name: str) -> str:
    """A new NetCDF file in the shared folder, as the machines that mount it see it."""
    path = urlparse(shared_path(spark, name)).path + ".nc"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _nc_grid(spark: SparkSession, sf: str, poles: bool) -> tuple[str, Axis, Axis]:
    g, lat, lon = _grid(spark, sf, poles)
    path = _nc_path(spark, "grid")
    axes = {n: [a.first + k * a.step for k in range(a.n)] for n, a in (("lat", lat), ("lon", lon))}
    sinks.write_new_netcdf(g.withColumnRenamed("v", "htopo"), path, {"lat": lat.n, "lon": lon.n}, {"htopo": "f8"}, "pid", axes, {"title": "orders"})
    return path, lat, lon


def _nc_cloud(spark: SparkSession, sf: str, table: str, kind: str, dim: str, names: dict[str, str]) -> str:
    """A file of points; names: the variables of lon, lat and other columns."""
    p, key = _points(spark, sf, table, kind), "pid" if kind == "cloud" else "tid"
    path = _nc_path(spark, table)
    sinks.write_new_netcdf(p.withColumnsRenamed(names), path, {dim: p.count()}, {names.get(c, c): "f8" for c in p.columns if c != key}, key)
    return path


def netcdf_structured(spark, sf):
    s = ncgrid.load_source(spark, _nc_grid(spark, sf, False)[0], retain=True)
    return s.cloud.select("pid", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "htopo")


def netcdf_scrip(spark, sf):
    path = _nc_cloud(spark, sf, "customer", "cloud", "grid_size", {"lon": "grid_center_lon", "lat": "grid_center_lat"})
    return ncgrid.load_cloud(spark, path).select("pid", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "v")


def netcdf_columns(spark, sf):
    path = _nc_cloud(spark, sf, "customer", "cloud", "grid_size", {})
    return ncgrid.load_cloud(spark, path, ["v"]).select("pid", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "v")


def netcdf_generic(spark, sf):
    path = _nc_cloud(spark, sf, "orders", "cloud", "n", {"lon": "xc", "lat": "yc"})
    return ncgrid.load_cloud(spark, path, ["u", "v"]).select("pid", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "u", "v")


def netcdf_target(spark, sf):
    path = _nc_cloud(spark, sf, "part", "target", "ncol", {})
    return ncgrid.load_target(spark, path).select("tid", *[F.round(c, 9).alias(c) for c in ("lon", "lat", "area")])


def netcdf_in_place(spark, sf):
    """Smoothed values written over a copy of their own file, in its types."""
    p = _points(spark, sf, "customer", "cloud")
    first, again = _nc_path(spark, "first"), _nc_path(spark, "again")
    sinks.write_new_netcdf(p.withColumnsRenamed({"lon": "x", "lat": "y"}), first, {"n": p.count()}, {"x": "f8", "y": "f8", "v": "i4"}, "pid")
    sinks.write_netcdf(p.select("pid", (F.col("v") / 4.0).alias("v")), first, again, ["v"], "pid", in_place=True)
    return ncgrid.load_cloud(spark, again).select("pid", "v")


def _run(spark: SparkSession, *argv: str) -> str:
    from .. import cli

    out = _nc_path(spark, "out")
    cli.run(spark, [*argv, "--output", out])
    return out


def command_line_grid(spark, sf):
    """From a file of a grid and a file of targets to a file, by the command line."""
    target = _nc_cloud(spark, sf, "part", "target", "ncol", {})
    out = _run(spark, "--source", _nc_grid(spark, sf, False)[0], "--target", target, "--square-fields", "htopo")
    return ncgrid.load_cloud(spark, out, ["htopo", "htopo_squared"]).select(F.col("pid").alias("tid"), "htopo", F.round(F.col("htopo_squared") / 1e6, 3).alias("htopo_squared"))


def command_line_smooth(spark, sf):
    path, lat, lon = _nc_grid(spark, sf, True)
    out = _run(spark, "--source", path, "--reuse-source-mesh", "--smoothing-area", repr(40.0 * math.pi / (lat.n * lon.n)))
    return ncgrid.load_cloud(spark, out).select("pid", F.col("htopo").alias("v"))


def _sql_grid_disk(grid: str, target: str, radius: str, extra: str) -> str:
    return f"""with s0 as ({grid}), t as ({target}), m0 as (select t.tid, s.*, {_HAV} as d, {radius} as r from t, s0 s),
m1 as (select *, row_number() over (partition by tid, ilat order by ilon) as nth from m0 where d <= degrees(r)),
m as (select * from m1 where abs(abs(lat) - 90) >= 1e-6 or nth = 1) {extra}"""


def oracles() -> dict[str, str]:
    cloud, target = _sql_points("orders", "cloud"), _sql_points("part", "target")
    r = "sqrt(t.area / pi())"
    self_t = f"select pid as tid, lat, lon, cast(50.0 as double) * 4 * pi() / (select count(*) from customer) as area from ({_sql_points('customer', 'cloud')})"
    grid_t = f"select pid as tid, lat, lon, cast(40.0 as double) * pi() / (select count(*) from s0) as area from s0"
    norm = "sqrt(mx * mx + my * my + mz * mz)"
    sums = ", ".join(f"({c}0 + {c}1 + {c}2 + {c}3) / 4 as m{c}" for c in "xyz")
    pole_t = "select * from (values " + ", ".join(f"({k}, cast({a} as double), cast({b} as double), cast({c} as double))" for k, (a, b, c) in enumerate(POLE_TARGETS)) + ") as v(tid, lon, lat, radius)"
    side = lambda i, j: f"acos(greatest(-1, least(1, x{i} * x{j} + y{i} * y{j} + z{i} * z{j})))"
    lhuilier = lambda a, b, c: f"4 * atan(sqrt(greatest(0, tan(({a} + {b} + {c}) / 4) * tan(({b} + {c} - {a}) / 4) * tan(({a} + {c} - {b}) / 4) * tan(({a} + {b} - {c}) / 4))))"
    hav_node = _HAV.replace("t.", "qn.")
    uneven = f"select pid, ilat, ilon, degrees(asin((ilat + cast(0.5 as double)) * 2 / (max(ilat) over () + 1) - 1)) as lat, lon, v from ({_sql_grid(False)})"
    both = "n as (select tid, arg_min(v, d) as v from m0 group by tid), a as (select tid, count(*) as n_matches, avg(v) as v, avg(v * v) as w from m group by tid)"
    points = lambda c: f"select pid, round(lon, 9) as lon, round(lat, 9) as lat, v from ({c})"
    return {
        "knn_grid_k5": f"with s0 as ({_sql_grid(True)}), t as ({target}) select tid, rank, pid from (select tid, pid, row_number() over (partition by tid order by round(d, 9), pid) as rank from (select t.tid, s.pid, {_HAV} as d from t, s0 s)) where rank <= 5",
        "grid_uneven": _sql_grid_disk(uneven, target, r, f", {both} select n.tid, coalesce(n_matches, 0) as n_matches, coalesce(a.v, n.v) as v from n left join a using (tid)"),
        "spectral_grid": f"""with {_sql_nodes()}, qt as (select *, degrees(asin(z)) as lat, degrees(atan2(y, x)) as lon from qn), s0 as ({_sql_grid(True)}),
d as (select qn.eid, qn.node, qn.w, qn.jac, s.ilat, s.ilon, s.lat, s.v, {hav_node} as d from qt qn, s0 s),
h as (select *, row_number() over (partition by eid, node, ilat order by ilon) as nth from d where d <= degrees(jac)),
hm as (select eid, node, avg(v) as v from h where abs(abs(lat) - 90) >= 1e-6 or nth = 1 group by eid, node),
k as (select eid, node, any_value(w) as w, arg_min(v, {{'d': round(d, 12), 'i': ilat, 'j': ilon}}) as near from d group by eid, node)
select cast(eid as bigint) as eid, round(sum(w * coalesce(v, near)) / sum(w), 1) as v from k left join hm using (eid, node) group by eid""",
        "element_nearest": f"""with {_sql_mesh()}, q as (select eid, {sums} from mesh), t as (select eid as tid, mx / {norm} as x, my / {norm} as y, mz / {norm} as z from q), s as (select *, {_xyz('')} from ({cloud}))
select cast(tid as bigint) as eid, arg_min(v, d) as v from (select t.tid, s.v, {_CHORD} as d from t, s) group by tid""",
        "brute_force_nearest": f"with {_sql_pairs(_sql_points('customer', 'cloud'), _sql_points('supplier', 'target'))} select tid, arg_min(pid, d) as pid from (select t.tid, s.pid, {_CHORD} as d from t, s) group by tid",
        "bounding_box": f"select round(min(lon), 9) as lon_lo, round(max(lon), 9) as lon_hi, round(min(lat), 9) as lat_lo, round(max(lat), 9) as lat_hi from ({_sql_points('customer', 'cloud')})",
        "metric_distance": f"with {_sql_pairs(cloud, 'select cast(10 as double) as lon, cast(45 as double) as lat')} select pid, round({_HAV}, 9) as haversine, round({_CHORD}, 9) as cartesian from s, t",
        "sample_values": f"select tid, v from ({_sql_disk(1.0, ['v'])}) order by tid limit 5",
        "netcdf_structured": f"select pid, round(lon, 9) as lon, round(lat, 9) as lat, v as htopo from ({_sql_grid(False)})",
        "netcdf_scrip": points(_sql_points("customer", "cloud")),
        "netcdf_columns": points(_sql_points("customer", "cloud")),
        "netcdf_generic": f"select pid, round(lon, 9) as lon, round(lat, 9) as lat, u, v from ({cloud})",
        "netcdf_target": f"select tid, round(lon, 9) as lon, round(lat, 9) as lat, round(area, 9) as area from ({target})",
        "netcdf_in_place": f"select pid, trunc(v / 4) as v from ({_sql_points('customer', 'cloud')})",
        "command_line_grid": _sql_grid_disk(_sql_grid(False), target, r, f", {both} select n.tid, coalesce(a.v, n.v) as htopo, round(coalesce(a.w, n.v * n.v) / 1e6, 3) as htopo_squared from n left join a using (tid)"),
        "command_line_smooth": _sql_grid_disk(_sql_grid(True), grid_t, r, "select tid as pid, avg(v) as v from m group by tid"),
        "axis_summary": f"with g as ({_sql_grid(False)}), l as (select 'lat' as axis, lat as v from g union select 'lon', lon from g) select axis, round(min(v), 9) as lo, round(max(v), 9) as hi, round((max(v) - min(v)) / (count(*) - 1), 9) as spacing, count(*) as n from l group by axis",
        "axis_recovery": f"select pid, dense_rank() over (order by lat) - 1 as ilat, dense_rank() over (order by lon) - 1 as ilon from ({_sql_grid(False)})",
        "nearest_axis_index": f"""with g as ({_sql_grid(False)}), t as ({target}), la as (select distinct ilat, lat from g), lo as (select distinct ilon, lon from g)
select tid, (select arg_min(ilat, {{'d': abs(la.lat - t.lat), 'i': ilat}}) from la) as ilat, (select arg_min(ilon, {{'d': abs(lo.lon - t.lon), 'i': ilon}}) from lo) as ilon from t""",
        "radius_knn_k3": f"with {_sql_pairs(cloud, target)} select tid, rank, pid from (select tid, pid, row_number() over (partition by tid order by d, pid) as rank from (select t.tid, s.pid, {_CHORD} as d, cast(0.5 as double) * {r} as r from t, s) where d < 2 * sin(least(r, pi()) / 2)) where rank <= 3",
        "grid_pole_query": f"""with s0 as ({_sql_grid(True)}), t as ({pole_t}), m0 as (select t.tid, t.lat as t_lat, t.radius, s.*, max(ilat) over () as top, {_HAV} as d from t, s0 s),
m1 as (select *, row_number() over (partition by tid, ilat order by ilon) as nth from m0 where abs(t_lat) <> 90 and d <= degrees(radius)),
m as (select tid, pid from m1 where abs(abs(lat) - 90) >= 1e-6 or nth = 1 union all select tid, pid from m0 where abs(t_lat) = 90 and ilat = case when t_lat > 0 then top else 0 end)
select cast(tid as bigint) as tid, count(*) as n_matches, cast(sum(pid) as bigint) as pid_sum from m group by tid""",
        "gll_bubble_area": f"with {_sql_mesh()} select cast(eid as bigint) as eid, round({lhuilier(side(0, 1), side(1, 2), side(2, 0))} + {lhuilier(side(0, 2), side(2, 3), side(3, 0))}, 10) as area from mesh",
        "chord_angle": f"select tid, round({r}, 10) as radius, round(2 * sin({r} / 2), 10) as chord, round({r}, 10) as angle from ({target}) t",
        "great_circle": f"with s as (select * from ({cloud})), t as (select cast(10 as double) as lon, cast(45 as double) as lat) select pid, round(radians({_HAV}) * cast({G.EARTH_KM} as double), 4) as km from s, t",
        "cloud_as_target": f"select pid as tid, round(lon, 9) as lon, round(lat, 9) as lat, round(case when v > 0 then v / cast(1e9 as double) else cast(0.001 as double) end, 12) as area from ({_sql_points('customer', 'cloud')})",
        "error_count": "select unnest(['v', 'one']) as field, unnest([count(*) filter (not (cast(round(c_acctbal * 100) as bigint) > 0)), 0]) as n_errors from customer",
        "disk_average": _sql_disk(1.0, ["v"]),
        "disk_average_alpha": _sql_disk(0.3, ["v"]),
        "disk_average_squared": _sql_disk(1.0, ["u", "u_squared"], cloud=f"select pid, lat, lon, u, u * u as u_squared from ({cloud})"),
        "subgrid_variance": "select tid, round(u_squared - u * u, 3) as u_variance from (" + _sql_disk(1.0, ["u", "u_squared"], cloud=f"select pid, lat, lon, u, u * u as u_squared from ({cloud})") + ")",
        "nearest_neighbor": f"with {_sql_pairs(cloud, target)} select tid, arg_min(v, d) as v from (select t.tid, s.v, {_CHORD} as d from t, s) group by tid",
        "knn_k5": f"with {_sql_pairs(cloud, target)} select tid, rank, pid from (select tid, pid, row_number() over (partition by tid order by d, pid) as rank from (select t.tid, s.pid, {_CHORD} as d from t, s)) where rank <= 5",
        "radius_match_count": f"with {_sql_pairs(cloud, target)} select t.tid, count(*) as n_matches, cast(sum(s.pid) as bigint) as pid_sum from t, s where {_CHORD} < 2 * sin(least({r}, pi()) / 2) group by t.tid",
        "grid_disk_average": _sql_grid_disk(_sql_grid(False), target, r, ", n as (select tid, arg_min(v, d) as v from m0 group by tid), a as (select tid, count(*) as n_matches, avg(v) as v from m group by tid) select n.tid, coalesce(n_matches, 0) as n_matches, coalesce(a.v, n.v) as v from n left join a using (tid)"),
        "grid_nearest": f"with s0 as ({_sql_grid(True)}), t as ({target}) select tid, arg_min(v, {{'d': round(d, 12), 'p': pid}}) as v from (select t.tid, s.pid, s.v, {_HAV} as d from t, s0 s) group by tid",
        "grid_pole_dedup": _sql_grid_disk(_sql_grid(True), target, f"3 * {r}", "select tid, count(*) as n_matches, cast(sum(pid) as bigint) as pid_sum from m group by tid"),
        "self_smooth": _sql_disk(1.0, ["v"], _sql_points("customer", "cloud"), self_t).replace("select n.tid,", "select n.tid as pid,"),
        "self_smooth_grid": _sql_grid_disk(_sql_grid(True), grid_t, r, "select tid as pid, count(*) as n_matches, avg(v) as v from m group by tid"),
        "spectral_average": f"""with {_sql_nodes()}, s as (select *, {_xyz('')} from ({cloud})),
d as (select eid, node, w, jac, s.v, {_CHORD.replace('t.', 'qn.')} as d from qn, s),
k as (select eid, node, any_value(w) as w, coalesce(avg(v) filter (d < 2 * sin(least(jac, pi()) / 2)), arg_min(v, d)) as v from d group by eid, node)
select cast(eid as bigint) as eid, round(sum(w * v) / sum(w), 1) as v from k group by eid""",
        "gll_jacobian_area": f"with {_sql_nodes()} select cast(eid as bigint) as eid, round(sum(jac), 12) as area from qn group by eid",
        "gll_nodes": f"with {_sql_nodes()} select cast(eid as bigint) as eid, cast(node as bigint) as node, " + ", ".join(f"round({c}, 10) + cast(0 as double) as {c}" for c in ("x", "y", "z", "jac")) + " from qn",
        "rll_to_xyz": f"select pid, round(x, 10) as x, round(y, 10) as y, round(z, 10) as z from (select pid, {_xyz('')} from ({cloud}))",
        "xyz_to_rll": f"select pid, round(lon, 7) as lon, round(lat, 7) as lat from ({cloud})",
        "haversine": f"with s as (select * from ({cloud})), t as (select cast(10 as double) as lon, cast(45 as double) as lat) select pid, round({_HAV}, 9) as degrees from s, t",
        "element_centroid": f"with {_sql_mesh()} select cast(eid as bigint) as eid, " + ", ".join(f"round(m{c} / {norm}, 10) + cast(0 as double) as {c}" for c in "xyz") + f" from (select eid, {sums} from mesh)",
        "field_stats": "select 'v' as field, round(min(v), 4) as min_v, round(max(v), 4) as max_v, round(avg(v), 3) as mean_v, count(v) as n from (" + _sql_disk(1.0, ["v"]) + ")",
        "structured_expand": f"select pid, round(lat, 9) as lat, round(lon, 9) as lon from ({_sql_grid(False)})",
        "typed_cast": "select cast(o_orderkey as bigint) as pid, cast(trunc(cast(o_totalprice as double)) as bigint) as v, cast(trunc(cast(o_totalprice / 1000.0 - 200.0 as double)) as bigint) as w from orders",
    }


QUERIES = {f.__name__: f for f in (
    disk_average, disk_average_alpha, disk_average_squared, subgrid_variance, nearest_neighbor, knn_k5, radius_match_count, grid_disk_average, grid_nearest,
    grid_pole_dedup, self_smooth, self_smooth_grid, spectral_average, gll_jacobian_area, gll_nodes, rll_to_xyz, xyz_to_rll, haversine, element_centroid,
    field_stats, structured_expand, typed_cast, axis_summary, axis_recovery, nearest_axis_index, radius_knn_k3, grid_pole_query, gll_bubble_area, chord_angle,
    great_circle, cloud_as_target, error_count, knn_grid_k5, grid_uneven, spectral_grid, element_nearest, brute_force_nearest, bounding_box, metric_distance,
    sample_values, netcdf_structured, netcdf_scrip, netcdf_columns, netcdf_generic, netcdf_target, netcdf_in_place, command_line_grid, command_line_smooth)}
