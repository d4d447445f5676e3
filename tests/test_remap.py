import math
import random

import numpy as np
import pytest
from conftest import SF, run_duckdb, same
from pyspark.sql import functions as F

from sphereweave import cli
from sphereweave.functions import geometry as G
from sphereweave.operators import axes as A
from sphereweave.operators import quadrature as Q
from sphereweave.operators import remap as R
from sphereweave.operators.nearest import grid_nearest, knn, linear_nearest, radius_knn
from sphereweave.operators.radius import Axis, Grid, grid_radius_join, radius_join
from sphereweave.plans import queries
from sphereweave.sources import ncgrid, netcdf3, sinks


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), run_duckdb(queries.oracles()[name]))


def cloud_of(spark, rows):
    return spark.createDataFrame(rows, "pid long, lon double, lat double, v double")


def target_of(spark, rows):
    return spark.createDataFrame(rows, "tid long, lon double, lat double, radius double")


def chord(a, b):
    p, q = ([math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))] for lo, la in (a, b))
    return math.dist(p, q)


def random_points(n, seed):
    r = random.Random(seed)
    return [(r.uniform(-180, 360), r.choice([r.uniform(-90, 90), r.uniform(88, 90), r.uniform(-90, -88)])) for _ in range(n)]


def test_range_and_nearest_against_brute_force(spark):
    src = [(i, *p, float(i)) for i, p in enumerate(random_points(150, 1))]
    tgt = [(i, *p, r) for i, (p, r) in enumerate(zip(random_points(60, 2), [0.02, 0.1, 0.5, 2.0, 4.0, 0.0] * 10))]
    c, t = cloud_of(spark, src), target_of(spark, tgt)
    found = {(r.tid, r.pid) for r in radius_join(c, t).collect()}
    assert found == {(x[0], s[0]) for x in tgt for s in src if x[3] > 0 and chord(x[1:3], s[1:3]) < 2 * math.sin(min(x[3], math.pi) / 2)}
    near = {(r.tid, r["rank"]): r.pid for r in knn(c, t, 3).collect()}
    for x in tgt:
        d = sorted((chord(x[1:3], s[1:3]), s[0]) for s in src)[:3]
        assert [near[(x[0], k)] for k in (1, 2, 3)] == [p for _, p in d]


def test_means_are_monotone_and_keep_constants(spark):
    src = [(i, *p, 5.0) for i, p in enumerate(random_points(80, 3))]
    tgt = [(i, *p, r) for i, (p, r) in enumerate(zip(random_points(30, 4), [0.05, float("nan"), -1.0] * 10))]
    out = R.disk_average(cloud_of(spark, src), target_of(spark, tgt), ["v"]).collect()
    assert len(out) == 30 and all(r.v == 5.0 for r in out)


def test_empty_cloud_and_missing_field_raise(spark):
    c, t = cloud_of(spark, []), target_of(spark, [(0, 0.0, 0.0, 0.1)])
    with pytest.raises(ValueError):
        R.disk_average(c, t, ["v"])
    with pytest.raises(ValueError):
        R.disk_average(c, t, ["w"])
    with pytest.raises(ValueError):
        R.squared_fields(c, ["w"], ["v"])


def grid_of(spark, nlat, nlon, first, poles):
    la = [-90 + k * 180 / (nlat - 1) for k in range(nlat)] if poles else [-90 + (k + 0.5) * 180 / nlat for k in range(nlat)]
    lo = [first + k * 360 / nlon for k in range(nlon)]
    rows = [(i * nlon + j, i, j, lo[j], la[i], float(i * nlon + j)) for i in range(nlat) for j in range(nlon)]
    return spark.createDataFrame(rows, "pid long, ilat long, ilon long, lon double, lat double, v double"), rows, Axis.of(la), Axis.of(lo)


def hav(a, b):
    return math.degrees(2 * math.asin(min(1, chord(a, b) / 2)))


@pytest.mark.parametrize("poles,first", [(True, 0.0), (False, 5.0), (True, -180.0)])
def test_grid_joins_against_brute_force(spark, poles, first):
    g, rows, lat, lon = grid_of(spark, 19, 36, first, poles)
    tgt = [(i, *p, r) for i, (p, r) in enumerate(zip(random_points(40, 5), [0.11, 0.3, 1.0, 3.2] * 10))] + [(40, 77.0, 90.0, 0.21), (41, 359.91, 0.03, 0.05)]
    t = target_of(spark, tgt)
    found = {(r.tid, r.pid) for r in grid_radius_join(g, t, lat, lon).collect()}
    want = set()
    for x in tgt:
        seen = set()
        for pid, i, j, lo, la, _ in rows:
            if hav(x[1:3], (lo, la)) <= math.degrees(x[3]):
                if abs(abs(la) - 90) < 1e-6:
                    if i in seen:
                        continue
                    seen.add(i)
                want.add((x[0], pid))
    assert found == want
    best = {r.tid: r.dist for r in grid_nearest(t, lat, lon).collect()}
    for x in tgt:
        assert abs(best[x[0]] - min(hav(x[1:3], (r[3], r[4])) for r in rows)) < 1e-5


def test_pole_target_in_compat_mode_takes_the_extreme_row(spark):
    g, rows, lat, lon = grid_of(spark, 19, 36, 0.0, True)
    t = target_of(spark, [(0, 10.0, 90.0, 0.5)])
    assert {r.ilat for r in grid_radius_join(g, t, lat, lon, compat=True).collect()} == {18}
    assert grid_radius_join(g, t, lat, lon, compat=True).count() == 36


def test_self_smoothing_holds_and_bad_area_raises(spark):
    c = cloud_of(spark, [(i, *p, float(i)) for i, p in enumerate(random_points(40, 6))])
    out = {r.pid: r.v for r in R.self_smooth(c, 1e-9, ["v"]).collect()}
    assert out == {i: float(i) for i in range(40)}
    with pytest.raises(ValueError):
        R.self_smooth(c, 0.0, ["v"])


def test_quadrature():
    for n in range(2, 11):
        x, w = Q.gauss_lobatto(n, -1.0, 1.0)
        for p in range(2 * n - 2):
            assert abs(sum(b * a ** p for a, b in zip(x, w)) - (0 if p % 2 else 2 / (p + 1))) < 1e-13
    with pytest.raises(ValueError):
        Q.gauss_lobatto(11)


def test_bubble_gives_the_exact_sphere_and_bad_quads_raise(spark):
    m = queries._mesh(spark)
    assert abs(Q.quad_nodes(m, bubble=True).agg(F.sum("jac")).first()[0] - 4 * math.pi) < 1e-9
    assert Q.is_spectral(m)
    bad = spark.createDataFrame([(0, [(1.0, 0.0, 0.0)] * 3)], m.schema)
    with pytest.raises(Exception):
        Q.quad_nodes(bad).collect()


def test_geometry_at_poles_and_seam(spark):
    r = spark.createDataFrame([(0.0, 0.0, -2.0), (0.0, -1.0, 0.0)], "x double, y double, z double")
    lon, lat = G.xyz_to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    assert [tuple(x) for x in r.select(lon, lat).collect()] == [(0.0, -90.0), (270.0, 0.0)]
    assert spark.range(1).select(G.normalize_longitude(F.lit(-90.0))).first()[0] == 270.0


def test_validation_stats_and_methods(spark):
    bad = spark.createDataFrame([(0, float("inf"))], "tid long, v double")
    with pytest.raises(ValueError):
        R.validate(bad, ["v"])
    with pytest.raises(ValueError):
        R.remap(bad, bad, ["v"], "no such")
    assert R.typed_cast(spark.createDataFrame([(-1.9,)], "v double"), {"v": "int"}).first()[0] == -1


def nc(path, dims, variables):
    netcdf3.write_file(str(path), dims, [(n, d, np.asarray(a)) for n, d, a in variables])
    return str(path)


def test_netcdf_formats(spark, tmp_path):
    lon, lat = np.array([0.0, 120.0, 240.0]), np.array([-45.0, 45.0])
    z = np.arange(6, dtype=np.float32).reshape(2, 3)
    p = nc(tmp_path / "grid.nc", {"lat": 2, "lon": 3}, [("lat", ["lat"], lat), ("lon", ["lon"], lon), ("terr", ["lat", "lon"], z), ("LANDFRAC", ["lat", "lon"], z * 0)])
    df = ncgrid.load_cloud(spark, p, rows_per_partition=3)
    assert df.columns == ["pid", "lon", "lat", "terr", "LANDFRAC"]
    assert [tuple(r)[:4] for r in df.orderBy("pid").collect()] == [(k, lon[k % 3], lat[k // 3], float(k)) for k in range(6)]
    s = nc(tmp_path / "scrip.nc", {"grid_size": 3}, [("grid_center_lat", ["grid_size"], np.zeros(3)), ("grid_center_lon", ["grid_size"], lon), ("f", ["grid_size"], np.array([1, 2, -9], np.int32))])
    assert [r.f for r in ncgrid.load_cloud(spark, s, fill_value=-9).orderBy("pid").collect()] == [1.0, 2.0, None]
    g = nc(tmp_path / "gen.nc", {"j": 2, "i": 3}, [("xc", ["j", "i"], z.astype("f8")), ("yc", ["j", "i"], z.astype("f8")), ("q", ["j", "i"], z), ("xv", ["j"], lat)])
    assert ncgrid.load_cloud(spark, g).columns == ["pid", "lon", "lat", "q"]
    with pytest.raises(Exception):
        ncgrid.load_cloud(spark, g, ["none"]).collect()
    with pytest.raises(ValueError):
        ncgrid.load_target(spark, g)
    bad = tmp_path / "x.nc"
    bad.write_bytes(b"\x89HDF\r\n")
    with pytest.raises(ValueError):
        netcdf3.read_header(open(bad, "rb"))


def test_command_line_and_sink(spark, tmp_path):
    src = nc(tmp_path / "s.nc", {"n": 4}, [("lon", ["n"], np.array([0.0, 90, 180, 270])), ("lat", ["n"], np.zeros(4)), ("f", ["n"], np.array([1, 2, 3, 4], np.int16))])
    tgt = nc(tmp_path / "t.nc", {"ncol": 2}, [("lon", ["ncol"], np.array([1.0, 181.0])), ("lat", ["ncol"], np.zeros(2)), ("area", ["ncol"], np.array([0.1, 0.1]))])
    out = str(tmp_path / "o.nc")
    cli.run(spark, ["--source", src, "--target", tgt, "--output", out, "--square-fields", "f"])
    with open(out, "rb") as f:
        h = netcdf3.read_header(f)
        assert netcdf3.read_slab(f, h, "f", 0, 2).tolist() == [1.0, 3.0] and netcdf3.read_slab(f, h, "f_squared", 0, 2).tolist() == [1.0, 9.0]
    back = str(tmp_path / "b.nc")
    sinks.write_netcdf(spark.createDataFrame([(k, 7.9) for k in range(4)], "pid long, f double"), src, back, ["f"], "pid", in_place=True)
    with open(back, "rb") as f:
        h = netcdf3.read_header(f)
        assert netcdf3.read_slab(f, h, "f", 0, 4).tolist() == [7] * 4
    for argv in (["--source", src], ["--source", src, "--target", tgt, "--remap-method", "zz"], ["--source", src, "--reuse-source-mesh"]):
        with pytest.raises(ValueError):
            cli.run(spark, argv)
    assert cli.run(spark, ["--source", src, "--target", tgt]).count() == 4


def test_axes_of_points(spark):
    g, rows, lat, lon = grid_of(spark, 5, 8, -180.0, True)
    got = A.recover_axes(g.select("pid", "lon", "lat", "v").orderBy(F.desc("v")))
    assert {(r.pid, r.ilat, r.ilon) for r in got.collect()} == {(r[0], r[1], r[2]) for r in rows}
    for bad in (g.where("pid <> 3"), g.union(g.where("pid = 3"))):
        with pytest.raises(ValueError):
            A.recover_axes(bad.drop("ilat", "ilon"))
    with pytest.raises(ValueError):
        A.recover_axes(g.drop("ilat", "ilon"), max_axis=4)
    assert A.recover_axes(g.where("pid < 0").drop("ilat", "ilon")).count() == 0
    assert [tuple(r) for r in A.axis_summary(g).collect()] == [("lat", -90.0, 90.0, 5, 45.0), ("lon", -180.0, 135.0, 8, 45.0)]
    assert [tuple(r)[1:] for r in A.axis_summary(g.where("pid < 0")).collect()] == [(None, None, 0, None)] * 2
    v = spark.createDataFrame([(-200.0,), (-90.0,), (-67.5,), (-67.4,), (0.0,), (95.0,), (None,)], "v double")
    assert [r[0] for r in v.select(A.nearest_index(lat, F.col("v"))).collect()] == [0, 0, 0, 1, 2, 4, None]


def test_radius_limited_nearest_and_errors(spark):
    src = [(i, *p, float(i)) for i, p in enumerate(random_points(120, 7))]
    tgt = [(i, *p, r) for i, (p, r) in enumerate(zip(random_points(40, 8), [0.1, 0.6, 3.0, 0.0] * 10))]
    found = {(r.tid, r["rank"]): r.pid for r in radius_knn(cloud_of(spark, src), target_of(spark, tgt), 2).collect()}
    want = {}
    for x in tgt:
        near = sorted((d, s[0]) for s in src if (d := chord(x[1:3], s[1:3])) < 2 * math.sin(min(x[3], math.pi) / 2))
        want |= {(x[0], k + 1): p for k, (_, p) in enumerate(near[:2])}
    assert found == want
    out = spark.createDataFrame([(0, 1.0, None), (1, float("nan"), 2.0), (2, float("inf"), 3.0)], "tid long, a double, b double")
    assert {tuple(r) for r in R.error_count(out, ["a", "b"]).collect()} == {("a", 2), ("b", 1)}
    t = R.as_target(spark.createDataFrame([(1, 0.0, 0.0, None), (2, 0.0, 0.0, 0.5)], "pid long, lon double, lat double, area double"), 0.1)
    assert {tuple(r) for r in t.collect()} == {(1, 0.0, 0.0, 0.1), (2, 0.0, 0.0, 0.5)} and R.as_target(t.withColumnRenamed("tid", "pid").drop("area"), 2.0).first()["area"] == 2.0


def test_nearest_in_a_regional_cloud_with_copies_and_far_targets(spark):
    r = random.Random(9)
    src = [(i, 10 + r.random() * 0.2, 45 + r.random() * 0.2, float(i)) for i in range(3000)] + [(3000 + i, 10.1, 45.1, 0.0) for i in range(300)]
    tgt = [(i, *p, 0.1) for i, p in enumerate(random_points(30, 10))] + [(30, 10.1, 45.1, 0.1), (31, -169.9, -45.1, 0.1)]
    c, t = cloud_of(spark, src), target_of(spark, tgt)
    for k in (1, 4):
        near = {(x.tid, x["rank"]): x.pid for x in knn(c, t, k).collect()}
        for x in tgt:
            d = sorted((round(chord(x[1:3], s[1:3]), 12), s[0]) for s in src)[:k]
            assert [round(chord(x[1:3], src[near[(x[0], j + 1)]][1:3]), 12) for j in range(k)] == [a for a, _ in d]
    got = knn(c.where("pid < 2"), t, 3, pad=True)
    assert got.count() == 3 * len(tgt) and got.where("pid is null").count() == len(tgt)
    assert knn(c.where("pid < 0"), t, 2).count() == 0 and knn(c, t.where("tid < 0"), 2).count() == 0
    with pytest.raises(ValueError):
        linear_nearest(c, t, max_source=10)


@pytest.mark.parametrize("poles", [True, False])
def test_uneven_grid_against_brute_force(spark, poles):
    la = [-90.0, -60.0, -10.0, 0.0, 5.0, 50.0, 90.0] if poles else [80.0, 30.0, 29.0, -70.0]
    lo = [0.0, 10.0, 50.0, 180.0, 300.0]
    rows = [(i * 5 + j, i, j, lo[j], la[i], float(i * 5 + j)) for i in range(len(la)) for j in range(5)]
    g = spark.createDataFrame(rows, "pid long, ilat long, ilon long, lon double, lat double, v double")
    axes = Grid.of(la, lo)
    assert not axes.even
    tgt = [(i, *p, r) for i, (p, r) in enumerate(zip(random_points(30, 11), [0.5, 1.0, 3.0] * 10))]
    got = {r.tid: (r.n_matches, r.v) for r in R.disk_average(g, target_of(spark, tgt), ["v"], grid=axes).collect()}
    for x in tgt:
        seen, hit = set(), []
        for pid, i, j, lo_, la_, v in rows:
            if hav(x[1:3], (lo_, la_)) <= math.degrees(x[3]) and not (abs(la_) == 90 and i in seen):
                seen.add(i)
                hit.append(v)
        near = min(rows, key=lambda s: (round(hav(x[1:3], s[3:5]), 9), s[0]))[5]
        assert got[x[0]] == (len(hit), pytest.approx(sum(hit) / len(hit) if hit else near))


def test_sink_keeps_attributes_and_records(spark, tmp_path):
    """A template with an unlimited dimension: attributes, other variables and records stay, a field on the records is written."""
    src, out = str(tmp_path / "a.nc"), str(tmp_path / "b.nc")
    v = [netcdf3.Variable("x", ("ncol",), np.dtype("f4"), attrs={"units": "m", "scale": np.array([1.5, 2.5])}), netcdf3.Variable("t", ("time", "ncol"), np.dtype("i2"))]
    head, h = netcdf3.lay_out(2, {"time": 2, "ncol": 3}, v, {"title": "kept", "n": np.array([7], np.int32)}, "time", 2)
    netcdf3.create(src, head, h)
    with open(src, "r+b") as f:
        netcdf3.write_slab(f, h, "x", 0, np.array([1, 2, 3]))
        netcdf3.write_slab(f, h, "t", 0, np.arange(6))
    with open(src, "rb") as f:
        old = netcdf3.read_header(f)
        assert old.record_size == 6 and netcdf3.read_slab(f, old, "t", 0, 6).tolist() == list(range(6))
    sinks.write_netcdf(spark.createDataFrame([(k, k + 0.5) for k in range(3)], "tid long, new double"), src, out, ["new"])
    with open(out, "rb") as f:
        n = netcdf3.read_header(f)
        assert n.attrs["title"] == "kept" and n.attrs["n"].tolist() == [7] and n.variables["x"].attrs["units"] == "m" and n.unlimited == "time" and n.records == 2
        assert [netcdf3.read_slab(f, n, c, 0, k).tolist() for c, k in (("x", 3), ("t", 6), ("new", 3))] == [[1, 2, 3], list(range(6)), [0.5, 1.5, 2.5]]
    sinks.write_netcdf(spark.createDataFrame([(k, -k - 0.9) for k in range(6)], "tid long, t double"), src, out, ["t"], in_place=True)
    with open(out, "rb") as f:
        assert netcdf3.read_slab(f, netcdf3.read_header(f), "t", 0, 6).tolist() == [0, -1, -2, -3, -4, -5]
    for rows in ([(0, 1.0)], [(0, 1.0), (1, 1.0), (1, 1.0)], [(1, 1.0), (2, 1.0), (3, 1.0)]):
        with pytest.raises(ValueError):
            sinks.write_netcdf(spark.createDataFrame(rows, "tid long, new double"), src, out, ["new"])


def test_self_mode_writes_squares_and_sources_own_names(spark, tmp_path):
    src = nc(tmp_path / "s.nc", {"grid_size": 4}, [("lon", ["grid_size"], np.array([0.0, 90, 180, 270])), ("lat", ["grid_size"], np.zeros(4)), ("f", ["grid_size"], np.array([1.0, 2, 3, 4]))])
    out = str(tmp_path / "o.nc")
    cli.run(spark, ["--source", src, "--reuse-source-mesh", "--smoothing-area", "0.001", "--square-fields", "f", "--output", out])
    with open(out, "rb") as f:
        h = netcdf3.read_header(f)
        assert netcdf3.read_slab(f, h, "f_squared", 0, 4).tolist() == [1, 4, 9, 16] and h.variables["f_squared"].dims == ("grid_size",)
    odd = nc(tmp_path / "odd.nc", {"n": 2}, [("px", ["n"], np.array([0.0, 90])), ("py", ["n"], np.zeros(2)), ("f", ["n"], np.array([1.0, 2]))])
    tgt = nc(tmp_path / "t.nc", {"ncol": 1}, [("px", ["ncol"], np.array([89.0])), ("py", ["ncol"], np.zeros(1)), ("area", ["ncol"], np.array([0.01]))])
    r = cli.run(spark, ["--source", odd, "--target", tgt, "--lon-var", "px", "--lat-var", "py", "--fields", "f", "--output", out])
    assert r.collect()[0]["f"] == 2.0
    assert ncgrid.load_cloud(spark, "file://" + odd, ["f"], "px", "py").count() == 2


def test_linear_nearest_takes_any_number_of_points_in_blocks(spark, monkeypatch):
    many = spark.range(100_001).selectExpr("id as pid", "(id * 137.5) % 360 as lon", "degrees(asin(2 * (id + 0.5) / 100001 - 1)) as lat")
    t = target_of(spark, [(i, *p, 0.1) for i, p in enumerate(random_points(5, 21))])
    assert {(r.tid, r.pid) for r in linear_nearest(many, t).collect()} == {(r.tid, r.pid) for r in knn(many, t).collect()}
    monkeypatch.setattr("sphereweave.operators.nearest.PACKED", (16, 8))
    monkeypatch.setattr("sphereweave.operators.nearest.TILE", (3, 5))
    src = [(i, *p, 0.0) for i, p in enumerate(random_points(60, 22) * 2)] + [(200, None, 1.0, 0.0), (201, float("nan"), 1.0, 0.0)]
    tgt = [(i, *p, 0.1) for i, p in enumerate(random_points(20, 23) + [src[7][1:3]])]
    got = {r.tid: (r.pid, r.dist) for r in linear_nearest(cloud_of(spark, src), target_of(spark, tgt)).collect()}
    for x in tgt:
        d, pid = min((round(chord(x[1:3], s[1:3]), 13), s[0]) for s in src[:120])
        assert got[x[0]][0] == pid and abs(got[x[0]][1] - d) < 1e-12
    assert linear_nearest(cloud_of(spark, []), target_of(spark, tgt)).count() == 0
