"""Remapping: disk average, nearest, quadrature average, self-smoothing; a registry of methods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import quadrature
from ..work import cut
from .nearest import grid_nearest, knn
from .radius import Axis, Grid, grid_radius_join, radius_join, uneven_radius_join


def squared_fields(cloud: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Adds <f>_squared for each name, which must be one of the fields read."""
    missing = [n for n in names if n not in fields]
    if missing:
        raise ValueError(f"squared fields are not read: {missing}")
    return cloud.withColumns({f"{n}_squared": F.col(n) * F.col(n) for n in names})


def _check(cloud: DataFrame, fields: Sequence[str]) -> None:
    missing = [f for f in fields if f not in cloud.columns]
    if missing:
        raise ValueError(f"missing fields {missing}; available: {sorted(cloud.columns)}")


def _means(matches: DataFrame, fields: Sequence[str]) -> DataFrame:
    return matches.groupBy("tid").agg(F.count("*").alias("n_matches"), *[F.avg(f).alias(f) for f in fields])


def disk_average(cloud: DataFrame, target: DataFrame, fields: Sequence[str], alpha: float = 1.0, grid: Grid | tuple[Axis, Axis] | None = None, compat: bool = False) -> DataFrame:
    """cloud(pid, lon, lat, fields) x target(tid, lon, lat, area or radius) -> tid, n_matches, fields.

    grid: the axes of a structured cloud, whose pid is ilat * nlon + ilon. The mean of all points in the disk of each target's area; the nearest point's values where the disk is
    empty or its radius is not positive or NaN (n_matches 0). One join serves all fields. An empty cloud raises."""
    _check(cloud, fields)
    if "radius" not in target.columns:
        target = target.withColumn("radius", G.area_radius(F.col("area"), alpha))
    target = target.select("tid", "lon", "lat", "radius")
    cols = ["pid", "lon", "lat", *fields]
    if grid is None:
        matches = radius_join(cloud.select(*cols), target)
    else:
        g = Grid.plain(grid)
        c = cloud.select(*cols, *[k.alias(n) for k, n in zip(G.grid_indices(F.col("pid"), g.nlon), ("ilat", "ilon"))])
        if not g.even and compat:
            raise ValueError("compat needs evenly spaced axes")
        matches = grid_radius_join(c, target, g.lat, g.lon, compat) if g.even else uneven_radius_join(c, target)
    both = cut(target.join(_means(matches, fields), "tid", "left"), "means")
    found = both.where("n_matches is not null").select("tid", "n_matches", *fields)
    empty = both.where("n_matches is null").select("tid", "lon", "lat")
    if not empty.limit(1).count():
        return found
    return found.unionByName(nearest(cloud, empty, fields, grid).select("tid", F.lit(0).cast("long").alias("n_matches"), *fields))


def nearest(cloud: DataFrame, target: DataFrame, fields: Sequence[str], grid: Grid | tuple[Axis, Axis] | None = None) -> DataFrame:
    """tid and the nearest point's fields."""
    _check(cloud, fields)
    if grid is not None and (g := Grid.plain(grid)).global_:
        at = grid_nearest(target, g.lat, g.lon)
        return at.join(cloud.select("pid", *fields), "pid").select("tid", *fields)
    n = cloud.count()
    if not n:
        raise ValueError("the source cloud is empty")
    return knn(cloud.select("pid", "lon", "lat", *fields), target, 1, n).select("tid", *fields)


def self_smooth(cloud: DataFrame, area: float, fields: Sequence[str], grid: Grid | tuple[Axis, Axis] | None = None) -> DataFrame:
    """Every point's fields replaced by the mean over the disk of the given area around it."""
    if area < 1e-12:
        raise ValueError("self-smoothing needs an area of at least 1e-12")
    target = cloud.select(F.col("pid").alias("tid"), "lon", "lat", G.area_radius(F.lit(float(area))).alias("radius"))
    return disk_average(cloud, target, fields, grid=grid).withColumnRenamed("tid", "pid")


def spectral_average(cloud: DataFrame, mesh: DataFrame, fields: Sequence[str], gll_radius: str = "jacobian", bubble: bool = False,
                     grid: Grid | tuple[Axis, Axis] | None = None) -> DataFrame:
    """mesh(eid, nodes) -> eid, fields: disk means at the 4 x 4 Gauss-Lobatto nodes of every quad, weighted
    by w_i * w_j. A node's disk has its Jacobian as radius ('jacobian'), or sqrt(jac / pi) ('sqrt_area')."""
    if gll_radius not in ("jacobian", "sqrt_area"):
        raise ValueError("gll_radius is 'jacobian' or 'sqrt_area'")
    q = quadrature.quad_nodes(mesh, bubble=bubble)
    lon, lat = G.xyz_to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    radius = F.col("jac") if gll_radius == "jacobian" else G.area_radius(F.col("jac"))
    n = quadrature.NP ** 2
    # the nodes are written once: the joins look at them several times
    t = q.select((F.col("eid") * n + F.col("node")).alias("tid"), lon.alias("lon"), lat.alias("lat"), radius.alias("radius"), "w")
    t = cut(t, "nodes")
    v = disk_average(cloud, t, fields, grid=grid).join(t.select("tid", "w"), "tid")
    eid = F.floor(F.col("tid") / n).cast("long").alias("eid")
    return v.groupBy(eid).agg(*[(F.sum(F.col("w") * F.col(f)) / F.sum("w")).alias(f) for f in fields])


def element_average(cloud: DataFrame, mesh: DataFrame, fields: Sequence[str], method: str = "da", alpha: float = 1.0, grid: Grid | tuple[Axis, Axis] | None = None) -> DataFrame:
    """mesh(eid, nodes, area for the disk means) -> eid, fields at the elements' centroids, for meshes that are not all quads and for the nearest points."""
    c = quadrature.element_centroid(mesh)
    lon, lat = G.xyz_to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    t = c.select(F.col("eid").alias("tid"), lon.alias("lon"), lat.alias("lat"))
    if method == "da":
        if "area" not in mesh.columns:
            raise ValueError("a mesh that is not all quads needs an area for each element")
        t = t.join(mesh.select(F.col("eid").alias("tid"), F.col("area").cast("double").alias("area")), "tid")
    return remap(cloud, t, fields, method, grid=grid, **({"alpha": alpha} if method == "da" else {})).withColumnRenamed("tid", "eid")


METHODS: dict[str, Callable] = {}
ALIASES = {"DA": "da", "ALG_DISKAVERAGE": "da", "DISKAVERAGE": "da", "NN": "nn", "NEAREST_NEIGHBOR": "nn", "ALG_NEAREST_NEIGHBOR": "nn"}


def register(name: str, method: Callable) -> None:
    """Adds a method (cloud, target, fields, **options) -> DataFrame."""
    METHODS[name] = method


register("da", disk_average)
register("nn", lambda cloud, target, fields, grid=None, **_: nearest(cloud, target, fields, grid))


def remap(cloud: DataFrame, target: DataFrame, fields: Sequence[str], method: str = "da", prefix: str = "", **options) -> DataFrame:
    """By name; output fields get the prefix."""
    key = ALIASES.get(method.upper(), method)
    if key not in METHODS:
        raise ValueError(f"unknown remap method {method!r}")
    out = METHODS[key](cloud, target, fields, **options)
    return out.withColumnsRenamed({f: f"{prefix}{f}" for f in fields}) if prefix else out


def validate(result: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Raises if any output is NaN or infinite; else returns the result."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.isnan(f) | (F.abs(f) == float("inf"))
    if result.where(bad).limit(1).count():
        raise ValueError("the result holds NaN or infinite values")
    return result


def as_target(cloud: DataFrame, default_area: float, area: str = "area") -> DataFrame:
    """cloud(pid, lon, lat, maybe an area) as target(tid, lon, lat, area in steradians); a missing or null area is the default."""
    a = F.coalesce(F.col(area), F.lit(float(default_area))) if area in cloud.columns else F.lit(float(default_area))
    return cloud.select(F.col("pid").alias("tid"), "lon", "lat", a.cast("double").alias("area"))


def error_count(result: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_errors): targets without a finite value, one pass over all fields."""
    bad = lambda f: F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    s = result.agg(*[F.count_if(bad(f)).alias(f"n_{k}") for k, f in enumerate(fields)])
    return s.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{k}").alias("n_errors")) for k, f in enumerate(fields)])).alias("s")).select("s.*")


def field_stats(result: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, min, max, mean, count), one pass over all fields."""
    s = result.agg(*[g(f).alias(f"{n}_{k}") for k, f in enumerate(fields) for n, g in (("min", F.min), ("max", F.max), ("mean", F.avg), ("count", F.count))])
    return s.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{n}_{k}").alias(n) for n in ("min", "max", "mean", "count")]) for k, f in enumerate(fields)])).alias("s")).select("s.*")


def sample_values(result: DataFrame, key: str, fields: Sequence[str], n: int = 5) -> DataFrame:
    """The first n results by key."""
    return result.select(key, *fields).orderBy(key).limit(n)


def fill_empty(result: DataFrame, target: DataFrame, fields: Sequence[str], value: float = 0.0) -> DataFrame:
    """One row for each target; those without a result, and null fields, hold the value."""
    return target.select("tid").join(result, "tid", "left").withColumns({f: F.coalesce(F.col(f), F.lit(value)) for f in fields})


def bounding_box(points: DataFrame) -> DataFrame:
    """(lon_lo, lon_hi, lat_lo, lat_hi) of all points; nulls for none."""
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))])


def in_box(points: DataFrame, box: dict[str, float], margin: float = 0.0) -> DataFrame:
    """The points inside the box, widened by margin degrees, its edges included."""
    return points.where(F.col("lon").between(box["lon_lo"] - margin, box["lon_hi"] + margin) & F.col("lat").between(box["lat_lo"] - margin, box["lat_hi"] + margin))


def subgrid_variance(result: DataFrame, field: str) -> DataFrame:
    """Adds <field>_variance = mean of squares less the square of the mean, where both were remapped."""
    return result.withColumn(f"{field}_variance", F.col(f"{field}_squared") - F.col(field) * F.col(field))


def typed_cast(result: DataFrame, types: dict[str, str]) -> DataFrame:
    """Fields in a file's own types; whole types truncate toward zero."""
    allowed = {"float", "double", "int", "smallint", "tinyint"}
    if set(types.values()) - allowed:
        raise ValueError(f"types are among {sorted(allowed)}")
    return result.withColumns({f: F.col(f).cast(t) for f, t in types.items()})
