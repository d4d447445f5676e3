"""Range joins on the sphere as cell-keyed equi-joins.

Unstructured clouds: a target's disk of chord radius c belongs to level L = ceil(log2 c); sources
get a voxel of size 2**L for every level that occurs, targets go to the at most 27 voxels that
their disk's box overlaps. The join on (level, voxel) plans as a hash or merge join, with no pole or
dateline cases; the exact distance test follows. The targets' cells are written and counted first: up to BROADCAST_ROWS of them
go to the sources, which are then not shuffled at all.

Regular grids: blocks of index cells about as large as the disks. A block's rows follow from the level of the radius, its columns from
that and the block's latitude, so a disk meets a few blocks at any latitude, and a source row has one block a level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..work import cut

LEVELS = (-30, 1)
#: Cells of targets (some 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 500_000


def with_xyz(df: DataFrame, prefix: str = "") -> DataFrame:
    x, y, z = G.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    return df.withColumns({f"{prefix}x": x, f"{prefix}y": y, f"{prefix}z": z})


def _cell(c: Column, size: Column) -> Column:
    return F.floor(c / size).cast("int")


def radius_join(source: DataFrame, target: DataFrame, inclusive_degrees: bool = False) -> DataFrame:
    """source(pid, lon, lat, ...) x target(tid, lon, lat, radius in radians) -> tid, dist, and source's
    columns without lon, lat. Strictly inside by chord; with inclusive_degrees, at most the radius by
    great circle. Targets whose radius is not positive, NaN or null match nothing."""
    t = with_xyz(target.select("tid", "lon", "lat", "radius").where("radius > 0 and not isnan(radius)"), "t_")
    t = t.withColumn("c", G.angle_to_chord(F.col("radius")))
    slack = 1 + 1e-9 if inclusive_degrees else 1.0
    level = F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.ceil(F.log2(F.col("c") * slack)).cast("int")))
    t = t.withColumn("level", level).withColumn("h", F.pow(F.lit(2.0), F.col("level")))
    t = cut(t, "targets")
    levels = sorted(r[0] for r in t.select("level").distinct().collect())  # at most 32
    s = with_xyz(source).withColumn("level", F.explode(F.array(*[F.lit(v).cast("int") for v in levels]) if levels else F.array().cast("array<int>")))
    h = F.pow(F.lit(2.0), F.col("level"))
    s = s.withColumns({f"v{a}": _cell(F.col(a), h) for a in "xyz"})
    for a in "xyz":
        lo, hi = (_cell(F.col(f"t_{a}") + k * F.col("c") * slack, F.col("h")) for k in (-1, 1))
        t = t.withColumn(f"v{a}", F.explode(F.sequence(lo, hi)))
    t = t.withColumnsRenamed({"lon": "t_lon", "lat": "t_lat"}).drop("h")
    small = t.count() <= BROADCAST_ROWS
    j = s.join(F.broadcast(t) if small else t, ["level", "vx", "vy", "vz"])
    if inclusive_degrees:
        j = j.withColumn("dist", G.haversine_degrees(F.col("t_lon"), F.col("t_lat"), F.col("lon"), F.col("lat"))).where(F.col("dist") <= F.degrees("radius"))
    else:
        j = j.withColumn("dist", G.chord(*[F.col(c) for c in ("x", "y", "z", "t_x", "t_y", "t_z")])).where(F.col("dist") < F.col("c"))
    return j.select("tid", "dist", *[c for c in source.columns if c not in ("lon", "lat")])


@dataclass(frozen=True)
class Axis:
    """One regular axis: first value, step (0 if single), length."""

    first: float
    step: float
    n: int

    @classmethod
    def of(cls, values: list[float], tolerance: float = 1e-6) -> "Axis | None":
        """None if the values are not evenly spaced and ascending."""
        n = len(values)
        step = (values[-1] - values[0]) / (n - 1) if n > 1 else 0.0
        even = all(abs(values[0] + k * step - v) <= tolerance * max(abs(step), 1e-12) for k, v in enumerate(values))
        return cls(values[0], step, n) if even and step >= 0 else None


@dataclass(frozen=True)
class Grid:
    """Axes of a structured source; an axis that is not evenly spaced and ascending is None."""

    lat: Axis | None
    lon: Axis | None
    nlat: int
    nlon: int

    @classmethod
    def of(cls, lats: list[float], lons: list[float]) -> "Grid":
        return cls(Axis.of(lats), Axis.of(lons), len(lats), len(lons))

    @classmethod
    def plain(cls, grid: "Grid | tuple[Axis, Axis]") -> "Grid":
        return grid if isinstance(grid, Grid) else cls(grid[0], grid[1], grid[0].n, grid[1].n)

    @property
    def even(self) -> bool:
        """Whether index arithmetic holds: even axes, and columns that divide a whole circle (a regional grid has fewer of them)."""
        if self.lat is None or self.lon is None:
            return False
        return self.nlon == 1 or abs(360.0 / self.lon.step - round(360.0 / self.lon.step)) < 1e-6 and self.nlon <= round(360.0 / self.lon.step)

    @property
    def global_(self) -> bool:
        return self.even and (self.nlon == 1 or self.nlon == round(360.0 / self.lon.step))


def _step(a: Axis) -> float:
    return a.step or 360.0


def half_width(t_lat: Column, r: Column, south: Column, north: Column) -> Column:
    """Half the width in longitude (degrees) of the disk of r degrees around latitude t_lat where it is widest between two
    latitudes that it meets; a little more than exact, and 180 around a pole."""
    tangent = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(F.radians(t_lat)) / F.greatest(F.cos(F.radians(r)), F.lit(1e-9))))))
    at = F.greatest(south, F.least(north, tangent))
    wide = F.cos(F.radians(t_lat)) * F.cos(F.radians(at))
    x = (F.cos(F.radians(r)) - F.sin(F.radians(t_lat)) * F.sin(F.radians(at))) / wide
    return F.when((r >= 89.9) | (wide < 1e-9) | (x <= -1), F.lit(180.0)).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), x))) + 2e-6)


def _pole_rows_once(j: DataFrame, once: Column, out: list[str]) -> DataFrame:
    """Of the matches marked `once`, the first ilon alone for each target and row: the points of a pole's row are one place."""
    w = Window.partitionBy("tid", "ilat").orderBy("ilon")
    poles = j.where(once).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return j.where(~once).select(*out).union(poles.select(*out))


def uneven_radius_join(source: DataFrame, target: DataFrame) -> DataFrame:
    """As grid_radius_join, for axes that are not evenly spaced: the inclusive join of clouds, with the rule for rows at a pole."""
    out = ["tid", "dist", *[c for c in source.columns if c not in ("lon", "lat")]]
    j = radius_join(source.withColumn("at_pole", G.is_at_pole(F.col("lat"))), target, inclusive_degrees=True)
    return _pole_rows_once(j, F.col("at_pole"), out)


def grid_radius_join(source: DataFrame, target: DataFrame, lat: Axis, lon: Axis, compat: bool = False) -> DataFrame:
    """source(pid, ilat, ilon, lon, lat, ...) on regular axes x target(tid, lon, lat, radius) -> tid,
    dist (degrees), ilat, ilon and source's columns. Great circle distance at most the radius. In a
    row at a pole only the first matching ilon counts, as its points are one place. compat:
    a target at a pole takes the whole extreme row if that is within the radius, and nothing else."""
    t = target.select("tid", F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"), "radius").where("radius > 0 and not isnan(radius)")
    t = t.withColumn("r", F.least(F.degrees("radius"), F.lit(180.0)))
    eps = 1e-9
    lo = F.greatest(F.lit(0), F.ceil((F.col("t_lat") - F.col("r") - eps - lat.first) / _step(lat)).cast("int"))
    hi = F.least(F.lit(lat.n - 1), F.floor((F.col("t_lat") + F.col("r") + eps - lat.first) / _step(lat)).cast("int"))
    t = t.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    t = t.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.col("r") / _step(lat))))).cast("int"))
    full = round(360.0 / lon.step) if lon.step else 1  # columns of a whole circle; a regional grid has fewer
    rows = F.pow(F.lit(2.0), F.col("level")).cast("int")

    def columns() -> Column:
        """Columns of a block (level, by): as wide as the level's disks at the block's latitude farthest from the equator."""
        south = F.lit(lat.first) + F.col("by") * rows * _step(lat)
        far = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + (rows - 1) * _step(lat))))
        wide = rows * _step(lat) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)) / _step(lon)
        return F.greatest(F.lit(1.0), F.least(F.lit(float(full)), F.ceil(wide))).cast("int")

    t = t.withColumn("by", F.explode(F.sequence(F.floor(F.col("lo") / rows).cast("int"), F.floor(F.col("hi") / rows).cast("int"))))
    south, north = (F.lit(lat.first) + c * _step(lat) for c in (F.greatest(F.col("by") * rows, F.col("lo")), F.least(F.col("by") * rows + rows - 1, F.col("hi"))))
    t = t.withColumn("half", half_width(F.col("t_lat"), F.col("r"), south, north)).withColumn("bw", columns())
    t = t.withColumns({"west": F.floor((F.col("t_lon") - F.col("half") - lon.first) / _step(lon)).cast("long"),
                       "east": F.ceil((F.col("t_lon") + F.col("half") - lon.first) / _step(lon)).cast("long")})
    a, b = (F.pmod(F.col(c), F.lit(full)) for c in ("west", "east"))
    wrap, last = a > b, F.floor((F.lit(full) - 1) / F.col("bw")).cast("int")
    a, b = F.floor(a / F.col("bw")).cast("int"), F.floor(b / F.col("bw")).cast("int")
    cols = F.when(F.col("east") - F.col("west") + 1 >= full, F.sequence(F.lit(0), last)).when(
        wrap, F.array_distinct(F.concat(F.sequence(a, last), F.sequence(F.lit(0), b)))).otherwise(F.sequence(a, b))
    t = cut(t.withColumn("bx", F.explode(cols)).select("tid", "t_lon", "t_lat", "radius", "level", "by", "bx"), "targets")
    levels = sorted(r[0] for r in t.select("level").distinct().collect())  # at most 31
    s = source.withColumn("level", F.explode(F.array(*[F.lit(v).cast("int") for v in levels]) if levels else F.array().cast("array<int>")))
    s = s.withColumn("by", F.floor(F.col("ilat") / rows).cast("int")).withColumn("bx", F.floor(F.col("ilon") / columns()).cast("int"))
    j = s.join(F.broadcast(t) if t.count() <= BROADCAST_ROWS else t, ["level", "by", "bx"]).drop("level", "by", "bx")
    j = j.withColumn("dist", G.haversine_degrees(F.col("t_lon"), F.col("t_lat"), F.col("lon"), F.col("lat")))
    inside = F.col("dist") <= F.degrees("radius")
    if compat:
        ends = (lat.first, lat.first + lat.step * (lat.n - 1))
        extreme = F.when(F.col("t_lat") > 0, F.lit(lat.n - 1)).otherwise(F.lit(0))
        gap = F.abs(F.col("t_lat") - F.when(F.col("t_lat") > 0, F.lit(ends[1])).otherwise(F.lit(ends[0])))
        inside = F.when(G.is_at_pole(F.col("t_lat")), (F.col("ilat") == extreme) & (gap <= F.degrees("radius"))).otherwise(inside)
    j = j.where(inside)
    out = ["tid", "dist", *[c for c in source.columns if c not in ("lon", "lat")]]
    if any(abs(abs(v) - 90) < G.POLE_DEGREES for v in (lat.first, lat.first + lat.step * (lat.n - 1))):
        once = G.is_at_pole(F.col("lat")) & (~G.is_at_pole(F.col("t_lat")) if compat else F.lit(True))
        j = _pole_rows_once(j, once, out)
    return j.select(*out)
