"""The `ncgrid` data source: classic NetCDF files as point clouds, one row a point.

Formats are tried in this order: cell centres (`grid_size` with grid_center_lon/lat), columns
(`grid_size` with lat/lon), regular grids (lat and lon axes with a topography variable, or with fields on
(lat, lon)), and any file with a known coordinate pair. Options: path; fields (comma-separated; else all of the format's
fields); lon_var, lat_var; fill_value (becomes null); rows_per_partition. The path is a file that every executor can open, or
the URI of a store that Arrow reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.radius import Grid
from ..work import cut
from .netcdf3 import Header, open_file, read_header, read_slab

#: Names that mark the formats.
TOPOGRAPHY = ("htopo", "Elevation", "terr")
LAND = ("landfract", "LandWater", "LANDFRAC")
LON_NAMES = ("xc", "lon", "longitude", "x")
LAT_NAMES = ("yc", "lat", "latitude", "y")


@dataclass
class Layout:
    kind: str  # scrip, columns, structured, generic
    lon: str
    lat: str
    n: int
    fields: list[str]
    nlon: int = 0
    nlat: int = 0
    dims: tuple[str, ...] = ()


def _flat(h: Header, names: Sequence[str], n: int, skip: set[str]) -> list[str]:
    return sorted(v for v in names if v not in skip and len(h.variables[v].dims) == 1 and h.shape(v) == (n,))


def detect(h: Header, fields: Sequence[str] = (), lon_var: str = "", lat_var: str = "") -> Layout:
    v, d = h.variables, h.dims
    if "grid_size" in d and "grid_center_lat" in v and "grid_center_lon" in v:
        lon, lat = lon_var or "grid_center_lon", lat_var or "grid_center_lat"
        skip = {lon, lat, "grid_center_lon", "grid_center_lat", "grid_corner_lon", "grid_corner_lat", "grid_dims"}
        out = Layout("scrip", lon, lat, d["grid_size"], _flat(h, list(v), d["grid_size"], skip))
    elif "grid_size" in d and all(k in v and h.shape(k) == (d["grid_size"],) for k in ("lat", "lon")):
        lon, lat = lon_var or "lon", lat_var or "lat"
        out = Layout("columns", lon, lat, d["grid_size"], _flat(h, list(v), d["grid_size"], {lon, lat, "lat", "lon", "grid_dims"}))
    else:
        y = next((k for k in ("lat", "latitude") if k in d), "")
        x = next((k for k in ("lon", "longitude") if k in d), "")
        topo = next((k for k in TOPOGRAPHY if k in v), "")
        lon, lat = lon_var or x, lat_var or y
        axes = y and x and lon in v and lat in v and v[lon].dims == (x,) and v[lat].dims == (y,)
        gridded = sorted(k for k in v if axes and v[k].dims == (y, x))
        if axes and (topo or gridded):
            auto = [topo, *[k for k in [next((k for k in LAND if k in v), "")] if k]] if topo else gridded
            out = Layout("structured", lon, lat, d[x] * d[y], auto, d[x], d[y])
        else:
            lon = lon_var or next((k for k in LON_NAMES if k in v), "")
            lat = lat_var or next((k for k in LAT_NAMES if k in v), "")
            if lon not in v or lat not in v:
                raise ValueError(f"no coordinate variables; available: {sorted(v)}")
            if not v[lon].dims or not v[lat].dims:
                raise ValueError("a coordinate variable has no dimension")
            if h.shape(lon) != h.shape(lat):
                raise ValueError(f"coordinates {lon} and {lat} have different shapes")
            n = int(np.prod(h.shape(lon)))
            out = Layout("generic", lon, lat, n, sorted(k for k in v if k not in {lon, lat, "xv", "yv"}))
    if not out.n:
        raise ValueError("the file has no points")
    out.dims = (*v[out.lat].dims, *v[out.lon].dims) if out.kind == "structured" else v[out.lon].dims
    if fields:
        missing = [f for f in fields if f not in v]
        if missing:
            raise ValueError(f"missing variables {missing}; available: {sorted(v)}")
        out.fields = list(fields)
    for f in out.fields:
        s = h.shape(f)
        if len(s) not in (1, 2):
            raise ValueError(f"{f} has {len(s)} dimensions; 1 or 2 are supported")
        if int(np.prod(s)) != out.n:
            raise ValueError(f"{f} has {int(np.prod(s))} values for {out.n} points")
    return out


class _Rows(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def _open(self):
        f = open_file(self.o["path"])
        h = read_header(f)
        names = [x.strip() for x in self.o.get("fields", "").split(",") if x.strip()]
        return f, h, detect(h, names, self.o.get("lon_var", ""), self.o.get("lat_var", ""))

    def schema(self) -> StructType:
        f, _, lay = self._open()
        f.close()
        return StructType([StructField("pid", LongType(), False), StructField("lon", DoubleType()), StructField("lat", DoubleType()), *[StructField(x, DoubleType()) for x in lay.fields]])

    def partitions(self):
        f, _, lay = self._open()
        f.close()
        rows = int(self.o.get("rows_per_partition", 1_000_000))
        if lay.kind == "structured":  # whole bands of latitude
            rows = max(1, rows // lay.nlon) * lay.nlon
        return [_Rows(a, min(rows, lay.n - a)) for a in range(0, lay.n, rows)]

    def read(self, partition: _Rows) -> Iterator:
        import pyarrow as pa

        f, h, lay = self._open()
        a, n = partition.start, partition.count
        pid = np.arange(a, a + n)
        with f:
            if lay.kind == "structured":
                lon = read_slab(f, h, lay.lon, 0, lay.nlon).astype(np.float64)[pid % lay.nlon]
                lat = read_slab(f, h, lay.lat, 0, lay.nlat).astype(np.float64)[pid // lay.nlon]
            else:
                lon, lat = (read_slab(f, h, c, a, n).astype(np.float64) for c in (lay.lon, lay.lat))
            cols = [pa.array(pid), pa.array(lon), pa.array(lat)]
            for x in lay.fields:
                v = read_slab(f, h, x, a, n).astype(np.float64)
                fill = self.o.get("fill_value")
                cols.append(pa.array(v, mask=v == float(fill)) if fill is not None else pa.array(v))
        step = 100_000
        t = pa.table(cols, names=["pid", "lon", "lat", *lay.fields])
        yield from t.to_batches(max_chunksize=step)


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ncgrid"

    def schema(self) -> StructType:
        return GridReader(dict(self.options)).schema()

    def reader(self, schema: StructType) -> GridReader:
        return GridReader(dict(self.options))


@dataclass
class Source:
    """A cloud with what its file says of it: grid, the axes of a structured one; dims, the file's dimensions of a field."""

    cloud: DataFrame
    grid: Grid | None
    kind: str
    n: int
    dims: tuple[str, ...]

    @property
    def is_structured(self) -> bool:
        return self.kind == "structured"


def load_source(spark: SparkSession, path: str, fields: Sequence[str] = (), lon_var: str = "", lat_var: str = "", retain: bool = False, **options) -> Source:
    """load_cloud, and the axes if the file is structured. retain: the points are written once as a work table and read from there."""
    grid, kind, dims, n = None, "parquet", (), None
    if not _is_parquet(path):
        with open_file(path) as f:
            h = read_header(f)
            lay = detect(h, list(fields), lon_var, lat_var)
            kind, dims, n = lay.kind, lay.dims, lay.n
            if kind == "structured":
                grid = Grid.of(*(read_slab(f, h, c, 0, k).astype(np.float64).tolist() for c, k in ((lay.lat, lay.nlat), (lay.lon, lay.nlon))))
    cloud = load_cloud(spark, path, fields, lon_var, lat_var, **options)
    cloud = cut(cloud, "points") if retain else cloud
    return Source(cloud, grid, kind, cloud.count() if n is None else n, dims)


def has_variable(path: str, name: str) -> bool:
    if _is_parquet(path):
        return True  # renamed if there, see load_cloud
    with open_file(path) as f:
        return name in read_header(f).variables


def _is_parquet(path: str) -> bool:
    return path.rstrip("/").endswith(".parquet")


def load_cloud(spark: SparkSession, path: str, fields: Sequence[str] = (), lon_var: str = "", lat_var: str = "", **options) -> DataFrame:
    """A NetCDF or Parquet cloud as (pid, lon, lat, fields)."""
    if _is_parquet(path):
        df = spark.read.parquet(path)
        df = df.withColumnsRenamed({k: v for k, v in ((lon_var, "lon"), (lat_var, "lat")) if k and k in df.columns and v not in df.columns})
        missing = [f for f in ("pid", "lon", "lat", *fields) if f not in df.columns]
        if missing:
            raise ValueError(f"missing variables {missing}; available: {sorted(df.columns)}")
        return df.select("pid", "lon", "lat", *fields) if fields else df
    spark.dataSource.register(GridSource)
    r = spark.read.format("ncgrid").option("fields", ",".join(fields)).option("lon_var", lon_var).option("lat_var", lat_var)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def load_target(spark: SparkSession, path: str, lon: str = "lon", lat: str = "lat", area: str = "area", dof: str = "ncol") -> DataFrame:
    """(tid, lon, lat, area): all three variables are required and lie on the one dimension."""
    if path.endswith(".parquet"):
        return load_cloud(spark, path, [area], lon, lat).select(*[c for c in ("lon", "lat")], "pid", area).withColumnsRenamed({"pid": "tid", area: "area"}).select("tid", "lon", "lat", "area")
    with open_file(path) as f:
        h = read_header(f)
    if dof not in h.dims or not h.dims[dof]:
        raise ValueError(f"dimension {dof} is missing or empty; available: {h.dims}")
    for v in (lon, lat, area):
        if v not in h.variables or h.variables[v].dims != (dof,):
            raise ValueError(f"variable {v} on {dof} is missing")
    return load_cloud(spark, path, [area], lon, lat).withColumnsRenamed({"pid": "tid", area: "area"}).select("tid", "lon", "lat", "area")
