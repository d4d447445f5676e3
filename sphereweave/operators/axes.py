"""Axes of regular grids: their extent, their recovery from points, and the nearest row or column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .radius import Axis

#: Values of one axis that one task puts in order; longer axes are refused.
MAX_AXIS = 10_000_000


def axis_summary(points: DataFrame, names: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """(axis, lo, hi, n, spacing): bounds, distinct values and mean spacing (0 for a single value) of each column.
    Nulls do not count; an empty table gives n = 0 and nulls."""
    out = None
    for a in names:
        s = points.select(F.col(a).alias("v")).distinct().agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
        gap = F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1)).when(F.col("n") == 1, F.lit(0.0))
        s = s.select(F.lit(a).alias("axis"), "lo", "hi", "n", gap.alias("spacing"))
        out = s if out is None else out.unionByName(s)
    return out


def recover_axes(points: DataFrame, max_axis: int = MAX_AXIS) -> DataFrame:
    """points(lon, lat, ...) of a full grid in any order -> the same with ilat and ilon, ascending from 0.

    Raises unless every latitude meets every longitude once: the points are then no grid. Only distinct
    values of an axis, counted first, are put in order."""
    n = points.agg(F.count("*").alias("n"), F.count_distinct("lat").alias("lat"), F.count_distinct("lon").alias("lon"), F.count_distinct("lat", "lon").alias("both")).first()
    if n["n"] != n["both"] or n["lat"] * n["lon"] != n["n"]:
        raise ValueError(f"{n['n']} points with {n['lat']} latitudes and {n['lon']} longitudes are not a full grid")
    if max(n["lat"], n["lon"]) > max_axis:
        raise ValueError(f"an axis has more than {max_axis} values")
    for a in ("lat", "lon"):
        values = points.select(a).distinct().withColumn(f"i{a}", (F.row_number().over(Window.orderBy(a)) - 1).cast("long"))
        points = points.join(values, a)
    return points


def nearest_index(axis: Axis, value: Column) -> Column:
    """Index of the axis value nearest to `value`, the lower one of two; beyond the ends, the end."""
    if axis.n < 2 or not axis.step:
        return F.when(value.isNotNull(), F.lit(0).cast("long"))
    k = F.ceil((value - axis.first) / axis.step - 0.5).cast("long")
    return F.when(value.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.lit(axis.n - 1).cast("long"), k)))
