"""Results to Parquet, or into NetCDF files.

A NetCDF file is laid out by the driver (from a template, which is copied by slabs with all its attributes and dimensions, or
from stated variables) and filled by the tasks, each of which writes its rows at their places. So nothing is collected, a file may
be of any size, and a task that runs again writes the same bytes again. The path must be one that the driver and all executors can open for writing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .netcdf3 import Header, Variable, create, lay_out, open_file, read_header, read_slab, write_slab

SLAB = 8_000_000  # elements copied at a time


def write_parquet(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").parquet(path)


def _fill(result: DataFrame, path: str, h: Header, fields: Sequence[str], key: str, n: int) -> None:
    """Writes result(key, fields) at the places that the keys 0 to n - 1 name."""
    seen = result.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if n and (seen["n"], seen["d"], seen["lo"], seen["hi"]) != (n, n, 0, n - 1) or not n and seen["n"]:
        raise ValueError(f"{seen['n']} rows with keys from {seen['lo']} to {seen['hi']}, but {n} places")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "r+b") as f:
            for pdf in batches:
                at = pdf["key"].to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for x in fields:
                    values, whole = pdf[x].to_numpy(np.float64), h.variables[x].dtype.kind in "iu"
                    if whole and not np.isfinite(values).all():
                        raise ValueError(f"{x} has missing or infinite values, which its type cannot hold")
                    values = np.trunc(values) if whole else values
                    for a, b in zip(edges, edges[1:]):
                        write_slab(f, h, x, int(at[a]), values[a:b].astype(h.variables[x].dtype))
                yield pd.DataFrame({"n": [len(at)]})

    rows = result.select(F.col(key).cast("long").alias("key"), *[F.col(x).cast("double").alias(x) for x in fields])
    rows.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def write_netcdf(result: DataFrame, template: str, path: str, fields: Sequence[str], key: str = "tid", dims: str | Sequence[str] = "ncol", in_place: bool = False) -> None:
    """A copy of the template with the fields written. A field that the template has keeps its type (whole types
    truncate toward zero) and dimensions; others are new doubles on `dims`. in_place: all fields must exist. The keys must be 0 to n - 1, the places in the fields'
    dimensions, which must have n values. Attributes, the unlimited dimension and all other variables stay."""
    dims = (dims,) if isinstance(dims, str) else tuple(dims)
    with open_file(template) as f:
        old = read_header(f)
        missing = [x for x in fields if x not in old.variables]
        if in_place and missing:
            raise ValueError(f"the template has no variables {missing}")
        if missing and any(d not in old.dims for d in dims):
            raise ValueError(f"new fields need the dimensions {dims}; available: {old.dims}")
        head, h = lay_out(old.version, old.dims, [*old.variables.values(), *[Variable(x, dims, np.dtype("f8")) for x in missing]], old.attrs, old.unlimited, old.records)
        sizes = {int(np.prod(h.shape(x), dtype=np.int64)) for x in fields}
        if len(sizes) != 1:
            raise ValueError(f"the fields have {sorted(sizes)} values")
        create(path, head, h)
        with open(path, "r+b") as g:
            for v in old.variables:
                total = int(np.prod(old.shape(v), dtype=np.int64))
                for a in range(0, total, SLAB) if v not in fields else ():
                    write_slab(g, h, v, a, read_slab(f, old, v, a, min(SLAB, total - a)))
    _fill(result, path, h, fields, key, sizes.pop())


def write_new_netcdf(result: DataFrame, path: str, dims: Mapping[str, int], fields: Mapping[str, str], key: str, axes: Mapping[str, Sequence[float]] | None = None, attrs: Mapping | None = None) -> None:
    """A new file: result(key, fields) on all dims, of the types that `fields` states (NumPy's names), and the axes, doubles on the dimension of their name."""
    axes = dict(axes or {})
    variables = [*[Variable(a, (a,), np.dtype("f8")) for a in axes], *[Variable(x, tuple(dims), np.dtype(t)) for x, t in fields.items()]]
    head, h = lay_out(5, dims, variables, attrs)
    create(path, head, h)
    with open(path, "r+b") as f:
        for a, values in axes.items():
            write_slab(f, h, a, 0, np.asarray(values, np.float64))
    _fill(result, path, h, list(fields), key, int(np.prod(list(dims.values()), dtype=np.int64)))
