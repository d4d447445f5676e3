"""python -m sphereweave.cli --source S --target T [--output O] ... : one remapping from files to a file."""

from __future__ import annotations

import argparse
import logging
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import remap as R
from .operators.quadrature import is_spectral
from .sources.ncgrid import has_variable, load_source, load_target
from .sources.sinks import write_netcdf, write_parquet
from .work import cut

log = logging.getLogger("sphereweave")


def names(text: str) -> list[str]:
    return [x.strip(" \t") for x in (text or "").split(",") if x.strip(" \t")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sphereweave", description=__doc__)
    for o, t, d in (("source", str, ""), ("target", str, ""), ("output", str, ""), ("fields", str, ""), ("square-fields", str, ""), ("remap-method", str, "da"),
                    ("lon-var", str, ""), ("lat-var", str, ""), ("area-var", str, "area"), ("dof-var", str, "ncol"), ("smoothing-area", float, 0.0), ("alpha", float, 1.0)):
        p.add_argument(f"--{o}", type=t, default=d)
    for o in ("spectral", "reuse-source-mesh", "verbose"):
        p.add_argument(f"--{o}", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str]):
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    if not a.source or not (a.target or a.reuse_source_mesh):
        raise ValueError("source and target are required")
    if a.reuse_source_mesh and a.smoothing_area < 1e-12:
        raise ValueError("--reuse-source-mesh needs --smoothing-area of at least 1e-12")
    method = R.ALIASES.get(a.remap_method.upper())
    if method is None:
        raise ValueError(f"unknown remap method {a.remap_method!r}")
    if a.reuse_source_mesh and method == "nn":
        raise ValueError("nearest on the source itself is the identity")
    began = time.time()
    # the coordinates' names hold for both sides, where a side's file has them
    own = {o: v if v and has_variable(a.source, v) else "" for o, v in (("lon_var", a.lon_var), ("lat_var", a.lat_var))}
    if a.reuse_source_mesh and [own["lon_var"], own["lat_var"]] != [a.lon_var, a.lat_var]:
        raise ValueError(f"the source has no variables {a.lon_var!r}, {a.lat_var!r}")
    source = load_source(spark, a.source, names(a.fields), own["lon_var"], own["lat_var"])
    cloud, grid = source.cloud, source.grid
    fields = [c for c in cloud.columns if c not in ("pid", "lon", "lat")]
    squares = names(a.square_fields)
    cloud = R.squared_fields(cloud, squares, fields)
    out_fields = fields + [f"{s}_squared" for s in squares]
    if not a.output:
        log.info("%d points, %s, fields %s", source.n, source.kind, fields)
        return cloud
    if a.reuse_source_mesh:
        result, key = R.self_smooth(cloud, a.smoothing_area, out_fields, grid), "pid"
    elif a.spectral:
        mesh = spark.read.parquet(a.target)
        result, key = (R.spectral_average(cloud, mesh, out_fields, grid=grid) if method == "da" and is_spectral(mesh) else R.element_average(cloud, mesh, out_fields, method, a.alpha, grid)), "eid"
    else:
        target = load_target(spark, a.target, a.lon_var or "lon", a.lat_var or "lat", a.area_var, a.dof_var)
        result, key = R.remap(cloud, target, out_fields, method, grid=grid, **({"alpha": a.alpha} if method == "da" else {})), "tid"
    result = R.validate(cut(result, "result"), out_fields)
    template = a.source if a.reuse_source_mesh else a.target
    if Path(a.output).suffix == ".nc" and Path(template).suffix == ".nc":
        write_netcdf(result, template, a.output, out_fields, key, source.dims if a.reuse_source_mesh else a.dof_var)
    else:
        write_parquet(result, a.output)
    if a.verbose:
        for row in R.sample_values(result, key, out_fields).collect():
            log.info("%s", row.asDict())
    log.info("done in %.1f s", time.time() - began)
    return result


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("sphereweave").getOrCreate(), sys.argv[1:])
