"""Gauss-Lobatto quadrature on quadrilaterals of the sphere."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NP = 4


def gauss_lobatto(n: int, x0: float = 0.0, x1: float = 1.0) -> tuple[list[float], list[float]]:
    """Nodes and weights on [x0, x1]: the ends, and the roots of the Legendre polynomial's derivative."""
    if not 2 <= n <= 10:
        raise ValueError("2 to 10 points")
    p = np.polynomial.legendre.Legendre.basis(n - 1)
    x = np.concatenate([[-1.0], np.sort(p.deriv().roots().real), [1.0]])
    d, d2 = p.deriv(), p.deriv(2)
    for _ in range(3):  # Newton polish of the inner nodes
        x[1:-1] -= d(x[1:-1]) / d2(x[1:-1])
    x = (x - x[::-1]) / 2
    w = 2.0 / (n * (n - 1) * p(x) ** 2)
    return [x0 + (x1 - x0) * (v + 1) / 2 for v in x.tolist()], [(x1 - x0) * v / 2 for v in w.tolist()]


def gll_frame(spark: SparkSession, n: int = NP) -> DataFrame:
    """(node, alpha, beta, w): node = j * n + i, alpha by i, beta by j."""
    x, w = gauss_lobatto(n)
    return spark.createDataFrame([(j * n + i, x[i], x[j], w[i] * w[j]) for j in range(n) for i in range(n)], "node int, alpha double, beta double, w double")


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once; plain columns would be inlined at every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def quad_nodes(mesh: DataFrame, n: int = NP, bubble: bool = False) -> DataFrame:
    """mesh(eid, nodes array of 4 structs x, y, z) -> eid, node, x, y, z (unit), jac.

    The bilinear map of (alpha, beta) over the corners n0(0,0) n1(1,0) n2(1,1) n3(0,1), projected to
    the sphere; jac is the area element times the weights. An element that is not a quad, or a Jacobian that is
    not positive, raises. bubble rescales the inner nodes so that an element's sum is its exact area."""
    m = mesh.select("eid", F.when(F.size("nodes") == 4, F.col("nodes")).otherwise(F.raise_error(F.lit("element is not a quad"))).alias("nodes"))
    # the points of the quadrature are a literal of n * n rows
    x_, w_ = gauss_lobatto(n)
    pts = F.array(*[F.struct(F.lit(j * n + i).alias("node"), F.lit(x_[i]).alias("alpha"), F.lit(x_[j]).alias("beta"), F.lit(w_[i] * w_[j]).alias("w")) for j in range(n) for i in range(n)])
    m = m.withColumn("q", F.explode(pts)).select("eid", "nodes", "q.*")
    a, b = F.col("alpha"), F.col("beta")
    p = lambda k, c: F.col("nodes")[k][c]
    bilinear = F.struct(
        *[(p(0, c) * (1 - a) * (1 - b) + p(1, c) * a * (1 - b) + p(2, c) * a * b + p(3, c) * (1 - a) * b).alias(f"p{c}") for c in "xyz"],
        *[((p(1, c) - p(0, c)) * (1 - b) + (p(2, c) - p(3, c)) * b).alias(f"a{c}") for c in "xyz"],
        *[((p(3, c) - p(0, c)) * (1 - a) + (p(2, c) - p(1, c)) * a).alias(f"b{c}") for c in "xyz"])

    def projected(s: Column) -> Column:
        v = lambda d: [s[f"{d}{c}"] for c in "xyz"]
        return F.struct(*[s[f"{d}{c}"].alias(f"{d}{c}") for d in "pab" for c in "xyz"], F.sqrt(_dot(v("p"), v("p"))).alias("r"),
                        _dot(v("p"), v("a")).alias("pa"), _dot(v("p"), v("b")).alias("pb"))

    def tangents(s: Column) -> Column:
        r = s["r"]
        return F.struct(*[(s[f"p{c}"] / r).alias(c) for c in "xyz"],
                        *[((s[f"{d}{c}"] * r * r - s[f"p{c}"] * s[f"p{d}"]) / (r * r * r)).alias(f"d{d}{c}") for d in "ab" for c in "xyz"])

    def node(s: Column) -> Column:
        u, v = ([s[f"d{d}{c}"] for c in "xyz"] for d in "ab")
        cross = F.struct((u[1] * v[2] - u[2] * v[1]).alias("i"), (u[2] * v[0] - u[0] * v[2]).alias("j"), (u[0] * v[1] - u[1] * v[0]).alias("k"))
        size = _let(cross, lambda c: F.sqrt(c["i"] * c["i"] + c["j"] * c["j"] + c["k"] * c["k"]))
        return F.struct(*[s[c].alias(c) for c in "xyz"], size.alias("size"))

    m = m.withColumn("s", _let(_let(_let(bilinear, projected), tangents), node))
    m = m.withColumn("jac", F.col("s.size") * F.col("w"))
    m = m.withColumn("jac", F.when(F.col("jac") > 0, F.col("jac")).otherwise(F.raise_error(F.lit("Jacobian is not positive"))))
    m = m.select("eid", "node", "w", "nodes", "jac", "s.x", "s.y", "s.z")
    out = m.select("eid", "node", "w", "x", "y", "z", "jac", "nodes")
    if bubble:
        out = _bubble(out, n)
    return out.drop("nodes")


def spherical_area(nodes: Column) -> Column:
    """Exact area of a spherical quad: two triangles by l'Huilier's formula."""
    def side(i, j):
        p, q = nodes[i], nodes[j]
        dot = p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
        n = F.sqrt((p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2) * (q["x"] ** 2 + q["y"] ** 2 + q["z"] ** 2))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n)))

    def triangle(i, j, k):
        a, b, c = side(i, j), side(j, k), side(k, i)
        s = (a + b + c) / 2
        t = F.tan(s / 2) * F.tan((s - a) / 2) * F.tan((s - b) / 2) * F.tan((s - c) / 2)
        return 4 * F.atan(F.sqrt(F.greatest(t, F.lit(0.0))))

    return triangle(0, 1, 2) + triangle(0, 2, 3)


def _bubble(m: DataFrame, n: int) -> DataFrame:
    i, j = F.pmod(F.col("node"), F.lit(n)), F.floor(F.col("node") / n)
    inner = (i > 0) & (i < n - 1) & (j > 0) & (j < n - 1) if n > 2 else F.lit(True)
    s = m.groupBy("eid").agg(F.sum("jac").alias("total"), F.sum(F.when(inner, F.col("jac")).otherwise(0.0)).alias("inner"), F.first(spherical_area(F.col("nodes"))).alias("exact"))
    ok = F.when(F.col("inner") >= 1e-15, F.col("inner")).otherwise(F.raise_error(F.lit("inner nodes have no area")))
    scale = 1 + (F.col("exact") - F.col("total")) / ok
    return m.join(s, "eid").withColumn("jac", F.when(inner, F.col("jac") * scale).otherwise(F.col("jac"))).drop("total", "inner", "exact")


def element_centroid(mesh: DataFrame) -> DataFrame:
    """(eid, x, y, z): the mean of an element's nodes, brought to the unit sphere; a single node is itself."""
    n = F.size("nodes")
    add = {c: (lambda c: lambda s, p: s + p[c])(c) for c in "xyz"}
    mean = {c: F.aggregate("nodes", F.lit(0.0), add[c]) / n for c in "xyz"}
    m = mesh.select("eid", *[v.alias(f"m{c}") for c, v in mean.items()])
    r = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    return m.select("eid", *[(F.col(f"m{c}") / r).alias(c) for c in "xyz"])


def is_spectral(mesh: DataFrame) -> bool:
    """Whether every element is a quad."""
    return not mesh.where(F.size("nodes") != 4).limit(1).count()
