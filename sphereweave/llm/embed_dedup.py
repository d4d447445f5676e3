"""Embedding near-dedup: an exact metric range join.

Cosine >= t among unit vectors is distance <= r with r = sqrt(2 - 2t). Pivots (real vectors,
chosen by hash, a list of at most `max_pivots`) partition the vectors: each belongs to
the cell of its nearest pivot. If x of the cell of p and y of the cell of q are within r, the triangle inequality gives
d(p, q) <= R(p) + R(q) + r, R a cell's radius, and x is at most r beyond the plane between p and q, as is y. So pairs of cells
that are too far apart are never compared, and of the others only the vectors near that plane.

Cells are cut into blocks of about `block` vectors, one row of a work table each, and pairs of blocks are
read from that table by a Cartesian product: no vector is shuffled more than twice, whatever the number of pairs, so the disk
grows with the rows alone. The work still grows with the square of the distinct vectors that no pivot tells apart.
Products are taken in single precision with a margin first, and what reaches it again in double precision. Identical
vectors are one class first, told by 128 bits of hash. A task returns sums and labels by class, never all its pairs.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and
rows without a vec_id, link with nothing; vectors of different lengths do not link; repeated
rows are further vectors of the same id; an empty table gives no rows; the label and
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, min_labels, release, table

EPS = 1e-9


def _usable(name: str):
    return F.col(name).isNotNull() & (F.size(name) > 0) & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(name, lambda x: x != 0)


def _hashed(name: str) -> list:
    return [F.xxhash64(name).alias("k1"), F.xxhash64(F.lit(1), name).alias("k2")]


def classes_of(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """(k1, k2, rep, n, e): one row per distinct usable vector."""
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable(name)).select("vec_id", F.col(name).alias("e"), *_hashed(name))
    return cut(rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("e").alias("e")), "vectors")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of huge and tiny components finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def routed_classes(vectors: DataFrame, cell: int, max_pivots: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(cid, k1, k2, rep, n, dim, own, far, v): each class with its vector's bytes, its cell and the distance to the cell's pivot,
    and the pivots by cell. Vectors of a length without pivots are a cell of their own."""
    k = int(min(max_pivots, max(1, vectors.count() // cell)))
    picked = [r["e"] for r in vectors.select("e", "k1", "k2").orderBy("k1", "k2").limit(k).collect()]
    dims = sorted({len(p) for p in picked})
    by_dim = {d: _unit(np.array([p for p in picked if len(p) == d])) for d in dims}
    kind = np.float32 if vectors.schema["e"].dataType.elementType.typeName() == "float" else np.float64

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["e"].map(len).to_numpy()
            for d in np.unique(size):
                for a in range(0, int((size == d).sum()), 256):  # a product of 256 vectors and all pivots at a time
                    part = pdf[size == d].iloc[a: a + 256]
                    x = np.stack(part["e"].to_numpy()).astype(kind)
                    own, far = np.full(len(x), -d, np.int64), np.full(len(x), 2.0)
                    if d in by_dim:
                        u, p = _unit(x), by_dim[d]
                        own = (u @ p.T).argmax(1)
                        far = np.sqrt(((u - p[own]) ** 2).sum(1))
                        own = own + sum(len(by_dim[y]) for y in dims if y < d)
                    yield part.drop(columns="e").assign(dim=d, own=own, far=far, v=[y.tobytes() for y in x])

    ids = f"cid long, k1 long, k2 long, rep {vectors.schema['rep'].dataType.simpleString()}, n long"
    rows = vectors.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "rep", "n", "e")
    out = cut(rows.mapInPandas(assign, f"{ids}, dim int, own int, far double, v binary"), "classes")
    return out, dict(enumerate(x for d in dims for x in by_dim[d]))


def range_links(classes: DataFrame, pivots: dict[int, np.ndarray], threshold: float, block: int = 4096) -> DataFrame:
    """(cid, links, root): links counts other vectors linked to cid's vector in one pair of blocks;
    root is the smallest cid that the pair connects it with."""
    spark, r = classes.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = {c["own"]: (c["n"], c["far"]) for c in classes.groupBy("own").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most max_pivots rows, and one a length
    plan = spark.sparkContext.broadcast((cells, pivots))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = {c: -(-m // block) for c, (m, _) in plan.value[0].items()}
        for pdf in batches:
            h = (pdf["cid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
            yield pdf.assign(part=h % pdf["own"].map(n).to_numpy())

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells, pivots = plan.value
        own, d = int(key[0]), int(pdf["dim"].iloc[0])
        return pd.DataFrame({"bid": [(own + (1 << 31) << 24) + int(key[1])], "dim": [d], "own": [own], "far": [cells[own][1]], "p": [pivots.get(own, np.zeros(d))],
                             "cids": [pdf["cid"].to_numpy().tobytes()], "ns": [pdf["n"].to_numpy().tobytes()], "v": [b"".join(pdf["v"])]})

    dealt = classes.select("cid", "n", "dim", "own", "v").mapInPandas(deal, "cid long, n long, dim int, own int, v binary, part int")
    blocks = cut(dealt.groupBy("own", "part").applyInPandas(gather, "bid long, dim int, own int, far double, p array<double>, cids binary, ns binary, v binary"), "blocks")
    wide = (classes.select((F.length("v") / F.col("dim")).cast("int").alias("b")).first() or [4])[0]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                yield _join_blocks(x, np.float32 if wide == 4 else np.float64, threshold, r)

    one = blocks.select(*[F.col(c).alias(f"l_{c}") for c in blocks.columns])
    two = blocks.select(*[F.col(c).alias(f"r_{c}") for c in blocks.columns]).hint("shuffle_replicate_nl")
    apart = F.aggregate(F.zip_with("l_p", "r_p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = one.join(two, (F.col("l_dim") == F.col("r_dim")) & (F.col("l_bid") <= F.col("r_bid")) & (F.sqrt(apart) <= F.col("l_far") + F.col("r_far") + F.lit(r + EPS)))
    # a row is two blocks, so a worker is handed a few at once
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 8)
    try:
        return cut(pairs.mapInPandas(join, "cid long, links long, root long"), "seen")
    finally:
        spark.conf.set(key, before)
        release(blocks)


def _join_blocks(x, kind: type, threshold: float, r: float) -> pd.DataFrame:
    """The links between two blocks: per class with one, their number and the smallest class of those that they connect."""
    same = x.l_bid == x.r_bid
    none = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
    ca, na, u = np.frombuffer(x.l_cids, np.int64), np.frombuffer(x.l_ns, np.int64), _unit(np.frombuffer(x.l_v, kind).reshape(-1, x.l_dim))
    cb, nb, w = (ca, na, u) if same else (np.frombuffer(x.r_cids, np.int64), np.frombuffer(x.r_ns, np.int64), _unit(np.frombuffer(x.r_v, kind).reshape(-1, x.l_dim)))
    if x.l_own != x.r_own:  # those that are at most r beyond the plane between the two pivots
        p, q = np.asarray(x.l_p), np.asarray(x.r_p)
        most = r * np.sqrt(((p - q) ** 2).sum()) + EPS
        i, j = np.flatnonzero(u @ (p - q) <= most), np.flatnonzero(w @ (q - p) <= most)
        ca, na, u, cb, nb, w = ca[i], na[i], u[i], cb[j], nb[j], w[j]
    if not len(ca) or not len(cb):
        return none
    u4, w4, margin = u.astype(np.float32), w.astype(np.float32).T, 1e-5 + 2e-7 * x.l_dim
    near = np.concatenate([u4[a: a + 512] @ w4 >= np.float32(threshold - margin) for a in range(0, len(u), 512)])
    if same:
        np.fill_diagonal(near, False)
    i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(i):
        return none
    ca, na, cb, nb, u, w = ca[i], na[i], cb[j], nb[j], u[i], w[j].T
    near = np.concatenate([u[a: a + 512] @ w >= threshold for a in range(0, len(u), 512)])
    if same:  # rows and columns are the same ones
        np.fill_diagonal(near, False)
    a, b = near.any(1), near.any(0)
    if not a.any():
        return none
    near = near[np.ix_(a, b)]
    la, lb = _labels(near, ca[a], cb[b], same)
    out = pd.DataFrame({"cid": ca[a], "links": near @ nb[b], "root": la})
    return out if same else pd.concat([out, pd.DataFrame({"cid": cb[b], "links": na[a] @ near, "root": lb})])


def _labels(near: np.ndarray, ca: np.ndarray, cb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest cid that each row and each column is connected with by the links of one task. same: rows and columns are one set.
    Every row of `near` is looked at once."""
    if same:  # near is symmetric, and rows without a link are gone from both sides alike
        cb = ca
    la, lb = np.full(len(ca), -1, np.int64), np.full(len(cb), -1, np.int64)
    for k in range(len(ca)):
        if la[k] >= 0:
            continue
        rows, cols, front = np.zeros(len(ca), bool), np.zeros(len(cb), bool), np.array([k])
        while len(front):
            rows[front] = True
            new = near[front].any(0) & ~cols
            cols |= new
            front = np.flatnonzero((near[:, new].any(1) | (new if same else False)) & ~rows)
        label = min(int(ca[rows].min()), int(cb[cols].min()) if cols.any() else int(ca[rows].min()))
        la[rows], lb[cols] = label, label
    return la, (la if same else lb)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, name: str = "embedding", cell: int = 4000, block: int = 4096, max_pivots: int = 16_384) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept."""
    distinct = classes_of(vectors, name)
    classes, pivots = routed_classes(distinct, cell, max_pivots)
    release(distinct)
    seen = range_links(classes, pivots, threshold, block)
    links = seen.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = min_labels(seen.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    c = classes.select("cid", "k1", "k2", "rep", "n").join(links, "cid", "left").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    c = cut(c.select("k1", "k2", "rep", "n", "links", F.coalesce("label", "cid").alias("label")), "labelled")
    release(classes, seen, labels)
    tops = c.groupBy("label").agg(F.min("rep").alias("component_id"))
    per_class = c.join(tops, "label").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    ok = F.coalesce(F.col("vec_id").isNotNull() & _usable(name), F.lit(False))
    usable = vectors.where(ok).select("vec_id", *_hashed(name)).join(per_class, ["k1", "k2"])
    rest = vectors.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable.select("vec_id", "n_links", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embed_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
with recursive v as (select row_number() over () as r, vec_id, cast(embedding as double[]) as e from embeddings),
u as (select * from v where vec_id is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.r as a, b.r as b from u a join u b on a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= cast(0.95 as double)),
reach(a, b) as (select r, r from u union select reach.a, links.b from reach join links on reach.b = links.a),
top as (select reach.a as r, min(v.vec_id) as top_id from reach join v on v.r = reach.b group by reach.a),
n as (select a as r, count(*) as n from links group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(top_id, vec_id) as component_id,
  coalesce(vec_id = coalesce(top_id, vec_id), false) as kept
from v left join top using (r) left join n using (r)
"""
