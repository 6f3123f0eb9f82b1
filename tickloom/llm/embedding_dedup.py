"""Embedding near-dedup: all pairs with a high cosine, by PCA-ordered tiled comparison.

Vectors are rotated to their principal axes. Two tiles are compared on the leading axes first; with the norms of the
rest as a bound (Cauchy-Schwarz) almost all pairs stop there, and only pairs that could still reach the threshold
go on. Pairs of tiles whose boxes on the axes are too far apart aren't compared at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hot_joined, written
from .components import connected_components, labels

#: Leading axes of the first comparison, and of the second.
_FIRST, _SECOND = 16, 32
_SLACK = 1e-5
#: Most vectors whose places set the tiles' borders, and most boxes those borders make.
_SAMPLE, _LEAVES = 65_536, 1_024


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that squares of huge or tiny components don't leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches):
    total = None
    for b in batches:
        if b.num_rows:
            x = _unit(b.column(0).to_pylist())
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "x"])


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of all unit vectors, by falling weight; dim * dim sums come to the driver."""
    sums = vectors.select("embedding").mapInArrow(_moments, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    m = np.zeros(dim * dim)
    for r in sums:
        m[r.k] = r.x
    _, q = np.linalg.eigh(m.reshape(dim, dim))
    return q[:, ::-1].copy()


def _borders(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, float]]:
    """A balanced tree's splits, level by level, each along the axis on which its points spread most."""
    splits, groups = [], [points]
    for _ in range(depth):
        nxt = []
        for g in groups:
            axis = int(np.argmax(g.std(0))) if len(g) else 0
            cut = float(np.median(g[:, axis])) if len(g) else 0.0
            splits.append((axis, cut))
            nxt += [g[g[:, axis] < cut], g[g[:, axis] >= cut]]
        groups = nxt
    return splits


def _leaf(points: np.ndarray, splits: list, depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if depth:
        axis, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range(depth):
            right = points[np.arange(len(points)), axis[at]] >= cut[at]
            at = 2 * at + 1 + right
    return at - (2**depth - 1)


def _compare(key, rows: pd.DataFrame, axes: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links between two tiles (or within one): for each vector that has some, how many rows it links with and the
    smallest id its links lead to here."""
    rows = rows.sort_values("id", ignore_index=True)
    a, b = np.flatnonzero(rows.side.to_numpy() == 0), np.flatnonzero(rows.side.to_numpy() == 1)
    within = not len(b)
    b = a if within else b
    x = _unit(rows.embedding.tolist()) if len(rows) else np.zeros((0, len(axes)))
    r = x @ axes
    tail = {n: np.sqrt(np.maximum((r[:, n:] ** 2).sum(1), 0.0)) for n in (_FIRST, _SECOND)}
    lead = r[:, :_FIRST].astype(np.float32)
    rest = tail[_FIRST].astype(np.float32)
    count, weight = np.zeros(len(rows), np.int64), rows["size"].to_numpy()
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(a), 256):
        block = a[start : start + 256]
        reach = lead[block] @ lead[b].T
        reach += np.outer(rest[block], rest[b])
        i, j = np.nonzero(reach >= threshold - _SLACK)
        i, j = block[i], b[j]
        if within:
            i, j = i[i < j], j[i < j]
        kept_i, kept_j = [], []
        for c in range(0, len(i), 100_000):
            p, q = i[c : c + 100_000], j[c : c + 100_000]
            so_far = np.einsum("ij,ij->i", r[p, :_SECOND], r[q, :_SECOND])
            on = so_far + tail[_SECOND][p] * tail[_SECOND][q] >= threshold - _SLACK
            p, q = p[on], q[on]
            yes = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            kept_i.append(p[yes])
            kept_j.append(q[yes])
        if kept_i:
            i, j = np.concatenate(kept_i), np.concatenate(kept_j)
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            lab = labels(len(rows), i, j)
            other = np.flatnonzero(lab != np.arange(len(rows)))
            forest.append((other, lab[other]))
    lab = labels(len(rows), *(np.concatenate([f[k] for f in forest]) for k in (0, 1))) if forest else np.arange(len(rows))
    some = np.flatnonzero(count > 0)
    ids = rows.id.to_numpy()
    return pd.DataFrame({"id": ids[some], "links": count[some], "root": ids[lab[some]]})


def _links(vectors: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(id, links, root) rows of all tile pairs for vectors of one length; ``vectors``: id, size, embedding."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    axes, n = _axes(vectors, dim), vectors.count()
    depth = max(0, min(int(np.ceil(np.log2(max(n / tile, 1)))), int(np.log2(_LEAVES))))
    share = min(1.0, _SAMPLE / max(n, 1))
    bits = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(2**53)

    def lead(batches):
        for b in batches:
            if b.num_rows:
                points = _unit(b.column(0).to_pylist()) @ axes[:, :_FIRST]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary())], names=["p"])

    # only places on the leading axes come to the driver
    sample = vectors.where(bits < share).select("embedding").limit(2 * _SAMPLE).mapInArrow(lead, "p binary").collect() if depth else []
    splits = _borders(np.array([np.frombuffer(s.p) for s in sample]), depth) if sample else []
    depth = depth if splits else 0

    def place(batches):
        for b in batches:
            if b.num_rows:
                points = _unit(b.column(2).to_pylist()) @ axes
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_leaf(points, splits, depth))], names=["id", "size", "embedding", "leaf"])

    placed = written(vectors.select("id", "size", "embedding").mapInArrow(place, f"id long, size long, embedding {kind}, leaf long"), "vectors")

    def box(batches):
        for b in batches:
            if b.num_rows:
                points, leaf = _unit(b.column(2).to_pylist()) @ axes, b.column(3).to_numpy()
                for k in np.unique(leaf):
                    own = points[leaf == k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(k)] * dim), pa.array(range(dim), pa.int32()), pa.array(own.min(0)), pa.array(own.max(0)), pa.array([len(own)] * dim)],
                        names=["leaf", "axis", "low", "high", "n"],
                    )

    boxes = placed.mapInArrow(box, "leaf long, axis int, low double, high double, n long").groupBy("leaf", "axis")
    low, high, size = {}, {}, {}
    for r in boxes.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        low.setdefault(r.leaf, np.zeros(dim))[r.axis] = r.low
        high.setdefault(r.leaf, np.zeros(dim))[r.axis] = r.high
        size[r.leaf] = r.n
    leaves = sorted(size)
    subs = {k: -(-size[k] // tile) for k in leaves}
    base = dict(zip(leaves, np.cumsum([0, *(subs[k] for k in leaves)]).tolist(), strict=False))
    near = []  # pairs of boxes that can hold a link: unit vectors of cosine c are sqrt(2 - 2c) apart
    for k in leaves:
        for m in leaves:
            if k <= m:
                gap = np.maximum(0.0, np.maximum(low[k] - high[m], low[m] - high[k]))
                if (gap**2).sum() <= 2 - 2 * threshold + _SLACK:
                    near.append((k, m, base[k], subs[k], base[m], subs[m]))
    # each pair of tiles once: both tiles' rows meet under the pair's number
    boxed = spark.createDataFrame(near, "a long, b long, base_a long, subs_a long, base_b long, subs_b long")
    pairs = (
        boxed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs_a") - 1)).alias("i"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs_b") - 1)).alias("j"))
        .where("a < b or i <= j")
        .select((F.col("base_a") + F.col("i")).alias("left"), (F.col("base_b") + F.col("j")).alias("right"))
    )
    sides = pairs.select("left", "right", F.col("left").alias("tile"), F.lit(0).alias("side")).unionByName(
        pairs.where("left < right").select("left", "right", F.col("right").alias("tile"), F.lit(1).alias("side"))
    )
    numbers = spark.createDataFrame([(k, base[k], subs[k]) for k in leaves], "leaf long, base long, subs long")
    tiles = placed.join(F.broadcast(numbers), "leaf").withColumn("tile", F.col("base") + F.pmod(F.xxhash64("id"), F.col("subs")))
    return (
        tiles.select("id", "size", "embedding", "tile")
        .join(sides, "tile")
        .groupBy("left", "right")
        .applyInPandas(lambda key, rows: _compare(key, rows, axes, threshold), "id long, links long, root long")
    )


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, tile: int = 4096) -> DataFrame:
    """Every row of ``embeddings``: vec_id, n_links, component_id, kept.

    Two rows link if the cosine of their vectors is ``threshold`` or more, whatever their labels. Equal vectors are
    compared once: n_links counts rows, so a group of copies doesn't grow the work. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths with each other. The
    smallest reachable vec_id names the component and is kept. Rows with a null vec_id link with nothing. Repeated rows (same
    id and vector) link with each other. Components other than floats are taken as doubles. An empty table gives no rows; other columns are ignored.

    A task holds two tiles of ``tile`` vectors; the tiles' borders come from a bounded sample, their boxes from all vectors,
    and nothing is skipped but what a bound rules out.
    """
    exact = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = F.col("embedding").cast(exact)
    sound = F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull(), v).alias("embedding"),
    )
    good = rows.where(F.col("embedding").isNotNull())
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")), "vector-classes")
    dims = [r.dim for r in classes.select(F.size("embedding").alias("dim")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        own = _links(classes.where(F.size("embedding") == dim), dim, threshold, tile)
        found = own if found is None else found.unionByName(own)
    if found is None:
        links = comps = None
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        found = written(found, "vector-links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        comps = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
        reps = written(
            classes.join(links, "id", "left").join(comps, "id", "left").select(
                "embedding", "size",
                (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"),
            ),
            "vector-components",
        )
        alone = rows.where(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = hot_joined(good, reps, "embedding", "size").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
