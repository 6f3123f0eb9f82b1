"""Exact k-means over integer vectors by progressive search in the Walsh-Hadamard domain.

Vectors and centroids are transformed by the unnormalised Walsh-Hadamard matrix, which is exact in integers and makes every
squared distance ``dims`` times as large. Coefficients are taken from coarse to fine (by sequency): the first ones give
each vector a likely centroid, whose distance over all coefficients is its bound; every other centroid adds up squared
differences block by block and is out as soon as its partial sum is strictly above the bound. Those never out have all
their coefficients summed, so ties are seen and the smaller number wins.

Where a component is so large that 64-bit sums could overflow, the same code runs on Python integers, so results are
always exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Integer components up to this size keep all 64-bit sums exact for up to 256 dimensions.
_SAFE = 1 << 18
#: Sums travel in limbs of so many bits.
_LIMB = 40


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two ``scale``, as 64-bit integers or, where they could overflow later, Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not len(x) or np.abs(scaled).max() <= _SAFE:
        return scaled.astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def walsh(x: np.ndarray) -> np.ndarray:
    """The unnormalised transform of each row, coefficients by rising sequency (number of sign changes)."""
    n, dims = x.shape
    y, step = x, 1
    while step < dims:
        y = y.reshape(n, dims // (2 * step), 2, step)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, dims)
        step *= 2
    return y[:, _by_sequency(dims)]


def _by_sequency(dims: int) -> list[int]:
    """Rows of the natural order sorted by their number of sign changes."""
    sign = lambda i, j: (i & j).bit_count() & 1
    return sorted(range(dims), key=lambda i: sum(sign(i, j) != sign(i, j + 1) for j in range(dims - 1)))


def _blocks(dims: int, first: int = 8) -> list[tuple[int, int]]:
    """Coefficients from coarse to fine: the first few, then as many again each time."""
    cuts = [0, min(first, dims)]
    while cuts[-1] < dims:
        cuts.append(min(2 * cuts[-1], dims))
    return list(zip(cuts, cuts[1:], strict=False))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (of equals the smaller number), its squared distance, and how many pairs were eliminated."""
    n, dims, k = len(x), x.shape[1], len(centroids)
    if not n or not k:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    tx, tc = walsh(x), walsh(centroids)
    blocks = _blocks(dims)

    def added(rows, cents, a, b):
        d = tx[rows, a:b] - tc[cents, a:b]
        return (d * d).sum(1)

    a, b = blocks[0]
    part = np.stack([added(np.arange(n), np.full(n, c), a, b) for c in range(k)], 1)
    guess, every = part.argmin(1), np.arange(n)
    best, bound = guess.copy(), part[every, guess] + added(every, guess, b, dims)
    other = np.ones((n, k), bool)
    other[every, guess] = False
    rows, cents = np.nonzero(other)
    sums, out = part[rows, cents], 0
    for a, b in [(0, 0), *blocks[1:]]:
        if b:
            sums = sums + added(rows, cents, a, b)
        alive = ~(sums > bound[rows])
        out += int((~alive).sum())
        rows, cents, sums = rows[alive], cents[alive], sums[alive]
    order = np.lexsort((cents, sums, rows)) if sums.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], sums[i], cents[i])), np.int64)
    rows, cents, sums = rows[order], cents[order], sums[order]
    top = np.append(True, rows[1:] != rows[:-1])[: len(rows)]  # each row's least survivor
    rows, cents, sums = rows[top], cents[top], sums[top]
    win = (sums < bound[rows]) | ((sums == bound[rows]) & (cents < best[rows]))
    bound[rows[win]], best[rows[win]] = sums[win], cents[win]
    return best, bound // dims, out


def _vectors(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield batch, integers(values.reshape(batch.num_rows, dims), scale)


def _packed(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) <= _SAFE for r in rows for v in r)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[tuple[int, int], int]:
    """By (cluster, component) the sum of the assigned vectors, and by (cluster, -1) their number: at most k * (dims + 1) numbers.

    A task adds up its own vectors; limbs of 40 bits make the sums over tasks exact whatever the components' size.
    """

    def run(batches):
        own: dict[tuple[int, int], int] = {}
        cents = _packed(centroids)
        for _, x in _vectors(batches, dims, scale):
            at, _, _ = nearest(x, cents)
            for c in np.unique(at).tolist():
                mine = x[at == c]
                for j, s in enumerate([*mine.sum(0).tolist(), len(mine)]):
                    place = (c, j if j < dims else -1)
                    own[place] = own.get(place, 0) + int(s)
        out = []
        for (c, j), s in own.items():
            sign, s, limb = (-1, -s, 0) if s < 0 else (1, s, 0)
            while s or not limb:
                out.append((c, j, limb, sign * (s & ((1 << _LIMB) - 1))))
                s, limb = s >> _LIMB, limb + 1
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["c", "j", "limb", "v"])

    parts = vectors.mapInArrow(run, "c int, j int, limb int, v long").groupBy("c", "j", "limb").agg(F.sum("v").alias("v"))
    total: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        total[r.c, r.j] = total.get((r.c, r.j), 0) + (int(r.v) << (_LIMB * r.limb))
    return total


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, dims: int = 64, column: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after ``rounds`` rounds, written to the shared folder; and the centroids.

    Vectors with exactly ``dims`` components (a power of two), none null, NaN or infinite, are kept; component x becomes
    the integer floor(scale * x). The start is the k kept vectors with the smallest sha256 of ``seed:vec_id`` (null ids
    last; of equal ids the smaller vector first); fewer vectors give fewer clusters, none an empty result. An emptied
    centroid stays. Repeated rows count as often as they occur. ``distance`` is squared, a decimal; null above 38
    digits. Other columns are left out, so their names can't clash. Each round reads the table once and sends k * (dims + 1)
    sums to the driver; no vector is shuffled.
    """
    if dims < 1 or dims & (dims - 1) or scale < 1 or scale & (scale - 1):
        raise ValueError("dims and scale must be powers of two")
    sound = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = vectors.where((F.size(column) == dims) & F.col(column).isNotNull()).where(sound)
    kept = kept.select("vec_id", F.col(column).cast("array<double>").alias("vector"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "vector").limit(k).collect()
    centroids = [[int(v) for v in integers(np.array([r.vector]), scale)[0].tolist()] for r in first]
    for _ in range(rounds if centroids else 0):
        total = _sums(kept, centroids, dims, scale)
        centroids = [[total[c, j] // total[c, -1] for j in range(dims)] if (c, -1) in total else old for c, old in enumerate(centroids)]

    def assign(batches):
        cents, kind = _packed(centroids), pa.decimal128(38, 0)
        for batch, x in _vectors(batches, dims, scale):
            at, d, _ = nearest(x, cents)
            if d.dtype == object:
                from decimal import Decimal

                d = pa.array([Decimal(v) if v < 10**38 else None for v in d.tolist()], kind)
            else:
                d = pa.array(d, pa.int64()).cast(pa.decimal128(19, 0)).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), d], names=["vec_id", "cluster", "distance"])

    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance decimal(38,0)"
    return written(kept.mapInArrow(assign, schema), "clusters"), centroids


def clusters_with_sums(vectors: DataFrame, **options) -> DataFrame:
    """:func:`cluster`'s rows with ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and
    ``centroid_sha256``; distances and sums beyond a long are null."""
    rows, centroids = cluster(vectors, **options)
    whole = lambda: F.when(F.count("*") == F.count("distance"), F.sum("distance"))
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(whole().alias("s")).collect()}  # k rows
    total = sum(sums.values()) if all(v is not None for v in sums.values()) else None
    long = lambda v: int(v) if v is not None and v < 2**63 else None
    told = [
        (c, long(sums.get(c, 0)), long(total), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)
    ]
    per = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(per), "cluster")
    return out.select("vec_id", "cluster", F.col("distance").try_cast("bigint").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
