"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hot_joined, written

#: Edges contracted in one task.
_EDGES = 1_000_000


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes with edges i-j the smallest node of each node's component."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        before = lab.copy()
        for side in (i, j):
            np.minimum.at(lab, side, low)
            np.minimum.at(lab, before[side], low)
        lab = lab[lab]
        if (lab[i] == lab[j]).all():
            while (lab != lab[lab]).any():
                lab = lab[lab]
            break
    return lab


def _contract(batches):
    u, v = [], []
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
    if not u:
        return
    nodes, inverse = np.unique(np.concatenate([*u, *v]), return_inverse=True)
    half = len(inverse) // 2
    root = nodes[labels(len(nodes), inverse[:half], inverse[half:])]
    other = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that isn't its component's smallest; ``edges`` has long columns u and v.

    Each task first contracts a bounded share of the edges to stars; unless that was all of them, large-star and
    small-star rounds follow until nothing changes. Rounds are written to the shared folder. Minima are pre-aggregated
    and joined back, those of nodes with over a thousandth of all edges by broadcast, so such a node's edges are never
    gathered in one task.
    """
    e = written(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    parts = -(-e.count() // _EDGES)
    if parts > 1:
        e = e.repartition(parts, "u", "v")
    else:
        e = e.coalesce(1)
    e = written(e.mapInArrow(_contract, "u long, v long"), "edges")
    if parts > 1:
        before = None
        while (now := _mark(e)) != before:
            before = now
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
            large = hot_joined(both, low, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            e = written(large, "edges")
            low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = hot_joined(e, low, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
