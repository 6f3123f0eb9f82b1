"""MinHash near-dedup by a chosen-path set similarity join.

Independent random trees branch each document's signature by selected minwise tokens: a node picks one or two of the
coordinates, and documents with the same minimum there go on together, 1 / threshold branches a level on average. So
a similar pair stays together down to a node with a fair chance in each tree, and dissimilar ones part. Small nodes
are compared exhaustively by signature; what may be similar is then confirmed on the full sets. Documents with equal
sets are one class throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import _slices
from .common import hot_joined, row_key, rows_of, small_batches, written
from .components import connected_components, labels
from .lm_score import _from_planes, _planes
from .words import mix64

#: Coordinates of each of a document's two signatures; trees, which use the first; levels of a tree before nodes are first
#: counted, and how often again for those too large.
COORDINATES, TREES, LEVELS, MORE_LEVELS = 128, 10, 3, 2
#: Trees besides, which use the second signature, for documents of nodes that are too large: a deeper tree keeps fewer
#: pairs (0.48 at six levels, 0.38 at nine).
MORE_TREES = 12
#: Most documents of a node that are compared exhaustively, and of a group whose sets are in one task.
NODE, GROUP = 2_000, 3_000
#: Most shingles, of eight bytes each, of such a group together.
SHINGLES = 4_000_000
#: A pair at the threshold falls this far below it in its signatures with a chance under one in a million.
_SLACK = 0.18

_RNG = np.random.default_rng(20_240_101)
_A = (_RNG.integers(0, 2**31, (2, COORDINATES), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, (2, COORDINATES), dtype=np.uint32)


class Shingler:
    """Sets of hashed word shingles of whole texts."""

    def __init__(self, width: int, cap: int = 300_000):
        import xxhash

        self.width, self.cap, self.hash, self.known = width, cap, xxhash.xxh64_intdigest, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes: A-Z lower-cased, words apart at ASCII white space, runs of ``width`` words; all
        words as one where there are fewer, nothing without words."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.cap:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        with np.errstate(over="ignore"):
            out = h[: len(h) - width + 1]
            for k in range(1, width):
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signature(shingles: np.ndarray, which: int = 0) -> np.ndarray:
    """Minima of COORDINATES hash functions over the set; the second signature hashes other bits by other functions."""
    x = (shingles >> np.uint64(0 if which else 32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), 2048):
            out = np.minimum(out, (_A[which][:, None] * x[None, a : a + 2048] + _B[which][:, None]).min(1))
    return out


def _packed(minima: list[np.ndarray], sets: list[np.ndarray]) -> pa.Array:
    """The lowest byte of each minimum; null for an empty set."""
    return pa.array([m.astype(np.uint8).tobytes() if len(s) else None for m, s in zip(minima, sets, strict=True)], pa.binary())


def _descend(keys: np.ndarray, owner: np.ndarray, values: np.ndarray, levels: int, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Children, ``levels`` further down, of the nodes ``keys`` for the documents ``owner`` with signature ``values``.

    A node's key fixes which coordinates it picks: one, or with chance ``extra`` two.
    """
    for _ in range(levels):
        with np.errstate(over="ignore"):
            h = mix64(keys + np.uint64(0x9E3779B97F4A7C15))
            two = (h >> np.uint64(40)) % np.uint64(10_000) < np.uint64(extra * 10_000)
            first = (h % np.uint64(COORDINATES)).astype(np.int64)
            second = (first + 1 + ((h >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
            at = np.concatenate([first, second[two]])
            owner, keys = np.concatenate([owner, owner[two]]), np.concatenate([keys, keys[two]])
            keys = mix64(keys * np.uint64(0xD1B54A32D192ED03) + (at.astype(np.uint64) << np.uint64(32)) + values[owner, at].astype(np.uint64))
    return keys, owner


def _sketches(batches: Iterator[pa.RecordBatch], width: int, trees: int, extra: float) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(width)
    for batch, texts in _slices(batches, "text"):
        sets = [shingler.shingles(t) for t in texts.to_pylist()]
        minima = np.array([_signature(s) for s in sets], np.uint32).reshape(len(sets), COORDINATES)
        second = [_signature(s, 1) for s in sets]
        root = _roots(0, trees)
        keys, owner = _descend(np.tile(root, len(sets)), np.repeat(np.arange(len(sets)), trees), minima, LEVELS, extra)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(sets) + 1))
        keys = keys[order].view(np.int64)
        digests = [_digest(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([keys[a:b] if len(s) else None for a, b, s in zip(cuts[:-1], cuts[1:], sets, strict=True)], pa.list_(pa.int64())),
                _packed(minima, sets),
                _packed(second, sets),
            ],
            names=["doc_id", "row_key", "n_shingles", "digest", "keys", "sketch", "second"],
        )


def _alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Share of equal coordinates, less what one byte of a minimum agrees by chance."""
    return ((sketches == one).mean(1) - 1 / 256) / (255 / 256)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, COORDINATES)


def _compare_nodes(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Within each node all pairs by signature; a spanning forest of those that may be similar."""
    rows = rows.sort_values("key", kind="stable")
    key, ids, sketches = rows.key.to_numpy(), rows.id.to_numpy(), _matrix(rows.sketch)
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)] if len(key) else []
    u, v = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a == 1:
            continue
        if b - a == 2:
            if (sketches[a] == sketches[a + 1]).mean() >= least:
                u.append(ids[a : a + 1])
                v.append(ids[a + 1 : b])
            continue
        own, pending, i, j = sketches[a:b], np.arange(b - a), [], []
        while len(pending) > 1:  # each pair once; documents already reached from this one needn't be compared among each other
            one, pending = pending[0], pending[1:]
            hit = pending[_alike(own[pending], own[one]) >= least]
            i.append(np.full(len(hit), one))
            j.append(hit)
        i, j = np.concatenate(i), np.concatenate(j)
        lab = labels(b - a, i, j)
        other = np.flatnonzero(lab != np.arange(b - a))
        u.append(ids[a:b][other])
        v.append(ids[a:b][lab[other]])
    return pd.DataFrame({"u": np.concatenate([*u, np.zeros(0, np.int64)]), "v": np.concatenate([*v, np.zeros(0, np.int64)])})


def _confirm(rows: pd.DataFrame, percent: int, least: float) -> pd.DataFrame:
    """Links between full sets within each group: enough of them to connect what is connected.

    Pairs already connected aren't looked at again, so a group of m mutual near-copies takes m comparisons of sets.
    Rows marked ``only`` false are compared with rows marked true and not among themselves; rows of one ``own`` are connected
    from the start.
    """
    u, v = [], []
    for _, group in rows.groupby("gkey", sort=False):
        group = group.drop_duplicates("id").sort_values(["hub", "id"], ascending=[False, True])
        ids, sketches, loose = group.id.to_numpy(), _matrix(group.sketch), group.only.to_numpy()
        sets = [np.cumsum(_from_planes(s, 8), dtype=np.uint64) for s in group.set]
        size = np.array([len(s) for s in sets])
        comp = np.unique(group.own, return_inverse=True)[1]
        for i in range(len(ids) - 1):
            rest = np.arange(i + 1, len(ids))
            rest = rest[(loose[rest] | loose[i]) & (comp[rest] != comp[i])]
            if not len(rest):
                continue
            low, high = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
            rest = rest[(100 * low >= percent * high) & (_alike(sketches[rest], sketches[i]) >= least)]
            for j in rest.tolist():
                if comp[i] == comp[j]:
                    continue
                at = np.minimum(np.searchsorted(sets[i], sets[j]), size[i] - 1)
                both = int((sets[i][at] == sets[j]).sum())
                if 100 * both >= percent * (size[i] + size[j] - both):
                    u.append(ids[i])
                    v.append(ids[j])
                    comp[comp == comp[j]] = comp[i]
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _bucketed(df: DataFrame, key: str, groups: float) -> DataFrame:
    """Whole keys dealt to as many groups."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(groups)))))


def _shares(rows: Column, shingles: Column) -> Column:
    """How many groups rows fill, by their number and by the size of their sets."""
    return F.greatest(rows / GROUP, shingles / SHINGLES)


def _roots(first: int, trees: int) -> np.ndarray:
    return mix64(np.arange(first + 1, first + trees + 1, dtype=np.uint64))


def _levels(nodes: DataFrame, sketches: DataFrame, extra: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Of ``nodes`` (id, key, comp) those of two comps or more: (key, id) of nodes up to NODE, branched again by ``sketches``
    (id, sketch) where they were larger; (key, id, first, n) of nodes still larger after MORE_LEVELS times; the ids in nodes
    too large at first."""
    done = hot = None
    for again in range(MORE_LEVELS + 1):
        counts = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("comp").alias("a"), F.max("comp").alias("b"))
        counts = written(counts.where("a < b").drop("a", "b"), "node-counts")
        rows = written(hot_joined(nodes, counts, "key", "n"), "nodes")
        small, large = rows.where(F.col("n") <= NODE).select("key", "id"), rows.where(F.col("n") > NODE)
        done = small if done is None else done.unionByName(small)
        if large.limit(1).count() == 0:
            return done, None, hot
        hot = large.select("id").distinct() if hot is None else hot
        if again < MORE_LEVELS:

            def deeper(batches):
                for b in batches:
                    keys, values = b.column(0).to_numpy().view(np.uint64), _matrix(b.column(3).to_pylist())
                    keys, owner = _descend(keys, np.arange(len(keys)), values, LEVELS, extra)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(b.column(i).to_numpy()[owner]) for i in (1, 2)), pa.array(keys.view(np.int64))], names=["id", "comp", "key"]
                    )

            rows = large.join(sketches, "id").select("key", "id", "comp", "sketch")
            nodes = written(rows.mapInArrow(deeper, "id long, comp long, key long"), "deeper-nodes")
    return done, large.select("key", "id", "first", "n"), hot


def _blocks(large: DataFrame) -> DataFrame:
    """(key, id) of nodes above NODE in blocks that share the node's smallest document."""
    blocks = F.ceil(F.col("n") / NODE).cast("long")
    block = large.select(F.xxhash64("key", F.pmod(F.xxhash64("id", "key"), blocks)).alias("key"), "id")
    firsts = large.where("id = first").select(F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"), "key", "id")
    return block.unionByName(firsts.select(F.xxhash64("key", "b").alias("key"), "id"))


def _block_pairs(large: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, id) of nodes above NODE in pairs of blocks, about NODE documents a pair: each document outside a node's largest
    component meets all others of the node."""
    rows = large.select("key", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    main = rows.groupBy("key", "comp").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("comp", "many").alias("main"), F.sum("many").alias("n"))
    rows = hot_joined(rows, written(main, "node-mains"), "key", "n").select("key", "id", (F.col("comp") == F.col("main")).cast("int").alias("side"))
    half = max(1, NODE // 2)
    many = written(rows.groupBy("key", "side").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / half).cast("long")), "node-sides")
    rows = hot_joined(rows, many, ["key", "side"], "n").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    rows = written(rows.select("key", "id", "side", "block"), "node-blocks")
    each = many.select("key", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    a, b = each.where("side = 0").alias("a"), each.alias("b")
    pairs = a.join(b, "key").where((F.col("b.side") == 1) | (F.col("a.block") <= F.col("b.block")))
    ends = F.array_distinct(F.array(*(F.struct(F.col(f"{x}.side").alias("side"), F.col(f"{x}.block").alias("block")) for x in "ab")))
    pairs = pairs.select("key", F.xxhash64("key", "a.block", "b.side", "b.block").alias("pair"), F.explode(ends).alias("end"))
    pairs = pairs.select("key", "pair", "end.side", "end.block")
    return rows.join(pairs, ["key", "side", "block"]).select(F.col("pair").alias("key"), "id")


def _compared(nodes: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(u, v) of pairs of one node that may be similar, enough to connect what is connected."""
    nodes = written(nodes, "compared-nodes")
    rows = _bucketed(nodes.join(classes.select("id", "sketch"), "id"), "key", nodes.count() / 10_000)
    return written(rows.groupBy("bucket").applyInPandas(lambda g: _compare_nodes(g, least), "u long, v long"), "pairs")


def _candidates(classes: DataFrame, trees: int, extra: float, least: float) -> DataFrame:
    """Components of pairs that share a node and may be similar.

    Documents of nodes above NODE grow MORE_TREES more trees from their second signatures, of which only nodes with several
    components so far count.
    """
    sketches, second = classes.select("id", "sketch"), classes.select("id", F.col("second").alias("sketch"))
    small, large, hot = _levels(classes.select("id", F.explode("keys").alias("key"), F.col("id").alias("comp")), sketches, extra)
    pairs = _compared(small if large is None else small.unionByName(_blocks(large)), classes, least)
    group = connected_components(pairs)
    if hot is None:
        return group

    def grow(batches):
        root = _roots(trees, MORE_TREES)
        for b in batches:
            values = _matrix(b.column(2).to_pylist())
            keys, owner = _descend(np.tile(root, len(values)), np.repeat(np.arange(len(values)), len(root)), values, LEVELS, extra)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(b.column(i).to_numpy()[owner]) for i in (0, 1)), pa.array(keys.view(np.int64))], names=["id", "comp", "key"]
            )

    seeds = hot.join(second, "id").join(group, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "sketch")
    more, still, _ = _levels(written(seeds.mapInArrow(grow, "id long, comp long, key long"), "more-nodes"), second, extra)
    ends = [x.select("key", "id") for x in (large, still) if x is not None]
    if ends:
        more = more.unionByName(_block_pairs(ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1]), group))
    return connected_components(pairs.unionByName(_compared(more, classes, least)))


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (doc_id, digest, id and others) with their sets for doc_id and digest, made again from the texts."""
    others = [c for c in members.columns if c not in ("doc_id", "digest")]

    def run(batches):
        shingler = Shingler(width)
        for batch, texts in _slices(batches, "text"):
            sets = [shingler.shingles(t) for t in texts.to_pylist()]
            own = np.array([_digest(s) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)], bool)
            packed = [_planes(np.diff(s, prepend=np.uint64(0)), 8) for s in sets]
            kept = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(packed, pa.binary())], names=[*others, "set"])
            yield kept.filter(pa.array(own))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.select(*others).schema)
    return texts.join(members, "doc_id").select("text", "digest", *others).mapInArrow(run, f"{schema}, set binary")


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (component, side, id, n_shingles) with a tile each: rows of like length of one component and side, about GROUP
    of them or with SHINGLES shingles, whichever is fewer.

    Lengths are counted by classes two percent wide, so that no task sorts a whole component.
    """
    rows = rows.withColumn("length", F.floor(F.log("n_shingles") / F.log(F.lit(1.02))))
    shares = rows.groupBy("component", "side", "length").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("shingles"))
    shares = shares.select("component", "side", "length", "many", _shares(F.col("many"), F.col("shingles")).alias("fill"))
    so_far = Window.partitionBy("component", "side").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    shares = written(shares.withColumn("start", F.coalesce(F.sum("fill").over(so_far), F.lit(0.0))), "tile-shares")
    uniform = F.shiftrightunsigned(F.xxhash64("id", F.lit(2)), 11) / float(2**53)
    return hot_joined(rows, shares, ["component", "side", "length"], "many").withColumn("tile", F.floor(F.col("start") + uniform * F.col("fill")))


def _tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """(component, side, tile, gkey): the two tiles of each pair that has a left row and whose lengths allow a link."""
    spans = tiles.groupBy("component", "side", "tile").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = spans.where("side = 0").alias("a"), spans.alias("b")
    pairs = a.join(b, "component").where(
        ((F.col("b.side") == 1) | (F.col("a.tile") <= F.col("b.tile")))
        & (100 * F.col("a.high") >= percent * F.col("b.low"))
        & (100 * F.col("b.high") >= percent * F.col("a.low"))
    )
    gkey = F.xxhash64("component", "a.tile", "b.side", "b.tile").alias("gkey")
    ends = F.array_distinct(F.array(*(F.struct(F.col(f"{x}.side").alias("side"), F.col(f"{x}.tile").alias("tile")) for x in "ab")))
    return pairs.select("component", gkey, F.explode(ends).alias("end")).select("component", "end.side", "end.tile", "gkey")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= percent * union of their sets of ``width``-word shingles. The smallest doc_id
    that links lead to names the component and is kept. Rows without words are their own component; so are rows with a null id
    (component_id null, kept). Of repeated rows all have the same component_id and each with that doc_id is kept. An empty
    table gives no rows; other columns are ignored.

    A pair at the threshold shares a node of one tree with a chance of about 0.64 and misses all of ten trees with
    3 in 100,000; more similar pairs miss less, and links within a component back each other up. No node, group or
    candidate is capped: nodes above NODE branch again, and their documents grow MORE_TREES more trees, which draw on a second
    signature and so on other coordinates than the first. A simulation of signatures whose every node is large missed 4 of 300,000
    pairs at the threshold at six levels and 43 at nine. Nodes still larger are compared in pairs of blocks; groups of candidates above GROUP
    documents or SHINGLES shingles are confirmed block by block against common documents, and what that leaves unconnected in pairs of
    tiles of like length and at most about that size, but for pairs whose lengths rule a link out.
    """
    rows, names = _components(docs, width, percent, trees)
    named = hot_joined(rows.where("digest is not null").select("doc_id", "n_shingles", "digest"), names.select("digest", "component_id", "size"), "digest", "size", "left")
    single = rows.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = named.select("doc_id", "n_shingles", "component_id").unionByName(single)
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_rows(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row of each component of ``docs``, with all its columns, whatever their names.

    It is the one with the smallest doc_id, of several the one whose digest of id and text is smallest. Rows without words
    and rows with a null id stay. Of rows alike in id and text one stays. Decisions are by row, so an unrelated row
    with the id of a dropped one stays. Whole rows are shuffled once.
    """
    rows, names = _components(docs, width, percent, trees)
    best = names.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("best")).select("best.row_key")
    alone = rows.where("digest is null or doc_id is null").select("row_key").distinct()
    return rows_of(docs, row_key(docs["doc_id"].cast("long"), docs["text"]), best.unionByName(alone).distinct())


def _components(docs: DataFrame, width: int, percent: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n_shingles, digest; no digest without words) and the classes of equal sets (digest, size, doc_id and
    row_key of the first row, component, component_id), both written."""
    small_batches(docs.sparkSession)
    threshold = percent / 100
    extra, least = 1 / threshold - 1, threshold - _SLACK
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(
        source.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(
            lambda b: _sketches(b, width, trees, extra), "doc_id long, row_key binary, n_shingles long, digest binary, keys array<long>, sketch binary, second binary"
        ),
        "sketches",
    )
    classes = written(
        rows.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("size"),
            *(F.max(c).alias(c) for c in ("keys", "sketch", "second", "n_shingles")),
        )
        .select("digest", "first.*", "size", "keys", "sketch", "second", "n_shingles", F.monotonically_increasing_id().alias("id")),
        "set-classes",
    )
    group = _candidates(classes, trees, extra, least)
    group = written(group.unionByName(group.select(F.col("component").alias("id"), "component").distinct()), "candidates")
    grouped = written(classes.select("id", "doc_id", "digest", "sketch", "n_shingles").join(group, "id"), "grouped")
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = written(sizes.select("component", "n", F.ceil(_shares(F.col("n"), F.col("shingles"))).cast("long").alias("blocks")), "component-sizes")
    members = written(hot_joined(grouped, sizes, "component", "n"), "members")
    numbered = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    hub = F.xxhash64("id", F.lit(1)) % (F.floor(F.col("n") / 8) + 1) == 0  # about eight documents that all blocks share
    hubs = members.where("blocks > 1").where(hub).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["doc_id", "digest", "id", F.xxhash64("component", "block").alias("gkey"), "hub", "only", F.col("id").alias("own"), "sketch", "n_shingles"]
    confirm = lambda g: _confirm(g, percent, least)
    first = numbered.withColumn("hub", F.lit(False)).unionByName(hubs.withColumn("hub", F.lit(True))).withColumn("only", F.lit(True))
    first = written(first.select(*columns), "group-rows")
    fill = first.agg(_shares(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0)))).first()[0]
    dealt = _bucketed(_with_sets(source, first.drop("n_shingles"), width), "gkey", fill)
    links = written(dealt.groupBy("bucket").applyInPandas(confirm, "u long, v long"), "links")
    if numbered.where("blocks > 1").limit(1).count():
        so_far = connected_components(links)
        labelled = members.where("blocks > 1").join(so_far.withColumnRenamed("component", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
        main = labelled.groupBy("component", "own").agg(F.count("*").alias("many")).groupBy("component").agg(F.max_by("own", "many").alias("main"), F.sum("many").alias("members"))
        sided = hot_joined(labelled, written(main, "group-mains"), "component", "members").withColumn("side", (F.col("own") == F.col("main")).cast("int"))
        tiles = written(_tiles(sided.select("doc_id", "digest", "id", "component", "own", "side", "n_shingles", "sketch")), "tiles")
        pairs = written(_tile_pairs(tiles, percent), "tile-pairs")
        used = tiles.join(pairs.select("component", "side", "tile").distinct(), ["component", "side", "tile"], "left_semi")
        used = used.select("doc_id", "digest", "id", "component", "side", "tile", "own", "sketch")
        sets = written(_with_sets(source, used, width), "tile-sets")
        second = sets.join(pairs, ["component", "side", "tile"]).select(
            "id", "gkey", (F.col("side") == 0).alias("hub"), (F.col("side") == 0).alias("only"), "own", "sketch", "set"
        )
        links = links.unionByName(written(second.groupBy("gkey").applyInPandas(confirm, "u long, v long"), "links"))
    comps = connected_components(links)
    named = classes.select("id", "digest", "doc_id", "row_key", "size").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes"))
    names = hot_joined(named, smallest, "component", "classes")
    return rows, written(names.select("digest", "size", "doc_id", "row_key", "component", "component_id"), "component-names")
