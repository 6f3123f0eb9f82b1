"""Mutual information by k nearest neighbours, exact, as joins on cells of a grid.

Each pair of series is a set of points in the plane with the larger of both differences as distance. Values are scaled by their
deviation and rounded to whole multiples of 2 ** -32, so that differences, cells and ties are exact. Points stand in Morton
order, where the points of a square cell of any size are neighbours. If a point and the k-th one before or after it are in
one cell, that cell has k others, so the k-th neighbour is nearer than the cell is wide and lies in it or the eight round it:
the smallest such cell is where the point asks. One that is alone asks a large cell, one in a crowd a small cell, and of
those in a cell only few ask at its size, so the pairs that are made grow as the points do, however they are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.series import Order, dealt, finite
from ..functions.tables import written
from .bars import BARS
from .dependence import lagged

#: Binary places that scaled values keep, and bits of a cell's number on each axis.
_PLACES, _BITS = 32, 31
#: Candidates of a cell beyond this number are dealt to several tiles.
TILE = 4096


def digamma(n: Column) -> Column:
    """The digamma function for n >= 1, to about 1e-13."""
    z = n.cast("double") + 10
    r = 1 / (z * z)
    series = F.log(z) - 1 / (2 * z) - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return series - sum((1 / (z - i) for i in range(1, 11)), F.lit(0.0))


def _spread_bits(c: Column) -> Column:
    """The bits of a number below 2 ** 31 with a zero between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _lattice(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, v, n: each distinct point once with its number, as whole multiples of 2 ** -32 deviations."""
    whole = Window.partitionBy(*keys)
    pairs = pairs.select(*keys, finite("x").alias("x"), finite("y").alias("y")).where("x is not null and y is not null")
    scale = {c: F.stddev_pop(c).over(whole) for c in "xy"}
    scaled = pairs.select(*keys, *(F.rint(F.col(c) / F.when(s == 0, 1.0).otherwise(s) * 2.0**_PLACES).cast("long").alias(n) for n, (c, s) in zip("uv", scale.items(), strict=True)))
    return scaled.groupBy(*keys, "u", "v").agg(F.count("*").alias("n"))


def _celled(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``points`` with cell numbers a and b at the finest size, and t: how many bits fewer name the cell where the point asks."""
    whole = Window.partitionBy(*keys)
    low = {c: F.min(c).over(whole) for c in "uv"}
    span = F.greatest(*(F.max(c).over(whole) - low[c] for c in "uv"))
    drop = F.greatest(F.length(F.bin(span)) - _BITS, F.lit(0)).cast("int")
    points = points.withColumns({"_drop": drop, "_u0": low["u"], "_v0": low["v"]})
    cell = lambda c: F.call_function("shiftright", F.col(c) - F.col(f"_{c}0"), F.col("_drop"))
    points = points.withColumns({"a": cell("u"), "b": cell("v")}).drop("_drop", "_u0", "_v0")
    points = points.withColumn("_m", F.shiftleft(_spread_bits(F.col("a")), 1).bitwiseOR(_spread_bits(F.col("b"))))
    w = Window.partitionBy(*keys).orderBy("_m", "u", "v")

    def size(other: Column) -> Column:
        apart = F.col("_m").bitwiseXOR(other)
        return F.when(apart == 0, 0).otherwise(F.ceil(F.length(F.bin(apart)) / 2))

    t = F.least(size(F.lag("_m", k).over(w)), size(F.lead("_m", k).over(w)))
    return points.withColumn("t", F.coalesce(t, F.lit(_BITS)).cast("int")).drop("_m")


def kth_distance(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, u, v, n, d: the distance to the k-th other point, equal points counted as often as they occur; groups of k points or
    fewer are left out."""
    points = _celled(dealt(points, keys), keys, k)
    right = lambda c, by: F.call_function("shiftright", c, by)
    used = F.collect_set("t").over(Window.partitionBy(*keys))
    there = points.withColumn("_ts", used).select(*keys, "u", "v", "n", "a", "b", F.explode("_ts").alias("t"))
    there = there.select(*keys, "t", right(F.col("a"), F.col("t")).alias("ca"), right(F.col("b"), F.col("t")).alias("cb"), F.struct("u", "v", "n").alias("o"))
    cell = [*keys, "t", "ca", "cb"]
    crowded = there.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")  # few, so joins with them sort nothing
    tiles = F.coalesce("tiles", F.lit(1))
    there = there.join(crowded, cell, "left").withColumn("tile", F.pmod(F.xxhash64("o.u", "o.v"), tiles).cast("int")).drop("tiles")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asking = points.withColumn("_s", around)
    asking = asking.select(*keys, "t", (right(F.col("a"), F.col("t")) + F.col("_s.i")).alias("ca"), (right(F.col("b"), F.col("t")) + F.col("_s.j")).alias("cb"), "u", "v", "n")
    asking = asking.join(crowded, cell, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("tiles")
    met = asking.join(there.hint("merge"), [*cell, "tile"])  # points are small as a file, and the driver would hold all of them nine times
    d = F.greatest(F.abs(F.col("u") - F.col("o.u")), F.abs(F.col("v") - F.col("o.v")))
    met = met.select(*keys, "u", "v", "n", d.alias("d"), (F.col("o.n") - F.when(d == 0, 1).otherwise(0)).alias("w")).where("w > 0")
    met = dealt(met, [*keys, "u", "v"])  # else a task sorted all pairs of its series
    nearest = Window.partitionBy(*keys, "u", "v", "n").orderBy("d")
    met = met.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)
    so_far = met.withColumn("_w", F.sum("w").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
    return so_far.where(F.col("_w") >= k).groupBy(*keys, "u", "v", "n").agg(F.min("d").alias("d"))


def _within(points: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, psi_u, psi_v, pairs: on each axis the mean of digamma(neighbours + 1) over all points, others nearer than ``d`` there (as
    near, if d is 0), and how many points there are.

    Of each axis, points and both ends of every range stand sorted together; running sums at the ends give the counts.
    """
    near = F.greatest(F.col("d") - 1, F.lit(0))
    at = lambda axis, z, kind: F.struct(F.lit(axis).alias("axis"), z.alias("z"), F.lit(kind).alias("kind"))
    own = F.explode(F.array(*(at(c, F.col(c), 1) for c in "uv")))
    values = points.select(*keys, own.alias("e"), "n").groupBy(*keys, "e.axis", "e.z", "e.kind").agg(F.sum("n").alias("c"))
    values = values.select(*keys, "axis", "z", "kind", "c", F.lit(None).cast("struct<u:bigint,v:bigint,n:bigint>").alias("p"))
    ends = F.explode(F.array(*(at(c, F.col(c) + sign * near, kind) for c in "uv" for sign, kind in ((-1, 0), (1, 2)))))
    probes = asked.select(*keys, ends.alias("e"), F.struct("u", "v", "n").alias("p"))
    probes = probes.select(*keys, "e.axis", "e.z", "e.kind", F.lit(0).cast("long").alias("c"), "p")
    run = Window.partitionBy(*keys, "axis").orderBy("z", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt(values.unionByName(probes), [*keys, "axis"]).withColumn("s", F.sum("c").over(run)).where("p is not null")
    per = counted.groupBy(*keys, "axis", "p").agg((F.max("s") - F.min("s")).alias("m"))  # the point itself is among them
    psi = [(F.sum(F.when(F.col("axis") == c, F.col("p.n") * digamma(F.col("m")))) / F.sum(F.when(F.col("axis") == c, F.col("p.n")))).alias(f"psi_{c}") for c in "uv"]
    total = points.groupBy(*keys).agg(F.sum("n").alias("pairs"))
    return total.join(per.groupBy(*keys).agg(*psi).hint("merge"), keys, "left")


def neighbour_information(df: DataFrame, x: str, y: str, lags: list[int], k: int = 5, order: Order = BARS) -> DataFrame:
    """keys, lag, value, pairs: the mutual information (nats, never below 0) of x at t and y at t + lag by ``k`` nearest neighbours.

    psi(n) + psi(k) less the means of psi(neighbours + 1) on either axis, nearer than the k-th neighbour in the plane. Pairs with a
    value that isn't finite go; null for k pairs or fewer. No noise is added to break ties. Points and their distances are written to
    the shared folder once, so no step makes the bars anew or holds them beside its own rows.
    """
    keys = [*order.keys, "lag"]
    pairs = lagged(df, x, y, [-j for j in lags], order).withColumn("lag", -F.col("lag"))
    points = written(_lattice(pairs, keys), "points")
    asked = written(kth_distance(points, keys, k), "distances")
    value = digamma(F.col("pairs")) + digamma(F.lit(k)) - F.col("psi_u") - F.col("psi_v")
    out = _within(points, asked, keys)
    return out.select(*keys, F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))).alias("value"), "pairs")
