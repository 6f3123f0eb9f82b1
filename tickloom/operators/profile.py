"""All lag measures of two series as one long table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.series import Order, finite
from ..functions.tables import written
from . import dependence
from .bars import BARS

#: Half the width of a 95 % band in standard errors.
_BAND = 1.959963984540054
#: Measures that are I(a; b | c) of counted cells, and whether values below 0 become 0.
_CLAMPED = {"information": False, "space_time": False, "symbol_information": False, "transfer_histogram": False, "transfer": True, "self_transfer": True}


#: Rows of a block.
_BLOCK = 2048


@dataclass(frozen=True)
class Profile:
    """Names of the two series and of their symbols, the longest lag, and bins: of information by lag, of the space-time matrix,
    and the most of transfer entropy by histograms. ``fewest`` pairs are due for information of symbols."""

    x: str
    y: str
    x_symbol: str
    y_symbol: str
    longest: int = 20
    bins: int = 20
    matrix_bins: int = 30
    most: int = 64
    missing: int = -1
    fewest: int = 50


def lag_profile(df: DataFrame, p: Profile, order: Order = BARS) -> DataFrame:
    """keys, measure, lag, ahead, value, pairs, low, high: one row for each measure and lag of each series.

    The series are the rows where both values are finite; other rows go first. Measures:

    * ``correlation``: :func:`dependence.cross_correlation`, lags from -longest; low and high are its band round 0.
    * ``autocorrelation``: of x from lag 0, distances from its mean over all of its variance; low and high are the value's 95 % band,
      which widens with the squares of the shorter lags' values. Null for a constant.
    * ``self_correlation``: of x, :func:`dependence.autocorrelation`.
    * ``information``: :func:`dependence.histogram_information`, lags from -longest.
    * ``space_time``: :func:`dependence.space_time_information`, lag rows back and ``ahead`` rows ahead (0 in other measures).
    * ``symbol_information``: :func:`dependence.mutual_information` of x's symbols with themselves.
    * ``transfer_histogram``: :func:`dependence.histogram_transfer_entropy` by delay.
    * ``transfer``, ``self_transfer``: :func:`dependence.transfer_entropy` of x's symbols to y's and to their own.
    * ``counterfactual``: :func:`dependence.counterfactual_entropy` of x's symbols to y's.

    A row takes its last 2 * longest rows along in one array, so a series moves once in each of two passes over its few
    columns, which are written first: sums and ranges by lag, then counts of cells. Ranges come back as one array for each series. Information of every kind is the same sum
    over the one table of counts, which is written.
    """
    keys, reach = list(order.keys), 2 * p.longest
    now = F.struct(*(F.col(c).cast(t).alias(n) for c, t, n in ((p.x, "double", "x"), (p.y, "double", "y"), (p.x_symbol, "int", "sx"), (p.y_symbol, "int", "sy"))))
    sound = df.where(finite(p.x).isNotNull() & finite(p.y).isNotNull()).select(*keys, *order.by, now.alias("_now"))
    place = (F.row_number().over(order.rows()) - 1).alias("_place")
    sound = written(sound.select(*keys, place, "_now"), "profile-rows")
    constants = sound.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.stddev_pop("_now.x").alias("dx"), F.stddev_pop("_now.y").alias("dy"), F.var_pop("_now.x").alias("vx"),
        F.avg("_now.x").alias("_mx"), F.avg("_now.y").alias("_my"),
        dependence.quartile_bins("_now.x", p.most).alias("bx"), dependence.quartile_bins("_now.y", p.most).alias("by"),
        *((F.max(F.when(F.col(c) != p.missing, F.col(c))) + 1).cast("int").alias(n) for c, n in (("_now.sx", "kx"), ("_now.sy", "ky"))),
    )
    constants = written(constants, "profile-series")
    wide = _with_past(sound, keys, reach).join(F.broadcast(constants.select(*keys, "_mx", "_my")), keys)
    sums, ranges = _by_lag(wide, keys)
    counts = written(_counts(wide, ranges, constants, keys, p), "profile-counts")
    parts = [_correlations(sums, constants, keys, p), _information(counts, keys, p), _counterfactual(counts, constants, keys, p, order)]
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def _with_past(sound: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """keys, _now, _past: each row and its last ``reach`` ones, itself first.

    Series are cut into blocks, and a block's last rows go to the next one too, so that a long series is many tasks' work. The
    number of tasks is given, since a few megabytes here become some hundred times as many cells.
    """
    size, n = max(_BLOCK, reach), int(sound.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.floor(F.col("_place") / size)
    both = F.array(own, F.when(F.col("_place") % size >= size - reach, own + 1))
    dealt = sound.withColumn("_block", F.explode(both)).where("_block is not null").repartition(n, *keys, "_block")
    past = F.collect_list("_now").over(Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-reach, 0))
    return dealt.withColumn("_past", F.reverse(past)).where(F.col("_block") == own).select(*keys, "_now", "_past")


def _by_lag(wide: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums of products by lag, and for each series the ranges of the values paired at each lag, from 0 on."""
    each = wide.select(*keys, "_now", "_mx", "_my", F.posexplode("_past").alias("_k", "_then"))
    x, y = F.col("_now.x") - F.col("_mx"), F.col("_now.y") - F.col("_my")
    x0, y0 = F.col("_then.x") - F.col("_mx"), F.col("_then.y") - F.col("_my")
    low_high = [f(f"{row}.{c}").alias(f"{row}_{c}_{n}") for row in ("_now", "_then") for c in "xy" for f, n in ((F.min, "low"), (F.max, "high"))]
    sums = each.groupBy(*keys, "_k").agg(
        F.count("*").alias("pairs"), F.sum(x * y0).alias("later"), F.sum(x0 * y).alias("earlier"), F.sum(x * x0).alias("own"),
        dependence.pearson(F.col("_now.x"), F.col("_then.x")).alias("pearson"), *low_high,
    )
    sums = written(sums, "profile-sums")
    row = F.struct("_k", *(c for c in sums.columns if c.endswith(("_low", "_high"))))
    return sums, sums.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_ranges"))


def _counts(wide: DataFrame, ranges: DataFrame, constants: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    """keys, measure, lag, a, b, c, cnt."""
    rows = wide.join(ranges, keys).join(constants.select(*keys, "bx", "by"), keys)
    rows = rows.select(*keys, "_now", "bx", "by", "_ranges", F.expr("get(_past, 1)").alias("_prev"), F.posexplode("_past").alias("_k", "_then"))
    rows = rows.withColumn("_r", F.get("_ranges", F.col("_k"))).drop("_ranges")
    k, none = F.col("_k"), F.lit(0)
    span = lambda c: (F.col(c), *(F.col(f"_r.{c.replace('.', '_')}_{n}") for n in ("low", "high")))
    even = lambda c, n: dependence.width_bin(*span(c), n)
    edge = lambda c, n: dependence.edge_bin(*span(c), F.col(n))
    cell = lambda name, lag, a, b, c=none: F.struct(F.lit(name).alias("measure"), lag.cast("int").alias("lag"), a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    near, later = k <= p.longest, (k >= 1) & (k <= p.longest)
    s = lambda c: F.col(c)
    known = (s("_now.sx") != p.missing) & (s("_then.sx") != p.missing)
    cells = F.array(
        F.when(near, cell("information", k, even("_then.x", p.bins), even("_now.y", p.bins))),
        F.when(later, cell("information", -k, even("_now.x", p.bins), even("_then.y", p.bins))),
        cell("space_time", k, even("_then.x", p.matrix_bins), even("_now.y", p.matrix_bins)),
        F.when(later & known, cell("symbol_information", k, s("_now.sx"), s("_then.sx"))),
        F.when(later, cell("transfer_histogram", k, edge("_then.y", "by"), edge("_then.x", "bx"), edge("_now.x", "bx"))),
        F.when(later, cell("transfer", k, s("_now.sy"), s("_then.sx"), s("_prev.sy"))),
        F.when(later & (k >= 2), cell("self_transfer", k, s("_now.sx"), s("_then.sx"), s("_prev.sx"))),
    )
    each = rows.select(*keys, F.explode(cells).alias("_c")).where("_c.a is not null and _c.b is not null and _c.c is not null")
    return each.groupBy(*keys, "_c.measure", "_c.lag", "_c.a", "_c.b", "_c.c").agg(F.count("*").alias("cnt"))


def _correlations(sums: DataFrame, constants: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    df = sums.join(constants.select(*keys, "rows", "dx", "dy", "vx"), keys)
    k, pairs, scale = F.col("_k"), F.col("pairs"), F.col("dx") * F.col("dy")
    cross = lambda c: F.when(F.col("rows") >= 2, F.when(scale > 0, F.col(c) / pairs / scale).otherwise(0.0))
    own = F.try_divide(F.col("own"), F.col("rows") * F.col("vx"))
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    # of lag 0 the square is left out, and lag 0 itself has no band
    wide = F.coalesce(F.sum(F.when(k > 0, own * own)).over(before), F.lit(0.0))
    band = F.when(k == 0, 0.0).otherwise(_BAND * F.sqrt((1 + 2 * wide) / F.col("rows")))
    df = df.withColumns({"_own": own, "_band": band})
    row = lambda name, lag, value, low, high: F.struct(F.lit(name).alias("measure"), lag.cast("int").alias("lag"), value.cast("double").alias("value"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    ci, none = F.lit(_BAND) / F.sqrt(pairs), F.lit(None)
    each = F.array(
        row("correlation", k, cross("later"), -ci, ci),
        F.when(k > 0, row("correlation", -k, cross("earlier"), -ci, ci)),
        row("autocorrelation", k, F.col("_own"), F.col("_own") - F.col("_band"), F.col("_own") + F.col("_band")),
        F.when(k > 0, row("self_correlation", k, F.col("pearson"), none, none)),
    )
    out = df.where(k <= p.longest).select(*keys, "pairs", F.explode(each).alias("_r")).where("_r is not null")
    return out.select(*keys, "_r.measure", "_r.lag", F.lit(0).alias("ahead"), "_r.value", "pairs", "_r.low", "_r.high")


def _information(counts: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    by = [*keys, "measure", "lag"]
    clamp: Column = F.col("measure").isin(*(m for m, yes in _CLAMPED.items() if yes))
    told = dependence.conditional_of_counts(counts, by, clamp)
    told = told.withColumn("value", F.when((F.col("measure") != "symbol_information") | (F.col("pairs") >= p.fewest), F.col("value")))
    # a cell of the matrix depends on how far apart its two rows are
    inside = F.sequence(F.greatest(F.col("lag") - p.longest, F.lit(0)), F.least(F.col("lag"), F.lit(p.longest)))
    ahead = F.when(F.col("measure") == "space_time", inside).otherwise(F.array(F.lit(0)))
    told = told.withColumn("ahead", F.explode(ahead)).withColumn("lag", F.col("lag") - F.col("ahead"))
    return told.select(*by, "ahead", "value", "pairs")


def _counterfactual(counts: DataFrame, constants: DataFrame, keys: list[str], p: Profile, order: Order) -> DataFrame:
    """The same triples as ``transfer``, of symbols that are there."""
    rows = counts.where("measure = 'transfer' and a >= 0 and b >= 0 and c >= 0").where((F.col("a") != p.missing) & (F.col("b") != p.missing) & (F.col("c") != p.missing))
    cells = rows.select(*keys, "lag", F.col("a").alias("y"), F.array("c").alias("h"), F.col("b").alias("x"), "cnt")
    told = dependence.counterfactual_of_counts(cells, constants.select(*keys, "kx", "ky", "rows"), list(range(1, p.longest + 1)), 1, 1.0, order)
    return told.select(*keys, F.lit("counterfactual").alias("measure"), "lag", F.lit(0).alias("ahead"), "value", "pairs")
