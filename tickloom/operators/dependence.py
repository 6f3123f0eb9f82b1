"""Dependence of series over lags: correlation, mutual information, transfer entropy. Information is in bits.

Each profile is one plan: the lags are exploded, pairs or triples counted and the counts reduced, so work is linear in
rows times lags and nothing but counts moves after the first shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.series import Order, finite
from .bars import BARS


def lagged(df: DataFrame, x: str, y: str, lags: list[int], order: Order = BARS) -> DataFrame:
    """keys, lag, x, y: for lag k >= 0 x at t + k with y at t; for k < 0 x at t with y at t - k."""
    at = lambda c, k: F.lag(c, k).over(order.rows()) if k else F.col(c)
    place, n = F.row_number().over(order.rows()), F.count("*").over(Window.partitionBy(*order.keys))
    cells = df.select(*order.keys, place.alias("_place"), n.alias("_n"), *(F.struct(at(x, max(-k, 0)).alias("x"), at(y, max(k, 0)).alias("y")).alias(f"_l{i}") for i, k in enumerate(lags)))
    rows = F.explode(F.array(*(F.when(F.col("_place") > abs(k), F.struct(F.lit(k).alias("lag"), F.col(f"_l{i}.x").alias("x"), F.col(f"_l{i}.y").alias("y"))) for i, k in enumerate(lags))))
    return cells.select(*order.keys, "_n", rows.alias("_r")).where("_r is not null").select(*order.keys, "_n", "_r.lag", "_r.x", "_r.y")


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null below two pairs and for a constant, where ``corr`` fails in ANSI mode."""
    return F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def autocorrelation(df: DataFrame, x: str, longest: int, order: Order = BARS) -> DataFrame:
    """Pearson correlation of the series with itself ``lag`` rows before; null below two pairs and for a constant."""
    keys = [*order.keys, "lag"]
    pairs = lagged(df, x, x, list(range(1, longest + 1)), order)
    x, y = finite("x"), finite("y")  # pairs without both go
    return pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(pearson(x, y).alias("value"))


def cross_correlation(df: DataFrame, x: str, y: str, longest: int, order: Order = BARS) -> DataFrame:
    """For lags from -longest to longest the mean product of both series' distances from their own means, over their deviations.

    Rows where either isn't finite go first; 0 for a constant series; null below two rows. ``ci`` is the half-width
    of the 95 % band, 1.959963984540054 / sqrt(pairs).
    """
    keys = list(order.keys)
    sound = df.where(finite(x).isNotNull() & finite(y).isNotNull())
    whole = Window.partitionBy(*keys)
    scaled = sound.select(
        *keys, *order.by,
        *((F.col(c).cast("double") - F.avg(c).over(whole)).alias(f"_{n}") for c, n in ((x, "x"), (y, "y"))),
        (F.stddev_pop(x).over(whole) * F.stddev_pop(y).over(whole)).alias("_s"),
    )
    scales = scaled.groupBy(*keys).agg(F.max("_s").alias("_s"))
    out = lagged(scaled, "_x", "_y", list(range(-longest, longest + 1)), order).groupBy(*keys, "lag").agg(
        F.avg(F.col("x") * F.col("y")).alias("_p"), F.count("*").alias("pairs"), F.max("_n").alias("_n")
    )
    value = F.when(F.col("_n") >= 2, F.when(F.col("_s") > 0, F.col("_p") / F.col("_s")).otherwise(0.0))
    return out.join(scales, keys).select(*keys, "lag", value.alias("value"), "pairs", (F.lit(1.959963984540054) / F.sqrt("pairs")).alias("ci"))


def _information(counts: DataFrame, keys: list[str], clamp: bool, fewest: int = 0) -> DataFrame:
    """Mutual information of x and y from (keys, x, y, cnt)."""
    by = lambda *c: F.sum("cnt").over(Window.partitionBy(*keys, *c))
    c = counts.select(*keys, "cnt", by().alias("n"), by("x").alias("nx"), by("y").alias("ny"))
    terms = F.col("cnt") / F.col("n") * F.log2(F.col("cnt") * F.col("n") / (F.col("nx") * F.col("ny")))
    mi = F.sum(terms)
    mi = F.greatest(mi, F.lit(0.0)) if clamp else mi
    return c.groupBy(*keys).agg(F.when(F.max("n") >= fewest, mi).alias("value"), F.max("n").alias("pairs"))


def mutual_information(df: DataFrame, x: str, y: str, lags: list[int], missing: int | None = -1, fewest: int = 50, clamp: bool = False, order: Order = BARS) -> DataFrame:
    """Of two symbol series for each lag (x later for positive ones); pairs with a missing symbol go."""
    keys = [*order.keys, "lag"]
    pairs = lagged(df, x, y, lags, order)
    if missing is not None:
        pairs = pairs.where((F.col("x") != missing) & (F.col("y") != missing))
    return _information(pairs.groupBy(*keys, "x", "y").agg(F.count("*").alias("cnt")), keys, clamp, fewest)


def entropy(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    c = df.groupBy(*keys, x).agg(F.count("*").alias("cnt"))
    c = c.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys)))
    return c.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("value"))


def width_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the highest value is in the last one; a constant's range is widened by a half each way."""
    flat = low == high
    a, b = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    return F.least(F.floor((v - a) / (b - a) * bins), F.lit(bins - 1)).cast("int")


def histogram_information(df: DataFrame, x: str, y: str, lags: list[int], bins: int = 30, order: Order = BARS) -> DataFrame:
    """Mutual information of equal-width bins for (x at t, y at t + lag): the other sign of lag than above.

    The bins span the values paired at that lag; pairs with a value that isn't finite go.
    """
    keys = [*order.keys, "lag"]
    pairs = lagged(df, x, y, [-k for k in lags], order).withColumn("lag", -F.col("lag"))
    pairs = pairs.where(finite("x").isNotNull() & finite("y").isNotNull())
    w = Window.partitionBy(*keys)
    binned = pairs.select(*keys, *(width_bin(F.col(c).cast("double"), F.min(c).over(w), F.max(c).over(w), bins).alias(c) for c in ("x", "y")))
    return _information(binned.groupBy(*keys, "x", "y").agg(F.count("*").alias("cnt")), keys, False)


def space_time_information(df: DataFrame, x: str, y: str, back: int, ahead: int, bins: int = 30, order: Order = BARS) -> DataFrame:
    """The matrix of (x at t - l, y at t + m): depends on l + m alone up to the ends, each cell over its own pairs."""
    flat = histogram_information(df, x, y, list(range(back + ahead + 1)), bins, order).withColumnRenamed("lag", "apart")
    cells = df.sparkSession.range(back + 1).select(F.col("id").cast("int").alias("back")).withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(ahead))))
    return flat.join(F.broadcast(cells), F.col("apart") == F.col("back") + F.col("ahead")).drop("apart")


def _conditional(df: DataFrame, keys: list[str], clamp: bool = True) -> DataFrame:
    """I(a; b | c) from rows (keys, a, b, c)."""
    return conditional_of_counts(df.groupBy(*keys, "a", "b", "c").agg(F.count("*").alias("cnt")), keys, clamp)


def conditional_of_counts(n: DataFrame, keys: list[str], clamp: bool | Column = True) -> DataFrame:
    """I(a; b | c) from counts (keys, a, b, c, cnt); ``clamp`` may be an expression of the keys."""
    by = lambda *c: F.sum("cnt").over(Window.partitionBy(*keys, *c))
    n = n.select(*keys, "cnt", by().alias("n"), by("c").alias("nc"), by("a", "c").alias("nac"), by("b", "c").alias("nbc"))
    te = F.sum(F.col("cnt") / F.col("n") * F.log2(F.col("cnt") * F.col("nc") / (F.col("nac") * F.col("nbc"))))
    told = n.groupBy(*keys).agg(te.alias("value"), F.max("n").alias("pairs"))
    return told.withColumn("value", F.when(F.lit(clamp), F.greatest("value", F.lit(0.0))).otherwise(F.col("value")))


def self_transfer_entropy(df: DataFrame, x: str, longest: int, order: Order = BARS) -> DataFrame:
    """I(x at t; x at t - lag | x at t - 1) for lags from 2."""
    return transfer_entropy(df, x, x, list(range(2, longest + 1)), order)


def transfer_entropy(df: DataFrame, source: str, target: str, lags: list[int], order: Order = BARS) -> DataFrame:
    """I(target at t; source at t - lag | target at t - 1)."""
    keys = [*order.keys, "lag"]
    at = lambda c, k: F.lag(c, k).over(order.rows())
    rows = df.select(*order.keys, F.row_number().over(order.rows()).alias("_place"), F.col(target).alias("a"), at(target, 1).alias("c"), *(at(source, k).alias(f"_b{k}") for k in lags))
    each = F.explode(F.array(*(F.when(F.col("_place") > max(k, 1), F.struct(F.lit(k).alias("lag"), F.col(f"_b{k}").alias("b"))) for k in lags)))
    rows = rows.select(*order.keys, "a", "c", each.alias("_r")).where("_r is not null").select(*order.keys, "a", "c", "_r.lag", "_r.b")
    return _conditional(rows.where("a is not null and b is not null and c is not null"), keys)


def _observed(df: DataFrame, source: str, target: str, lags: list[int], history: int, past: int, missing: int | None, order: Order) -> tuple[DataFrame, DataFrame]:
    """Counts (keys, lag, y, h, x, cnt) of complete rows, h the context: the target's last ``history`` values and the ``past``
    source values before the lagged one; and (keys, kx, ky, rows), alphabets being 0..max of the symbols seen."""
    keys = list(order.keys)
    seen = lambda c: F.col(c) if missing is None else F.when(F.col(c) != missing, F.col(c))
    sizes = df.groupBy(*keys).agg(*((F.max(seen(c)) + 1).cast("int").alias(n) for c, n in ((source, "kx"), (target, "ky"))), F.count("*").alias("rows"))
    at = lambda c, k: F.lag(seen(c), k).over(order.rows())
    before = [at(target, j).alias(f"_h{j}") for j in range(1, history + 1)]
    back = {k: at(source, k).alias(f"_x{k}") for k in sorted({k + j for k in lags for j in range(past + 1)})}
    base = df.select(*keys, seen(target).alias("y"), *before, *back.values())
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("x"), F.array(*(F.col(f"_x{k + j}") for j in range(1, past + 1))).cast("array<int>").alias("p")) for k in lags)))
    context = F.concat(F.array(*(F.col(f"_h{j}") for j in range(1, history + 1))).cast("array<int>"), F.col("_r.p"))
    rows = base.withColumn("_r", each).select(*keys, "_r.lag", "y", context.alias("h"), "_r.x")
    full = F.col("x").isNotNull() & F.col("y").isNotNull() & F.forall("h", lambda v: v.isNotNull())
    cells = rows.where(full).where((F.col("x") >= 0) & (F.col("y") >= 0)).groupBy(*keys, "lag", "y", "h", "x").agg(F.count("*").alias("cnt"))
    return cells, sizes


def counterfactual_entropy(df: DataFrame, source: str, target: str, lags: list[int], history: int = 1, missing: int = -1, alpha: float = 1.0, order: Order = BARS) -> DataFrame:
    """Smoothed transfer entropy source(t - k) to target(t) given the target's last ``history`` values.

    Each table of counts gets ``alpha`` added to every cell on its own, so the conditionals don't sum to one; that is the
    definition followed here. Null below 10 rows or 50 complete ones. Alphabets are 0..max of the symbols seen. Of the
    ky ** (history + 1) * kx cells only those that occur are ever rows: what all others add is a sum over margins, of
    which in turn only those that occur differ from ``alpha``.
    """
    if history < 1 or alpha <= 0:
        raise ValueError("the history must be 1 or more and alpha above 0")
    cells, sizes = _observed(df, source, target, lags, history, 0, missing, order)
    return counterfactual_of_counts(cells, sizes, lags, history, alpha, order).drop("pairs")


def counterfactual_of_counts(cells: DataFrame, sizes: DataFrame, lags: list[int], history: int, alpha: float, order: Order) -> DataFrame:
    """:func:`counterfactual_entropy` from counts (keys, lag, y, h, x, cnt) and (keys, kx, ky, rows)."""
    keys = [*order.keys, "lag"]
    by = lambda *c: F.sum("cnt").over(Window.partitionBy(*keys, *c)) + alpha
    g = cells.select(*keys, "y", "h", "x", "cnt", by("h", "x").alias("hx"), by("y", "h").alias("yh"), by("h").alias("hh"))
    one = lambda c: F.log2((c + alpha) * F.col("hh") / (F.col("hx") * F.col("yh")))
    own = (F.col("cnt") + alpha) * one(F.col("cnt")) - alpha * one(F.lit(0))  # beyond what it would add unseen
    first = lambda *c: F.row_number().over(Window.partitionBy(*keys, *c).orderBy("y", "x")) == 1
    g = g.withColumns({"_own": own, "_fhx": first("h", "x"), "_fyh": first("y", "h"), "_fh": first("h")})
    margin = lambda f, c: (F.sum(F.when(F.col(f), F.log2(c))), F.count_if(F.col(f)))
    (s_hx, n_hx), (s_yh, n_yh), (s_h, n_h) = margin("_fhx", "hx"), margin("_fyh", "yh"), margin("_fh", "hh")
    named = [c.alias(n) for c, n in ((s_hx, "s_hx"), (n_hx, "n_hx"), (s_yh, "s_yh"), (n_yh, "n_yh"), (s_h, "s_h"), (n_h, "n_h"))]
    told = g.groupBy(*keys).agg(F.sum("_own").alias("own"), F.sum("cnt").alias("n"), *named)
    every = sizes.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).join(told, keys, "left")
    kx, ky, kh, low = F.col("kx"), F.col("ky"), F.pow("ky", F.lit(history)), F.lit(math.log2(alpha))
    whole = lambda s, n, size: F.col(s) + (size - F.col(n)) * low
    unseen = kx * ky * kh * low + kx * ky * whole("s_h", "n_h", kh) - ky * whole("s_hx", "n_hx", kh * kx) - kx * whole("s_yh", "n_yh", kh * ky)
    value = (F.col("own") + alpha * unseen) / (F.col("n") + alpha * kx * ky * kh)
    enough = (F.col("rows") - F.greatest(F.col("lag"), F.lit(history)) >= 10) & (F.col("n") >= 50)
    return every.select(*keys, F.when(enough, value).alias("value"), F.coalesce("n", F.lit(0)).alias("pairs"))


def dirichlet_entropy(
    df: DataFrame, source: str, target: str, lags: list[int], history: int = 1, past: int = 0, alpha: float = 0.5, beta: float = 0.5, missing: int | None = None, order: Order = BARS
) -> DataFrame:
    """Transfer entropy against a counterfactual: log p(y | c, x) over the sum over x of p(y | c, x) p(x | c), averaged over what occurs.

    x is the source ``lag`` rows before; the context c is the target's last ``history`` values and the ``past`` source values before x.
    p(y | c, x) is smoothed by ``alpha``, p(x | c) by ``beta``, over alphabets 0..max. The x and y that a context never has enter
    by how many they are. Null without complete rows.
    """
    keys = [*order.keys, "lag"]
    cells, sizes = _observed(df, source, target, lags, history, past, missing, order)
    by = lambda *c: Window.partitionBy(*keys, *c)
    g = cells.join(sizes, list(order.keys)).withColumns({"_cx": F.sum("cnt").over(by("h", "x")), "_c": F.sum("cnt").over(by("h")), "_n": F.sum("cnt").over(by())})
    g = g.withColumn("_first", F.row_number().over(by("h", "x").orderBy("y")) == 1)
    px, row = (F.col("_cx") + beta) / (F.col("_c") + beta * F.col("kx")), F.col("_cx") + alpha * F.col("ky")
    once = F.sum(F.when(F.col("_first"), px * alpha / row)).over(by("h"))  # every seen x, as if y had not come with it
    other = (F.col("kx") - F.count_if("_first").over(by("h"))) * beta / (F.col("_c") + beta * F.col("kx")) / F.col("ky")
    g = g.withColumns({"_cf": once + other + F.sum(px * F.col("cnt") / row).over(by("h", "y")), "_p": (F.col("cnt") + alpha) / row})
    te = F.sum(F.col("cnt") / F.col("_n") * F.log2(F.col("_p") / F.col("_cf")))
    told = g.groupBy(*keys).agg(te.alias("value"))
    every = sizes.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).select(*keys)
    return every.join(told, keys, "left")


def histogram_transfer_entropy(
    df: DataFrame, x: str, y: str, delay: int = 1, most: int = 64, sigma: float | None = None, order: Order = BARS
) -> DataFrame:
    """Transfer entropy from y to x, ``delay`` rows ahead, by histograms whose bins follow the interquartile range.

    Sum of p(x', y, x) log2(p(x', y, x) p(x') / (p(x', y) p(x', x))) with x' = x at t + delay and x, y at t: both factors below
    the line hold the future's x, unlike the textbook's. ``sigma`` smooths the counts by a Gaussian (in bins).
    Rows with a value that isn't finite go.
    """
    if delay < 1:
        raise ValueError("the delay must be 1 or more")
    rows = df.select(*order.keys, F.lead(x, delay).over(order.rows()).alias("f"), F.col(y).alias("q"), F.col(x).alias("p"))
    return _histogram_entropy(rows, list(order.keys), most, sigma)


def step_lag_entropy(
    df: DataFrame, x: str, steps: int = 3, lags: int = 20, most: int = 64, sigma: float | None = None, order: Order = BARS
) -> DataFrame:
    """keys, step, lag, value: :func:`histogram_transfer_entropy` with delay 1 to a series from itself ``step`` + ``lag`` rows before.

    A cell depends on step + lag alone, so each distance is worked out once, all of them from one pass over the series.
    """
    keys = [*order.keys, "apart"]
    ahead = {k: F.lead(x, k).over(order.rows()) for k in range(2, steps + lags + 2)}
    cells = df.select(*order.keys, F.col(x).alias("q"), *(c.alias(f"_a{k}") for k, c in ahead.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("apart"), F.col(f"_a{k}").alias("p"), F.col(f"_a{k + 1}").alias("f")) for k in range(2, steps + lags + 1))))
    rows = cells.select(*order.keys, "q", each.alias("r")).select(*keys[:-1], "r.apart", "r.f", "q", "r.p").where("p is not null")
    flat = _histogram_entropy(rows, keys, most, sigma)
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.lit(k).alias("lag"), F.lit(s + k).alias("at")) for s in range(1, steps + 1) for k in range(1, lags + 1))))
    return flat.withColumn("c", grid).where("apart = c.at").select(*order.keys, "c.step", "c.lag", "value")


def _histogram_entropy(rows: DataFrame, keys: list[str], most: int, sigma: float | None) -> DataFrame:
    """keys, value from rows (keys, f, q, p). Bin widths of f and p follow all p, those of q all q; each column's bins span its
    own values in complete rows. At least one bin, at most ``most``, as many as that for an interquartile range of 0."""
    rows = rows.select(*keys, *(finite(c).alias(c) for c in "fqp"))
    full = F.col("f").isNotNull() & F.col("q").isNotNull() & F.col("p").isNotNull()
    stats = [quartile_bins(c, most).alias(f"bins_{c}") for c in "pq"]
    for c in "fqp":
        stats += [F.min(F.when(full, F.col(c))).alias(f"low_{c}"), F.max(F.when(full, F.col(c))).alias(f"high_{c}")]
    facts = rows.groupBy(*keys).agg(*stats).withColumn("bins_f", F.col("bins_p"))
    rows = rows.where(full).join(facts, keys)
    n = rows.select(*keys, *(edge_bin(*map(F.col, (c, f"low_{c}", f"high_{c}", f"bins_{c}"))).alias(c) for c in "fqp"), *(f"bins_{c}" for c in "fqp"))
    n = n.groupBy(*keys, *"fqp", *(f"bins_{c}" for c in "fqp")).agg(F.count("*").cast("double").alias("cnt"))
    if sigma:
        for c in "fqp":
            n = _smoothed(n, c, keys, sigma)
    by = lambda *c: F.sum("cnt").over(Window.partitionBy(*keys, *c))
    n = n.select(*keys, "cnt", by().alias("n"), by("f").alias("nf"), by("f", "q").alias("nfq"), by("f", "p").alias("nfp"))
    term = F.col("cnt") / F.col("n") * F.log2(F.col("cnt") * F.col("nf") / (F.col("nfq") * F.col("nfp")))
    return n.groupBy(*keys).agg(F.sum(term).alias("value"))


def quartile_bins(c: str, most: int) -> Column:
    """How many bins ``c`` gets: an aggregate, its range over a width that follows its quartiles, within 1 and ``most``."""
    spread = F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    width = 2 * F.when(spread == 0, 1e-8).otherwise(spread) / F.pow(F.count(c).cast("double"), F.lit(1 / 3))
    return F.greatest(F.least(F.floor((F.max(c) - F.min(c)) / F.nullif(width, F.lit(0.0))), F.lit(most)), F.lit(1)).cast("int")


def edge_bin(v: Column, low: Column, high: Column, bins: Column) -> Column:
    """0-based equal-width bin; the highest value is in the last. A place found by division is put right by the edges
    themselves, so that values on an edge fall as a search among edges has them."""
    flat = low == high
    low, high = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    step = (high - low) / bins
    at = F.greatest(F.least(F.floor((v - low) / step), bins - 1), F.lit(0))
    at = F.when((at > 0) & (v < low + at * step), at - 1).when((at < bins - 1) & (v >= low + (at + 1) * step), at + 1).otherwise(at)
    return at.cast("int")


def _smoothed(cells: DataFrame, axis: str, keys: list[str], sigma: float) -> DataFrame:
    """Counts spread along one axis by a Gaussian out to 4 ``sigma``, mirrored at the ends (the end's own bin twice), whole bins with it.

    Mass stays, so margins of a smoothed table are smoothed margins. A cell becomes 2 radius + 1 at most.
    """
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*(F.struct(F.lit(k).alias("d"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-radius, radius + 1), raw, strict=True)))
    bins, to = F.col(f"bins_{axis}"), F.col(axis) + F.col("_k.d")
    to = F.pmod(to, 2 * bins)
    to = F.when(to >= bins, 2 * bins - 1 - to).otherwise(to).cast("int")
    spread = cells.withColumn("_k", F.explode(kernel)).withColumn(axis, to).withColumn("cnt", F.col("cnt") * F.col("_k.w")).drop("_k")
    return spread.groupBy(*(c for c in cells.columns if c != "cnt")).agg(F.sum("cnt").alias("cnt"))
