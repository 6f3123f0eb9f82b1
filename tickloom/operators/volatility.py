"""Realised volatility of prices on regular grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scan import Ewm, ewm
from ..functions.series import DAY, Order, diff
from ..functions.tables import written
from .bars import regularise, resample

#: A series on a regular grid.
GRID = Order(by=("bucket_start",))


def realised(df: DataFrame, value: str, seconds: int, order: Order = DAY, grid: float = 1.0, how: str = "last", relative: bool = False) -> DataFrame:
    """Root of the summed squared changes of ``value`` (relative ones if asked) on a fine grid, by buckets of ``seconds``."""
    keys = list(order.keys)
    fine = regularise(df, value, grid, how, order)
    by = Order(order.keys, ("bucket_start",))
    change = diff(value, by)
    change = F.try_divide(change, F.lag(value).over(by.rows())) if relative else change
    start = F.timestamp_seconds(F.floor(F.unix_micros("bucket_start") / (seconds * 1_000_000)) * seconds)
    out = fine.withColumn("_r", change).withColumn("start", start).groupBy(*keys, "start")
    return out.agg(F.sqrt(F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0))).alias("volatility")).withColumnRenamed("start", "bucket_start")


def two_scale(df: DataFrame, price: str, order: Order = DAY, k: int | None = None, c: float = 1.0) -> DataFrame:
    """Two-scale realised variance of each series: the mean of k subgrids' variances less the share of noise.

    k defaults to c * n ** (2 / 3), within 2 and n; null below three prices. Subgrids are rows with the same place
    modulo k, so one more window replaces a loop over them.
    """
    keys = list(order.keys)
    rows = df.where(F.col(price).isNotNull() & (F.col(price) > 0)).select(
        *keys, F.log(price).alias("_x"), (F.row_number().over(order.rows()) - 1).alias("_i"), (F.count("*").over(Window.partitionBy(*keys)) - 1).alias("n")
    )
    size = F.lit(k) if k else F.floor(F.lit(float(c)) * F.pow(F.col("n").cast("double"), F.lit(2 / 3)))
    rows = rows.withColumn("k", F.greatest(F.lit(2), F.least(size, F.col("n"))).cast("long"))
    fast = Window.partitionBy(*keys).orderBy("_i")
    slow = Window.partitionBy(*keys, "_m").orderBy("_i")
    rows = rows.withColumn("_m", F.col("_i") % F.col("k")).withColumns({"_f": F.col("_x") - F.lag("_x").over(fast), "_s": F.col("_x") - F.lag("_x").over(slow)})
    per = rows.groupBy(*keys, "_m").agg(
        F.sum(F.col("_f") * F.col("_f")).alias("fast"), F.sum(F.col("_s") * F.col("_s")).alias("slow"), F.count("_s").alias("steps"), F.max("n").alias("n")
    )
    used = F.col("steps") >= 1
    value = F.avg(F.when(used, F.col("slow"))) - F.avg(F.when(used, F.col("steps"))) / F.max("n") * F.sum("fast")
    return per.groupBy(*keys).agg(F.when(F.max("n") >= 2, value).alias("tsrv"))


def two_scale_offsets(df: DataFrame, log_price: str, j: int = 5, order: Order = DAY) -> DataFrame:
    """The variant over j offsets with the correction (n - j + 1) / (j n), on log prices."""
    keys = list(order.keys)
    w = order.rows()
    rows = df.where(F.col(log_price).isNotNull()).select(
        *keys, (F.col(log_price) - F.lag(log_price).over(w)).alias("_f"), (F.col(log_price) - F.lag(log_price, j).over(w)).alias("_s")
    )
    n = F.count("_f")
    value = F.sum(F.col("_s") * F.col("_s")) / j - (n - j + 1) / (n * j) * F.sum(F.col("_f") * F.col("_f"))
    return rows.groupBy(*keys).agg(F.when(n >= j, value).alias("tsrv"))


def _grid_runs(df: DataFrame, price: str, seconds: float, order: Order, grid: float, how: str) -> DataFrame:
    """keys, _b, _s, _e, _x, _n: the log prices of a grid of ``grid`` seconds, filled forward, by buckets of ``seconds``. Slots _s to
    _e - 1 of bucket _b, counted from its first, hold _x; the bucket has _n. A series' first bucket begins with its first price."""
    keys, step = list(order.keys), round(seconds / grid)
    fine = regularise(df.where(F.col(price) > 0), price, grid, how, order, fill=False)
    fine = fine.select(*keys, F.log(price).alias("_x"), F.floor(F.unix_micros("bucket_start") / round(grid * 1_000_000)).alias("_i"))
    fine = fine.withColumn("_next", F.coalesce(F.lead("_i").over(Order(order.keys, ("_i",)).rows()), F.col("_i") + 1))
    parts = fine.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_i") / step), F.floor((F.col("_next") - 1) / step))))
    begins, ends = F.greatest(F.col("_i"), F.col("_b") * step), F.least(F.col("_next"), (F.col("_b") + 1) * step)
    parts = parts.select(*keys, "_b", "_x", begins.alias("_s"), ends.alias("_e"))
    bucket = Window.partitionBy(*keys, "_b")
    first, last = F.min("_s").over(bucket), F.max("_e").over(bucket)
    return parts.select(*keys, "_b", "_x", (F.col("_s") - first).alias("_s"), (F.col("_e") - first).alias("_e"), (last - first).alias("_n"))


def _bucket_start(seconds: float) -> Column:
    return F.timestamp_micros(F.col("_b") * round(seconds * 1_000_000)).alias("bucket_start")


def two_scale_buckets(
    df: DataFrame, price: str, seconds: float, order: Order = DAY, k: int | None = None, grid: float = 0.01, how: str = "mean"
) -> DataFrame:
    """keys, bucket_start, tsrv: :func:`two_scale` of each bucket's prices on a filled grid; k defaults to ten for each second.

    No slot of the grid is made. Both ends of a step of k slots change only where a run begins or k slots before that, so the
    squared steps are summed over the stretches between those places, twice as many as runs. k is at most a bucket's steps and
    at least 2; null below three slots. Prices that are null or not above 0 go before the grid is filled.
    """
    keys = [*order.keys, "_b"]
    runs = _grid_runs(df, price, seconds, order, grid, how)
    size = F.greatest(F.lit(2), F.least(F.lit(k or max(1, round(10 * seconds))), F.col("_n") - 1)).cast("long")
    runs = runs.withColumns({"_k": size, "_f": F.col("_x") - F.lag("_x").over(Window.partitionBy(*keys).orderBy("_s"))})
    here = F.struct(F.col("_s").alias("at"), F.col("_x").alias("from"), F.lit(None).cast("double").alias("to"), F.col("_f").alias("f"))
    ahead = F.struct(F.greatest(F.col("_s") - F.col("_k"), F.lit(0)).alias("at"), F.lit(None).cast("double").alias("from"), F.col("_x").alias("to"), F.lit(None).cast("double").alias("f"))
    places = runs.select(*keys, "_n", "_k", "_s", F.explode(F.array(here, ahead)).alias("_p")).select(*keys, "_n", "_k", "_s", "_p.*")
    by = Window.partitionBy(*keys).orderBy("at", "_s", F.col("to").isNull())
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    end = F.least(F.coalesce(F.lead("at").over(by), F.col("_n")), F.col("_n") - F.col("_k"))
    step = F.last("to", True).over(past) - F.last("from", True).over(past)
    places = places.withColumns({"_len": F.greatest(end - F.col("at"), F.lit(0)), "_step": step})
    n, size = F.max("_n"), F.max("_k")
    slow, fast = F.sum(F.when(F.col("_len") > 0, F.col("_step") * F.col("_step") * F.col("_len"))), F.coalesce(F.sum(F.col("f") * F.col("f")), F.lit(0.0))
    value = (F.coalesce(slow, F.lit(0.0)) - (n - size) / (n - 1) * fast) / F.least(size, n - size)
    out = places.groupBy(*keys).agg(F.when(n >= 3, value).alias("tsrv"))
    return out.select(*order.keys, _bucket_start(seconds), "tsrv")


def two_scale_mean_buckets(
    df: DataFrame, price: str, seconds: float, order: Order = DAY, k: int | None = None, grid: float = 0.01, how: str = "mean"
) -> DataFrame:
    """keys, bucket_start, tsmp: the mean over offsets m = 0 .. n - k of the mean log price at slots m, m + k, m + 2k, ..., less the
    whole mean times the mean number of those slots over n.

    The offsets that reach a slot weigh it by reciprocals of their own numbers of slots, a sum over whole numbers in a row that
    changes only at multiples of k from either end. Runs are cut there and no slot is made. Null in buckets of fewer than k.
    """
    keys = [*order.keys, "_b"]
    size = k or max(1, round(10 * seconds))
    runs = _grid_runs(df, price, seconds, order, grid, how).where(F.col("_n") >= size)
    n, s, e = F.col("_n"), F.col("_s"), F.col("_e")
    from_start = (F.floor(s / size) + 1) * size
    from_end = n - F.floor((n - s - 1) / size) * size
    marks = [F.when(c < e, F.sequence(c, e - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>")) for c in (from_start, from_end)]
    beyond = n - size + 1  # the first slot that is no offset's first
    marks.append(F.when((beyond > s) & (beyond < e), F.array(beyond)).otherwise(F.array().cast("array<long>")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(s), *marks, F.array(e))))
    cut = runs.withColumn("_c", cuts).withColumn("_j", F.explode(F.sequence(F.lit(0), F.size("_c") - 2)))
    cut = cut.select(*keys, "_n", "_x", F.expr("_c[_j]").alias("_t"), F.expr("_c[_j + 1] - _c[_j]").alias("_len"))
    t = F.col("_t")
    after, before = F.ceil((n - t) / size), F.floor(t / size)  # slots of its offset from this one on, and before it
    low, high = after + F.when(t > n - size, 1).otherwise(0), after + before
    weight = F.when(high >= low, F.aggregate(F.sequence(low, F.greatest(low, high)), F.lit(0.0), lambda acc, v: acc + 1 / v)).otherwise(0.0)
    told = cut.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_len") * weight).alias("slow"), F.sum(F.col("_x") * F.col("_len")).alias("all"), F.max("_n").alias("n"))
    n, offsets = F.col("n"), F.col("n") - size + 1
    whole, rest = F.floor(n / size), n % size
    slots = 1 + size * (whole * (whole + 1) / 2 - 1) + rest * (whole + 1)  # ceil(c / k) over c = k .. n
    value = F.col("slow") / offsets - slots / offsets / n * (F.col("all") / n)
    return told.select(*order.keys, _bucket_start(seconds), value.alias("tsmp"))


def mean_returns(df: DataFrame, value: str, seconds: float, order: Order = DAY, first: float = 0.01) -> DataFrame:
    """keys, bucket_start, ret: changes of ``value``'s mean by buckets of ``seconds``, itself the mean of filled buckets of ``first``
    seconds; the first bucket, which has none before it, goes."""
    means = resample(df, value, seconds, "mean", order, first)
    out = means.withColumn("ret", diff(value, Order(order.keys, ("bucket_start",))))
    return out.where("ret is not null").select(*order.keys, "bucket_start", "ret")


def summed_returns(df: DataFrame, value: str, seconds: float, order: Order = DAY, first: float = 0.01) -> DataFrame:
    """keys, bucket_start, ret: the changes from one filled bucket of ``first`` seconds to the next, summed by ``seconds``.

    A bucket's sum is its last fine mean less the last one before it, so no fine bucket is made; the series' first has none
    before it and takes its own first.
    """
    keys, step = list(order.keys), round(seconds / first)
    fine = regularise(df, value, first, "mean", order, fill=False)
    fine = fine.withColumn("_i", F.floor(F.unix_micros("bucket_start") / int(first * 1_000_000)))
    per = fine.groupBy(*keys, F.floor(F.col("_i") / step).alias("_b")).agg(F.max_by(value, "_i").alias("_last"), F.min_by(value, "_i").alias("_first"))
    by = Order(order.keys, ("_b",))
    per = per.withColumns({"_before": F.coalesce(F.lag("_last").over(by.rows()), "_first"), "_next": F.coalesce(F.lead("_b").over(by.rows()), F.col("_b") + 1)})
    each = per.withColumn("_at", F.explode(F.sequence(F.col("_b"), F.col("_next") - 1)))
    ret = F.when(F.col("_at") == F.col("_b"), F.col("_last") - F.col("_before")).otherwise(0.0)
    return each.select(*keys, F.timestamp_micros(F.col("_at") * int(seconds * 1_000_000)).alias("bucket_start"), ret.alias("ret"))


# --- conditional variance -------------------------------------------------------------------------------------------

#: Weights by which the variance before a series' first row is guessed from its first rows, and how many.
_BACK, _ROWS = 0.94, 75


def _shocks(returns: DataFrame, ret: str, order: Order) -> DataFrame:
    """Adds _e (distance from the series' mean), _v (its variance) and _v0, the variance before the first row: squared distances of
    the first 75 rows with weights that fall by 0.94."""
    whole, place = Window.partitionBy(*order.keys), F.row_number().over(order.rows()) - 1
    df = returns.where(F.col(ret).isNotNull()).withColumn("_e", F.col(ret) - F.avg(ret).over(whole)).withColumn("_i", place)
    w = F.when(F.col("_i") < _ROWS, F.pow(F.lit(_BACK), F.col("_i")))
    e2 = F.col("_e") * F.col("_e")
    return df.withColumns({"_v0": F.sum(w * e2).over(whole) / F.sum(w).over(whole), "_v": F.avg(e2).over(whole)})


def _variance(df: DataFrame, name: str, omega: Column, alpha: Column, beta: Column, weight: Ewm, order: Order) -> DataFrame:
    """Adds ``name``: v = omega + alpha e^2 + beta v, e and v one row before. Over 1 - beta what is added makes it a recursive mean."""
    e = F.lag("_e").over(order.rows())
    x = F.when(F.col("_i") == 0, omega + (alpha + beta) * F.col("_v0")).otherwise((omega + alpha * e * e) / (1 - beta))
    df = ewm(df.withColumn("_x", x), {name: weight}, order)
    return df.drop("_x", f"{name}_a", f"{name}_n")


def conditional_variance(returns: DataFrame, ret: str, omega: float, alpha: float, beta: float, order: Order = GRID) -> DataFrame:
    """Adds ``variance`` of each row given those before: omega + alpha e^2 + beta variance, e the distance from the series' mean.

    Rows without a value go. A blocked scan, so a series may span tasks. ``omega`` above 0, ``alpha`` 0 or more, ``beta`` in [0, 1).
    """
    if not (omega > 0 and alpha >= 0 and 0 <= beta < 1):
        raise ValueError("omega must be above 0, alpha 0 or more, beta at least 0 and below 1")
    df = _shocks(returns, ret, order)
    df = _variance(df, "variance", F.lit(omega), F.lit(alpha), F.lit(beta), Ewm("_x", 1 - beta), order)
    return df.drop("_e", "_v", "_v0", "_i")


def likelihoods(returns: DataFrame, ret: str, sets: DataFrame, order: Order = GRID, least_beta: float = 0.0) -> DataFrame:
    """keys, set, omega, alpha, beta, loglik of every parameter set of ``sets`` (keys, set, share, alpha, beta) under normal shocks.

    omega is ``share`` times (1 - alpha - beta) times the series' variance, so a share of 1 makes the long-run variance that.
    All sets of all series are one scan and one aggregate; with a ``least_beta`` that no set is below, its blocks are longer.
    """
    keys = list(order.keys)
    df = _shocks(returns, ret, order).select(*keys, *order.by, "_e", "_v", "_v0", "_i").join(sets, keys)
    omega = F.col("share") * (1 - F.col("alpha") - F.col("beta")) * F.greatest("_v", F.lit(1e-300))
    df = df.withColumns({"omega": omega, "_w": 1 - F.col("beta")})
    by = Order((*order.keys, "set"), order.by)
    df = _variance(df, "_s", F.col("omega"), F.col("alpha"), F.col("beta"), Ewm("_x", 1 - least_beta, weight="_w"), by)
    s = F.greatest("_s", F.lit(1e-300))
    one = -0.5 * (math.log(2 * math.pi) + F.log(s) + F.col("_e") * F.col("_e") / s)
    first = ("share", "omega", "alpha", "beta")
    return df.groupBy(*keys, "set").agg(*(F.max(c).alias(c) for c in first), F.sum(one).alias("loglik"))


@dataclass(frozen=True)
class Search:
    """Where the fit begins, how far it first steps, and how often the steps are halved."""

    alphas: tuple[float, ...] = (0.02, 0.1, 0.3)
    betas: tuple[float, ...] = (0.3, 0.6, 0.85)
    shares: tuple[float, ...] = (0.5, 1.0, 2.0)
    step: float = 0.1
    rounds: int = 6


def fit_conditional_variance(returns: DataFrame, ret: str, order: Order = GRID, search: Search = Search()) -> DataFrame:
    """keys, omega, alpha, beta, loglik: for each series the parameters of the greatest likelihood that a search finds.

    A grid that all series share, then rounds of 27 sets round each series' best with steps halved. A round is one aggregate;
    its best sets, a row for each series, are written to the shared folder, and no number passes the driver. alpha + beta
    stays at most 0.999. Series without spread get no parameters.
    """
    keys = list(order.keys)
    spread = returns.where(F.col(ret).isNotNull()).groupBy(*keys).agg(F.stddev_pop(ret).alias("_sd")).where("_sd > 0").select(*keys)
    grid = [(s, a, b) for s in search.shares for a in search.alphas for b in search.betas if a + b <= 0.999]
    sets = spread.withColumn("p", F.explode(F.array(*(F.struct(F.lit(i).alias("set"), F.lit(s).alias("share"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for i, (s, a, b) in enumerate(grid)))))
    sets = sets.select(*keys, "p.*")
    best, step = None, search.step
    for n in range(search.rounds + 1):
        told = likelihoods(returns, ret, sets, order, 0.0 if n else min(search.betas))
        if best is not None:
            told = told.unionByName(best)  # the one so far, which rounding mustn't lose
        top = F.max_by(F.struct("share", "omega", "alpha", "beta", "loglik"), F.struct("loglik", -F.col("set")))
        best = written(told.groupBy(*keys).agg(top.alias("b")).select(*keys, F.lit(-1).alias("set"), "b.*"), "variance-fit")
        moves = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
        around = F.explode(F.array(*(F.struct(F.lit(q).alias("set"), F.lit(math.exp(4 * step * i)).alias("s"), F.lit(step * j).alias("a"), F.lit(step * k).alias("b")) for q, (i, j, k) in enumerate(moves))))
        near = best.select(*keys, "share", "alpha", "beta", around.alias("m"))
        alpha = F.greatest(F.col("alpha") + F.col("m.a"), F.lit(0.0))
        beta = F.greatest(F.least(F.col("beta") + F.col("m.b"), F.lit(0.998)), F.lit(0.0))
        sets = near.select(*keys, "m.set", (F.col("share") * F.col("m.s")).alias("share"), alpha.alias("alpha"), beta.alias("beta")).where("alpha + beta <= 0.999")
        step /= 2
    return best.select(*keys, "omega", "alpha", "beta", "loglik")
