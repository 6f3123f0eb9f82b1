"""Exponentially weighted recursions as blocked affine scans: expressions and joins only, and a series may span tasks.

The recursion m_t = a_t m_{t-1} + b_t x_t is a composition of affine maps. A series is cut into blocks of rows. In each
block, windows give every row's map relative to the block's first value; one row for each block goes to a small table,
where the blocks of a series are folded in order; what comes out (the mean at each block's first value) is joined back
and finishes every row. No more than rows / ``BLOCK`` entries of a series meet in one array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import Order, finite

#: Rows of a block; fewer where the weights of a block would leave the range of doubles.
BLOCK = 4096


@dataclass(frozen=True)
class Ewm:
    """The recursive exponential mean of a column (weights of values decay over missing ones too, as rows pass).

    ``debias``: also the sum of squared weights, by which a variance is made unbiased. ``previous``: also the mean before the row.
    ``weight``: a column that holds each series' own alpha, at most ``alpha``.
    """

    column: str
    alpha: float
    min_periods: int = 1
    debias: bool = False
    previous: bool = False
    weight: str | None = None


#: What a mean keeps of the one before is at least this: less is below any double's precision.
_LEAST = 1e-30


def block_size(alpha: float) -> int:
    """Rows for which (1 - alpha) ** rows stays above 1e-120."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    rate = min(-math.log1p(-alpha) if alpha < 1 else math.inf, -math.log(_LEAST))
    return max(1, min(BLOCK, int(276 / rate)))


def block_of(df: DataFrame, order: Order, size: int) -> Column:
    """Which block a row is in. Orders by one whole number are cut by it; others by their place, for which one
    streaming window ranks the series."""
    if len(order.by) == 1 and dict(df.dtypes)[order.by[0]] in ("int", "bigint", "smallint", "tinyint"):
        return F.floor(F.col(order.by[0]) / size)
    return F.floor((F.row_number().over(order.rows()) - 1) / size)


def ewm(df: DataFrame, means: dict[str, Ewm], order: Order, keep: bool = False) -> DataFrame:
    """Adds each mean as ``name``, null while it has fewer than ``min_periods`` values, and ``name_a``, what the row's new mean
    keeps of the one before (null at missing values and at a series' first), and ``name_n``, the values so far. With ``debias`` also
    ``name_w2``, with ``previous`` also ``name_prev``.

    NaN and infinite values count as missing. All means share one local pass, one fold and one join, dealt by one key, so rows move
    once. ``keep`` leaves that key (``_series``) and the place in its block (``_at``) for a next call, whose rows then don't move.
    """
    keys, size = list(order.keys), min(block_size(m.alpha) for m in means.values())
    within = Order(("_series",), order.by)
    upto, before = within.rows().rowsBetween(Window.unboundedPreceding, 0), within.rows().rowsBetween(Window.unboundedPreceding, -1)
    values = {f"_x_{n}": finite(m.column) for n, m in means.items()}
    if "_series" in df.columns:
        df = df.withColumns(values)
    else:
        df = df.withColumns({"_series": F.struct(*keys, block_of(df, order, size).alias("_block")), **values})
        df = df.withColumn("_at", F.row_number().over(within.rows()))
    df = df.withColumns({f"_d_{n}": F.col("_at") - F.last(F.when(F.col(f"_x_{n}").isNotNull(), F.col("_at")), True).over(before) for n in means})

    own = lambda m: F.col(m.weight) if m.weight else F.lit(m.alpha)

    def kept(n: str, distance: Column) -> Column:
        old = F.pow(1 - own(means[n]), distance)
        return old / (old + own(means[n]))

    inner = {n: F.col(f"_x_{n}").isNotNull() & F.col(f"_d_{n}").isNotNull() for n in means}
    df = df.withColumns({f"{n}_a": F.when(inner[n], F.greatest(kept(n, F.col(f"_d_{n}")), F.lit(_LEAST))) for n in means})
    df = df.withColumns({f"_p_{n}": F.product(F.coalesce(f"{n}_a", F.lit(1.0))).over(upto) for n in means})
    new = {n: (1 - F.col(f"{n}_a")) for n in means}
    local = {f"_s_{n}": F.coalesce(F.sum(new[n] * F.col(f"_x_{n}") / F.col(f"_p_{n}")).over(upto), F.lit(0.0)) for n in means}
    local |= {f"_c_{n}": F.count(f"_x_{n}").over(upto) for n in means}
    local |= {f"_q_{n}": F.coalesce(F.sum(new[n] * new[n] / (F.col(f"_p_{n}") * F.col(f"_p_{n}"))).over(upto), F.lit(0.0)) for n, m in means.items() if m.debias}
    df = df.withColumns(local)

    last = lambda c: F.max_by(c, F.col("_at"))
    facts = []
    for n in means:
        x = F.col(f"_x_{n}").isNotNull()
        facts += [
            F.min_by(f"_x_{n}", F.when(x, F.col("_at"))).alias(f"x_{n}"), F.min(F.when(x, F.col("_at"))).alias(f"first_{n}"), F.max(F.when(x, F.col("_at"))).alias(f"last_{n}"),
            F.max(own(means[n])).alias(f"w_{n}"), last(f"_p_{n}").alias(f"p_{n}"), last(f"_s_{n}").alias(f"s_{n}"), F.count(f"_x_{n}").alias(f"c_{n}"),
        ]
        if means[n].debias:
            facts.append(last(f"_q_{n}").alias(f"q_{n}"))
    blocks = df.groupBy("_series").agg(F.max("_at").alias("rows"), *facts)
    df = df.join(_folded(blocks, means, keys), "_series", "left")  # nulls within a struct are equal

    out = {}
    for n, m in means.items():
        c, head = F.col(f"_c_{n}"), F.col(f"_{n}.head")
        value = F.when(c == 0, F.col(f"_{n}.mean")).otherwise(F.col(f"_p_{n}") * (head + F.col(f"_s_{n}")))
        if m.alpha == 1 and not m.weight:
            value = F.when(F.col(f"_x_{n}").isNotNull(), F.col(f"_x_{n}")).otherwise(value)
        out[n] = F.when(c + F.col(f"_{n}.count") >= max(m.min_periods, 1), value)
        out[f"{n}_n"] = c + F.col(f"_{n}.count")
        out[f"{n}_a"] = F.coalesce(f"{n}_a", F.when(F.col(f"_x_{n}").isNotNull(), F.col(f"_{n}.kept")))
        if m.debias:
            p2 = F.col(f"_p_{n}") * F.col(f"_p_{n}")
            out[f"{n}_w2"] = F.when(c == 0, F.col(f"_{n}.w2")).otherwise(p2 * (F.col(f"_{n}.head_w2") + F.col(f"_q_{n}")))
    extra = [c for n in means for c in (f"_x_{n}", f"_d_{n}", f"_p_{n}", f"_s_{n}", f"_c_{n}", f"_q_{n}", f"_{n}")]
    df = df.withColumns(out)
    first = {n: F.when(F.col(f"_{n}.count") >= max(m.min_periods, 1), F.col(f"_{n}.mean")) for n, m in means.items() if m.previous}
    df = df.withColumns({f"{n}_prev": F.when(F.col("_at") == 1, v).otherwise(F.lag(n).over(within.rows())) for n, v in first.items()})
    return df.drop(*extra, *(() if keep else ("_series", "_at")))


def _folded(blocks: DataFrame, means: dict[str, Ewm], keys: list[str]) -> DataFrame:
    """_series and for each mean a struct ``_name``: mean and count before the block, the mean at its first value, what
    that kept, and the same of squared weights."""
    entry = F.struct(F.col("_series._block"), F.col("_series"), *(F.col(c) for c in blocks.columns if c != "_series"))
    series = blocks.groupBy(*(F.col(f"_series.{k}").alias(k) for k in keys)).agg(F.sort_array(F.collect_list(entry)).alias("b"))
    double, long = (lambda: F.lit(None).cast("double")), (lambda: F.lit(0).cast("long"))
    state = lambda mean, count, since, w2: F.struct(mean.alias("mean"), count.alias("count"), since.alias("since"), w2.alias("w2"))
    told = "struct<mean:double,count:bigint,head:double,kept:double,w2:double,head_w2:double>"
    kind = dict(blocks.dtypes)["_series"]
    shape = f"array<struct<series:{kind},{','.join(f'`{n}`:{told}' for n in means)}>>"
    zero = F.struct(*(state(double(), long(), long(), double()).alias(n) for n in means), F.array().cast(shape).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        states, rows = [], []
        for n, m in means.items():
            s, some = acc[n], b[f"c_{n}"] > 0
            old = F.pow(1 - b[f"w_{n}"], s["since"] + b[f"first_{n}"])
            a = F.when(s["count"] > 0, F.greatest(old / (old + b[f"w_{n}"]), F.lit(_LEAST)))
            head = F.when(s["count"] > 0, a * s["mean"] + (1 - a) * b[f"x_{n}"]).otherwise(b[f"x_{n}"])
            end = F.when(some, b[f"p_{n}"] * (head + b[f"s_{n}"])).otherwise(s["mean"])
            since = F.when(some, b["rows"] - b[f"last_{n}"]).otherwise(s["since"] + b["rows"]).cast("long")
            head_w2 = F.when(s["count"] > 0, a * a * s["w2"] + (1 - a) * (1 - a)).otherwise(F.lit(1.0)) if m.debias else double()
            w2 = F.when(some, b[f"p_{n}"] * b[f"p_{n}"] * (head_w2 + b[f"q_{n}"])).otherwise(s["w2"]) if m.debias else double()
            states.append(state(end, s["count"] + b[f"c_{n}"], since, w2).alias(n))
            rows.append(F.struct(s["mean"].alias("mean"), s["count"].alias("count"), head.alias("head"), a.alias("kept"), s["w2"].alias("w2"), head_w2.alias("head_w2")).alias(n))
        return F.struct(*states, F.concat(acc["out"], F.array(F.struct(b["_series"].alias("series"), *rows))).alias("out"))

    folded = series.select(F.explode(F.aggregate("b", zero, step, lambda acc: acc["out"])).alias("o"))
    return folded.select(F.col("o.series").alias("_series"), *(F.col(f"o.`{n}`").alias(f"_{n}") for n in means))


def ewm_deviation(df: DataFrame, stats: dict[str, Ewm], order: Order) -> DataFrame:
    """Adds ``name`` (the mean) and ``name_sd`` (the debiased deviation about it) of each column; both null while there are fewer
    than ``min_periods`` values, the deviation also below two."""
    df = ewm(df, {f"_{n}": Ewm(m.column, m.alpha, 1, True, True) for n, m in stats.items()}, order, keep=True)
    x = {n: finite(m.column) for n, m in stats.items()}
    # with a the share that the old mean keeps, the variance is the exponential mean of a (x - old mean)^2
    square = {n: F.pow(x[n] - F.col(f"_{n}_prev"), F.lit(2)) for n in stats}
    df = df.withColumns({f"_{n}_y": F.when(F.col(f"_{n}_a").isNotNull(), square[n] * F.col(f"_{n}_a")).when(x[n].isNotNull(), 0.0) for n in stats})
    df = ewm(df, {f"_{n}_v": Ewm(f"_{n}_y", m.alpha) for n, m in stats.items()}, order)
    out = {}
    for n, m in stats.items():
        enough = F.col(f"_{n}_n") >= m.min_periods
        out[n] = F.when(enough, F.col(f"_{n}"))
        out[f"{n}_sd"] = F.when(enough & (F.col(f"_{n}_n") >= 2), F.sqrt(F.greatest(F.try_divide(F.col(f"_{n}_v"), 1 - F.col(f"_{n}_w2")), F.lit(0.0))))
    used = [f"_{n}{e}" for n in stats for e in ("", "_a", "_n", "_w2", "_prev", "_y", "_v", "_v_a", "_v_n")]
    return df.withColumns(out).drop(*used)
