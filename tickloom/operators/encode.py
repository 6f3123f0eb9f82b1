"""Encoding of feature series as small integers: z-scores, bins, symbols.

Recurrences are blocked scans of affine maps; growing-window quantiles run on one series at a time (``applyInArrow`` by
``Order.keys``, so by instrument and day); all else is column expressions. A symbol of -1 is missing.
"""

from __future__ import annotations

import bisect
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scan import Ewm, ewm, ewm_deviation
from ..functions.series import DAY, Order, backward_fill, col, finite, forward_fill

MISSING = -1


def _dropped(df: DataFrame, *prefixes: str) -> DataFrame:
    """Without the working columns that begin so."""
    return df.drop(*(c for c in df.columns if c.startswith(prefixes)))


def zscore(df: DataFrame, feature: str, alpha: float, order: Order = DAY) -> DataFrame:
    """``{feature}_z``: distance from the exponentially weighted mean in such deviations; rows without one go."""
    df = ewm(df, {"_zm": Ewm(feature, alpha)}, order, keep=True).withColumn("_zd", finite(feature) - F.col("_zm"))
    df = ewm(df.withColumn("_zq", F.col("_zd") * F.col("_zd")), {"_zv": Ewm("_zq", alpha)}, order)
    z = finite(F.try_divide(F.col("_zd"), F.sqrt("_zv")))
    return _dropped(df.withColumn(f"{feature}_z", z), "_z").where(F.col(f"{feature}_z").isNotNull())


def zscores_predictive(df: DataFrame, features: list[str], alpha: float, min_periods: int = 2, eps: float = 1e-12, order: Order = DAY) -> DataFrame:
    """``{feature}_z`` of every feature, from the mean and deviation of the values before; null while fewer than ``min_periods``.

    All features share two blocked scans: one of means, one of squared distances.
    """
    df = ewm(df, {f"_zm{i}": Ewm(f, alpha, min_periods, previous=True) for i, f in enumerate(features)}, order, keep=True)
    df = df.withColumns({f"_zq{i}": F.pow(finite(f) - F.col(f"_zm{i}"), F.lit(2)) for i, f in enumerate(features)})
    df = ewm(df, {f"_zv{i}": Ewm(f"_zq{i}", alpha, min_periods, previous=True) for i in range(len(features))}, order)
    z = {f"{f}_z": (finite(f) - F.col(f"_zm{i}_prev")) / F.greatest(F.sqrt(f"_zv{i}_prev"), F.when(F.col(f"_zv{i}_prev").isNotNull(), F.lit(eps))) for i, f in enumerate(features)}
    return _dropped(df.withColumns(z), "_zm", "_zq", "_zv")


def zscore_predictive(df: DataFrame, feature: str, alpha: float, min_periods: int = 2, eps: float = 1e-12, order: Order = DAY) -> DataFrame:
    """:func:`zscores_predictive` of one feature."""
    return zscores_predictive(df, [feature], alpha, min_periods, eps, order)


def uniform_edges(m: int, zmax: float = 3.0) -> list[float]:
    """Inner edges of m equal bins of [-zmax, zmax]."""
    return [-zmax + 2 * zmax * i / m for i in range(1, m)]


def normal_edges(m: int, clip: float = 3.0) -> list[float]:
    """Normal quantiles at i / m, clipped."""
    return [min(max(NormalDist().inv_cdf(i / m), -clip), clip) for i in range(1, m)]


def symbol(z: Column | str, edges: list[Column | float], missing: int | None = MISSING) -> Column:
    """How many edges are at or below z; ``missing`` (None: the last symbol) where z or an edge is null."""
    z, edges = col(z), [e if isinstance(e, Column) else F.lit(float(e)) for e in edges]
    count = sum(((z >= e).cast("int") for e in edges), F.lit(0))
    sound = z.isNotNull()
    for e in edges:
        sound = sound & e.isNotNull()
    return F.when(sound, count).otherwise(F.lit(len(edges) if missing is None else missing))


def quantile_edges(df: DataFrame, z: str, m: int, order: Order = DAY) -> DataFrame:
    """``keys, edges``: each series' exact linear quantiles at i / m, made strictly rising by the smallest steps."""
    q = F.percentile(z, F.array(*(F.lit(i / m) for i in range(1, m))))
    step = lambda e: F.greatest(F.abs(e), F.lit(1e-300)) * 2.3e-16

    def rise(acc, e):
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.when((F.size(acc) > 0) & (e <= last), last + step(last)).otherwise(e)))

    rising = F.aggregate(q, F.array().cast("array<double>"), lambda acc, e: F.when(F.size(acc) == 0, F.array(e)).otherwise(rise(acc, e)))
    return df.groupBy(*order.keys).agg(rising.alias("edges"))


def _fitted(df: DataFrame, z: str, m: int, order: Order, fit: Column) -> DataFrame:
    """Symbols by quantile edges of the rows where ``fit`` holds."""
    edges = quantile_edges(df.where(fit), z, m, order)
    joined = df.join(edges, list(order.keys), "left")
    out = joined.withColumn("_sym", symbol(z, [F.get("edges", F.lit(i)) for i in range(m - 1)]))
    return out.drop("edges")


def _growing(x: list[float], m: int, min_periods: int, decimals: int | None) -> list[int]:
    """Each value's symbol by the linear quantiles at i / m of all values before it, kept in one sorted list."""
    seen: list[float] = []
    out = []
    for v in x:
        sym = MISSING
        if len(seen) >= max(min_periods, 1) and v == v:
            sym = 0
            for i in range(1, m):
                at = i / m * (len(seen) - 1)
                low = int(at)
                e = seen[low] if at == low else seen[low] + (seen[low + 1] - seen[low]) * (at - low)
                sym += v >= (e if decimals is None else round(e, decimals))
        out.append(sym)
        if v == v:
            bisect.insort(seen, v)
    return out


def expanding_symbols(df: DataFrame, z: str | dict[str, str], m: int, min_periods: int = 1, order: Order = DAY, decimals: int | None = None) -> DataFrame:
    """``_sym`` by quantiles of all earlier values of the series, or for several columns the symbol named in ``z`` of each.

    ``decimals`` rounds the edges, which makes ties between an edge and a value the same on every engine. All columns of a series
    are done together; a task holds one series, so select what is needed first.
    """
    if m < 2:
        raise ValueError("at least two symbols are needed")
    names = {z: "_sym"} if isinstance(z, str) else z
    df = df.withColumn("_o", F.struct(*order.by))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_o"), *(f"`{s}` int" for s in names.values())])

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        place = table.column("_o").combine_chunks()
        by = pa.table({str(i): pc.struct_field(place, i) for i in range(len(order.by))})
        table = table.drop_columns("_o").take(pc.sort_indices(by, sort_keys=[(c, "ascending") for c in by.column_names]))
        for c, s in names.items():
            x = [math.nan if v is None else float(v) for v in table.column(c).to_pylist()]
            table = table.append_column(s, pa.array(_growing(x, m, min_periods, decimals), pa.int32()))
        return table

    return df.groupBy(*order.keys).applyInArrow(run, schema)


MODES = ("daily_quantile", "prefix_quantile", "history_quantile", "fixed_uniform", "fixed_normal", "expanding_quantile")
FILLS = ("ffill", "bfill_ffill", "bfill", "none")


def encode_all(
    df: DataFrame, features: list[str], m: int = 4, alpha: float = 0.05, min_periods: int = 2, mode: str = "expanding_quantile", fit_share: float = 0.5,
    fit_until=None, time: str = "ts_event", zmax: float = 3.0, fill: str = "ffill", bin_min_periods: int = 1, order: Order = DAY, decimals: int | None = None,
) -> DataFrame:
    """``{feature}_z`` (predictive, filled backwards at the start) and ``{feature}_sym`` of every feature, together.

    Modes: edges from the whole series, its first ``fit_share``, rows until ``fit_until`` (too few of them, below m, give -1 and no
    error), fixed ones, or growing ones. Fills: ``bfill`` gives missing symbols the next one's (-1 where none follows);
    ``ffill`` and ``bfill_ffill`` fill z but leave a symbol of -1, which is no null; ``none`` leaves both.
    """
    if mode not in MODES or fill not in FILLS:
        raise ValueError(f"mode must be one of {MODES}, fill one of {FILLS}")
    df = zscores_predictive(df, features, alpha, min_periods, order=order)
    z, sym = {f: f"{f}_z" for f in features}, {f: f"{f}_sym" for f in features}
    value = {f: backward_fill(z[f], order) for f in features}
    df = df.withColumns({z[f]: value[f] if decimals is None else F.round(value[f], decimals) for f in features})
    if mode == "expanding_quantile":
        df = expanding_symbols(df, {z[f]: sym[f] for f in features}, m, bin_min_periods, order, decimals)
    elif mode == "history_quantile":
        fit = F.col(time) <= F.lit(fit_until)
        df = df.withColumn("_few", F.count(F.when(fit, 1)).over(order.rows().rowsBetween(-(2**63), 2**63 - 1)) < m)
    elif mode == "prefix_quantile":
        whole = F.count("*").over(order.rows().rowsBetween(-(2**63), 2**63 - 1))
        df = df.withColumns({"_place": F.row_number().over(order.rows()), "_whole": whole})
    fits = {"daily_quantile": lambda: F.lit(True), "prefix_quantile": lambda: F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_whole") * fit_share)), "history_quantile": lambda: fit & ~F.col("_few")}
    for f in features if mode != "expanding_quantile" else ():
        if mode in fits:
            df = _fitted(df, z[f], m, order, fits[mode]()).withColumnRenamed("_sym", sym[f])
        else:
            df = df.withColumn(sym[f], symbol(z[f], uniform_edges(m, zmax) if mode == "fixed_uniform" else normal_edges(m, zmax)))
    df = df.drop("_place", "_whole", "_few")
    if fill == "bfill":
        df = df.withColumns({sym[f]: F.coalesce(backward_fill(F.nullif(F.col(sym[f]), F.lit(MISSING)), order), F.lit(MISSING)) for f in features})
    elif fill != "none":  # z has been filled backwards before
        df = df.withColumns({z[f]: forward_fill(z[f], order) for f in features})
    return df.withColumns({sym[f]: F.col(sym[f]).cast("int") for f in features})


def encode(df: DataFrame, feature: str, *args, **options) -> DataFrame:
    """:func:`encode_all` of one feature."""
    return encode_all(df, [feature], *args, **options)


def combine(predicted: Column | str, predictor: Column | str, m: int) -> Column:
    """One symbol below m * m from two below m."""
    return col(predicted) + m * col(predictor)


def band_symbols(
    df: DataFrame, feature: str, alpha: float = 0.25, beta: float = 1.0, deviation: str = "ewm", order: Order = DAY, decimals: int | None = None
) -> DataFrame:
    """``{feature}_sym``, four symbols: below the band, its lower and upper half, above; -1 for a missing value.

    The band is the exponential mean plus and minus ``beta`` deviations: the debiased exponential one, or (``rolling``) the
    sample one of the last 2 / alpha rows, fewer at the start; a missing deviation is 0. ``decimals`` rounds the distance
    and the deviation.
    """
    if deviation not in ("ewm", "rolling"):
        raise ValueError("deviation must be 'ewm' or 'rolling'")
    x = finite(feature)
    df = ewm_deviation(df, {"_bm": Ewm(feature, alpha)}, order)
    sd = F.col("_bm_sd") if deviation == "ewm" else F.stddev_samp(x).over(order.rows().rowsBetween(-(int(2 / alpha) - 1), 0))
    d, s = _rounded(x - F.col("_bm"), decimals), _rounded(beta * F.coalesce(sd, F.lit(0.0)), decimals)
    df = df.withColumns({"_bd": d, "_bs": s})
    d, s = F.col("_bd"), F.col("_bs")
    count = (d >= -s).cast("int") + (d >= 0).cast("int") + (d >= s).cast("int")
    return _dropped(df.withColumn(f"{feature}_sym", F.when(d.isNotNull(), count).otherwise(MISSING)), "_bm", "_bd", "_bs")


def five_symbols(
    df: DataFrame, feature: str, alpha: float = 0.25, alpha_deviation: float = 0.25, order: Order = DAY, decimals: int | None = None
) -> DataFrame:
    """``{feature}_sym``, -2..2: at or below one deviation, at or below a hundredth of one, within it (ends included), up to one
    deviation, above.

    So a flat stretch, whose deviation is 0, gives -2; without a deviation (a series' first value, a missing one) the
    symbol is 0. ``decimals`` rounds the distance and the deviation.
    """
    x = finite(feature)
    df = ewm_deviation(df, {"_fm": Ewm(feature, alpha), "_fs": Ewm(feature, alpha_deviation)}, order)
    df = df.withColumns({"_fd": _rounded(x - F.col("_fm"), decimals), "_fw": _rounded(F.col("_fs_sd"), decimals)})
    d, s = F.col("_fd"), F.col("_fw")
    small = _rounded(0.01 * s, decimals)
    sym = F.when(d.isNull() | s.isNull(), 0).when(d <= -s, -2).when(d <= -small, -1).when(d <= small, 0).when(d <= s, 1).otherwise(2)
    return _dropped(df.withColumn(f"{feature}_sym", sym), "_fm", "_fs", "_fd", "_fw")


def _rounded(c: Column, decimals: int | None) -> Column:
    return c if decimals is None else F.round(c, decimals)


def gaussian_symbols(
    df: DataFrame, feature: str, m: int = 4, alpha: float = 0.05, min_periods: int = 50, clip: float = 4.0, scale: float = 1.0, legacy_offset: bool = False, order: Order = DAY
) -> DataFrame:
    """``{feature}_sym``: the clipped exponential z-score cut at normal quantiles, -1 where there is none. ``legacy_offset``: one less,
    from -1, and m - 2 where there is none."""
    df = ewm_deviation(df, {"_gm": Ewm(feature, alpha, min_periods)}, order)
    z = finite(F.try_divide(finite(feature) - F.col("_gm"), scale * F.col("_gm_sd")))
    df = df.withColumn("_gz", F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))))
    sym = symbol("_gz", normal_edges(m, clip), m - 1 if legacy_offset else MISSING) - F.lit(int(legacy_offset))
    return _dropped(df.withColumn(f"{feature}_sym", sym), "_gm", "_gz")


def sign_of(c: Column | str, threshold: float = 1e-6) -> Column:
    """-1, 0 or 1 with a dead zone."""
    return F.when(col(c) > threshold, 1).when(col(c) < -threshold, -1).otherwise(0)


def two_signs(c: Column | str) -> Column:
    """-1 at or below 0, else 1."""
    return F.when(col(c) <= 0, -1).otherwise(1)


def zero_one(c: Column | str) -> Column:
    return F.when(col(c) <= 0, 0).otherwise(1)
