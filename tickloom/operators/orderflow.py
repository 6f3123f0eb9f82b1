"""Event-level features of an order book: mid price, order flow, trade signs, VPIN, session filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.series import DAY, Order, backward_fill, diff, finite, forward_fill, ln, rolling, utc_micros
from ..sources.lob import LEVELS, PREFIXES


def regular_hours(df: DataFrame, start: str = "09:30:00", end: str = "15:30:00", zone: str = "America/New_York") -> DataFrame:
    """Adds ``ts_et``, the clock of ``zone`` written as if it were UTC, and keeps times of day from start to end, both included;
    ``ts_event`` is UTC. The session's own time zone plays no part."""
    a, b = (sum(int(x) * s for x, s in zip(t.split(":"), (3600, 60, 1), strict=True)) for t in (start, end))
    df = df.withColumn("ts_et", F.from_utc_timestamp(F.timestamp_micros(utc_micros(df, "ts_event")), zone))
    return df.where((F.pmod(F.unix_micros("ts_et"), F.lit(_DAY)) / 1e6).between(a, b))


def fixed_offset_hours(df: DataFrame, start: tuple[int, int, int] = (14, 30, 0), end: tuple[int, int, int] = (20, 30, 0)) -> DataFrame:
    """The older session filter: UTC times of day, both ends included, blind to daylight saving."""
    a, b = (h * 3600 + m * 60 + s for h, m, s in (start, end))
    return df.where((F.pmod(utc_micros(df, "ts_event"), F.lit(_DAY)) / 1e6).between(a, b))


#: Microseconds of a day.
_DAY = 86_400_000_000


def book_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIXES)]


def fill_book(df: DataFrame, order: Order = DAY) -> DataFrame:
    """Every book column carries its last non-null value forward; NaN counts as null."""
    return df.withColumns({c: forward_fill(finite(c), order) for c in book_columns(df)})


def drop_unquoted(df: DataFrame, order: Order = DAY) -> DataFrame:
    """Quotes filled forward; rows before the first quote go."""
    return fill_book(df, order).dropna(subset=["bid_px_00", "ask_px_00"])


def repair(df: DataFrame, column: str, order: Order = DAY) -> DataFrame:
    """NaN, infinite and null values take the last sound one; before the first they are 0."""
    return df.withColumn(column, F.coalesce(forward_fill(finite(column), order), F.lit(0.0)))


def event_features(df: DataFrame, n: int = 10, w: int = 300, order: Order = DAY) -> DataFrame:
    """Mid price, its log and return, trailing volatility, moves and pace of events.

    ``n``: rows of the short window, ``w``: of the volatility's. Null where a window isn't full, save for counts of moves.
    """
    mid = (F.col("bid_px_00") + F.col("ask_px_00")) / 2
    df = df.withColumn("mid_price", mid).withColumn("log_mid", ln(mid))
    seconds = utc_micros(df, "ts_event")
    df = df.withColumns(
        {
            "log_mid_ret": diff("log_mid", order),
            "mid_changed": F.coalesce((diff("mid_price", order) != 0).cast("int"), F.lit(0)),
            "_gap": (seconds - F.lag(seconds, n - 1).over(order.rows())) / 1e6,
        }
    ).withColumn("_square", F.col("log_mid_ret") * F.col("log_mid_ret"))
    df = rolling(df, {"_squares": ("_square", w, w), "mid_change_count_n": ("mid_changed", n, 1)}, order)
    dt = F.when(F.col("_gap").isNotNull(), F.greatest("_gap", F.lit(1e-9)))
    return df.withColumns(
        {
            "sigma_W": F.sqrt(F.col("_squares") / w),
            "move_rate_per_event": F.col("mid_change_count_n") / n,
            "dt_block_sec": dt,
            "log_dt_block": F.log(dt),
            "event_intensity": n / dt,
            "log_event_intensity": F.log(n / dt),
            "move_rate_per_sec": F.col("mid_change_count_n") / dt,
        }
    ).drop("_square", "_squares", "_gap")


def _flow(k: int, order: Order) -> Column:
    """Order-flow imbalance of level k; null on a series' first row."""
    def side(name: str, better: int) -> Column:
        price, size = F.col(f"{name}_px_{k:02d}"), F.col(f"{name}_sz_{k:02d}")
        moved, before = (price - F.lag(price).over(order.rows())) * better, F.lag(size).over(order.rows())
        return F.when(moved > 0, size).when(moved < 0, -before).when(moved == 0, size - before)

    return side("bid", 1) - side("ask", -1)


def flow_imbalance(df: DataFrame, n: int = 10, order: Order = DAY, strict: bool = False) -> DataFrame:
    """``ofi_L1`` (0 on the first row), its trailing sum, and that over the mean depth (0 without depth).

    ``strict``, as volume bars have it: null on the first row, and no sum without n values.
    """
    flow = _flow(0, order) if strict else F.coalesce(_flow(0, order), F.lit(0.0))
    df = df.withColumns({"ofi_L1": flow, "_depth": F.col("bid_sz_00") + F.col("ask_sz_00"), "_one": F.lit(1)})
    df = rolling(df, {"ofi_L1_n": ("ofi_L1", n, n if strict else 1), "_depths": ("_depth", n, 1), "_rows": ("_one", n, 1)}, order)
    norm = F.coalesce(F.try_divide(F.col("ofi_L1_n"), F.col("_depths") / F.col("_rows")), F.lit(0.0))
    return df.withColumn("ofi_L1_n_norm", norm).drop("_depth", "_one", "_depths", "_rows")


def flow_level(df: DataFrame, k: int, n: int | None = None, prefix: str = "ofi", order: Order = DAY) -> DataFrame:
    """``ofi_k`` with 0 on the first row, and the trailing sum of the unfilled series."""
    if not 0 <= k < LEVELS:
        raise ValueError(f"level {k} is not below {LEVELS}")
    df = df.withColumn("_flow", _flow(k, order))
    if n:
        df = rolling(df, {f"{prefix}_{k}_n": ("_flow", n, 1)}, order)
    return df.withColumn(f"{prefix}_{k}", F.coalesce("_flow", F.lit(0.0))).drop("_flow")


def level_weights(levels: int, kind: str = "uniform", tau: float = 3.0) -> list[float]:
    """Weights that sum to 1: alike, as 1 / (k + 1), or falling exponentially."""
    raw = {"uniform": lambda k: 1.0, "inverse": lambda k: 1.0 / (k + 1), "exponential": lambda k: math.exp(-k / tau)}
    if kind not in raw:
        raise ValueError(f"weights must be one of {sorted(raw)}")
    w = [raw[kind](k) for k in range(min(levels, LEVELS))]
    return [x / sum(w) for x in w]


def flow_levels(df: DataFrame, levels: int, n: int | None = None, kind: str = "uniform", tau: float = 3.0, order: Order = DAY) -> DataFrame:
    """Weighted flow of several levels (0 on the first row) and its trailing sum, null until full."""
    w = level_weights(levels, kind, tau)
    name = f"ofi_L{len(w)}"
    df = df.withColumn(name, sum(F.lit(x) * F.coalesce(_flow(k, order), F.lit(0.0)) for k, x in enumerate(w)))
    return rolling(df, {f"{name}_n": (name, n, n)}, order) if n else df


def flow_levels_normalised(df: DataFrame, levels: int, n: int = 10, kind: str = "uniform", tau: float = 3.0, eps: float = 1e-12, order: Order = DAY) -> DataFrame:
    """The weighted flow over the weighted depth, at the row and over trailing sums."""
    return flows_normalised(df, (levels,), n, kind, tau, eps, order)


def flows_normalised(df: DataFrame, each: tuple[int, ...], n: int = 10, kind: str = "uniform", tau: float = 3.0, eps: float = 1e-12, order: Order = DAY) -> DataFrame:
    """:func:`flow_levels_normalised` of several numbers of levels: a level's flow is made once, and all trailing sums are one pass of rows
    that need no level any more."""
    weights = {f"ofi_L{len(w)}": w for w in (level_weights(levels, kind, tau) for levels in each)}
    df = df.withColumns({f"_flow_{k}": F.coalesce(_flow(k, order), F.lit(0.0)) for k in range(max(map(len, weights.values())))})
    made = {}
    for name, w in weights.items():
        depth = sum(F.lit(x) * (F.col(f"bid_sz_{k:02d}") + F.col(f"ask_sz_{k:02d}")) for k, x in enumerate(w))
        made |= {name: sum(F.lit(x) * F.col(f"_flow_{k}") for k, x in enumerate(w)), f"_depth_{name}": F.greatest(depth, F.lit(eps))}
    df = df.withColumns(made)
    sums = {f"_{s}_{name}": (c, n, 1) for name in weights for s, c in (("flows", name), ("depths", f"_depth_{name}"))}
    df = rolling(df, sums, order)
    out = {}
    for name in weights:
        out |= {f"{name}_norm": F.col(name) / F.col(f"_depth_{name}"), f"{name}_norm_n": F.col(f"_flows_{name}") / F.greatest(f"_depths_{name}", F.lit(eps))}
    return df.withColumns(out).drop(*sums, *(c for c in df.columns if c.startswith(("_flow_", "_depth_"))))


def trade_signs(df: DataFrame, order: Order = DAY) -> DataFrame:
    """``is_trade``, ``aggressor`` (+1 buyer, -1 seller, 0 no trade or unknown) and the volumes bought and sold.

    A trade without a side takes the sign of its price against the mid, else of the last price change over all
    events, else that of the last trade without a side that had one.
    """
    trade = F.coalesce(F.upper("action").startswith("T"), F.lit(False))
    side, mid = F.upper("side"), (F.col("bid_px_00") + F.col("ask_px_00")) / 2
    guess = F.when(F.col("price") > mid, 1).when(F.col("price") < mid, -1).otherwise(F.signum(diff("price", order)).cast("int"))
    df = df.withColumn("is_trade", trade).withColumn("_guess", F.when(trade & (side == "N"), F.nullif(guess, F.lit(0))))
    sign = F.when(trade & (side == "B"), 1).when(trade & (side == "A"), -1)
    sign = sign.when(trade & (side == "N"), F.coalesce(forward_fill("_guess", order), F.lit(0))).otherwise(0)
    df = df.withColumn("aggressor", sign).drop("_guess")
    volume = lambda s: F.when(F.col("is_trade") & (F.col("aggressor") == s), F.col("size")).otherwise(0.0)
    return df.withColumns({"trade_buy_vol_event": volume(1), "trade_sell_vol_event": volume(-1)})


def trade_imbalance(df: DataFrame, n: int = 10, order: Order = DAY, strict: bool = False) -> DataFrame:
    """Trailing volumes (null until full) and their imbalance ``tvi_n`` (0 where undefined; ``strict``: null), also as ``trade_ofi_n``."""
    df = rolling(df, {"trade_buy_vol_n": ("trade_buy_vol_event", n, n), "trade_sell_vol_n": ("trade_sell_vol_event", n, n)}, order)
    b, s = F.col("trade_buy_vol_n"), F.col("trade_sell_vol_n")
    tvi = F.try_divide(b - s, b + s)
    tvi = tvi if strict else F.coalesce(tvi, F.lit(0.0))
    return df.withColumns({"tvi_n": tvi, "trade_ofi_n": tvi})


def vpin(df: DataFrame, volume: float = 10_000, buckets: int = 10, order: Order = DAY, causal: bool = False) -> DataFrame:
    """``vpin`` and ``dvpin`` over buckets of traded volume.

    A trade has its whole bucket's value, events the last trade's, and those before the first value the first one; with
    ``causal`` a trade has the bucket before its own and nothing is filled backwards.
    """
    keys = list(order.keys)
    traded = F.sum(F.when(F.col("is_trade"), F.col("size")).otherwise(0.0)).over(order.past())
    df = df.withColumn("_bucket", F.when(F.col("is_trade"), F.floor(traded / volume)))
    per = df.where("_bucket is not null").groupBy(*keys, "_bucket").agg(
        (F.abs(F.sum("trade_buy_vol_event") - F.sum("trade_sell_vol_event")) / volume).alias("_imbalance")
    )
    by_bucket = Order(order.keys, ("_bucket",))
    frame = by_bucket.rows().rowsBetween(-(buckets - 1), 0)
    mean = F.when(F.count("_imbalance").over(frame) >= buckets, F.avg("_imbalance").over(frame))
    per = per.withColumn("_vpin", mean)
    if causal:
        per = per.withColumn("_vpin", F.lag("_vpin").over(by_bucket.rows()))
    per = per.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_of"), "_vpin")
    same = F.col("_of") == F.col("_bucket")
    for k in keys:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
    df = df.join(per, same, "left").drop(*(f"_{k}" for k in keys), "_of", "_bucket")
    df = df.withColumn("_filled", forward_fill("_vpin", order))
    if not causal:
        df = df.withColumn("_filled", F.coalesce("_filled", backward_fill("_filled", order)))
    df = df.withColumn("vpin", F.col("_filled")).withColumn("_change", diff("vpin", order))
    filled = F.col("_change") if causal else backward_fill("_change", order)
    return df.withColumn("dvpin", filled).drop("_vpin", "_filled", "_change")


def quote_features(df: DataFrame, dead_zone: float = 1e-7, order: Order = DAY) -> DataFrame:
    """Features of the best quotes alone: whole seconds since the series' first row, relative spread, volumes, their
    imbalance, and changes of imbalance and mid price.

    ``spread`` is bid less ask over their sum, so it is never positive and ``log_spread`` is null. A relative change from
    0 is 0 where the value stays 0, else 1. ``mid_price_movement`` ignores changes up to ``dead_zone``.
    """
    bid, ask, bq, aq = (F.col(c) for c in ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"))
    whole = F.floor(utc_micros(df, "ts_event") / 1_000_000)
    share = lambda a, b: F.when(a + b == 0, 0.0).otherwise(F.try_divide(a - b, a + b))
    mid = (bid + ask) / 2
    df = df.withColumns(
        {
            "secs": whole - F.first(whole).over(order.past()),
            "mid_price": mid,
            "log_mid_price": ln(mid),
            "spread": share(bid, ask),
            "vol_weight": aq * ask + bq * bid,
            "vol": aq + bq,
            "vol_imb": share(bq, aq),
        }
    )
    last = lambda c: F.lag(c).over(order.rows())
    imbalance, before = F.col("vol_imb"), last("vol_imb")
    change = diff("mid_price", order)
    df = df.withColumns(
        {
            "log_spread": F.when(F.col("spread") > 0, F.log("spread")),
            "vol_imb_returns": imbalance - before,
            "vol_imb_innovation": F.when(before == 0, F.when(imbalance == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(imbalance - before, before)),
            "mid_price_returns": change,
            "mid_price_innovation": F.try_divide(change, last("mid_price")),
            "mid_price_movement": F.when(change > dead_zone, 1).when(change < -dead_zone, -1).otherwise(0),
            "log_mid_price_innovation": diff("log_mid_price", order),
            "mid_price_sqr_returns": change * change,
        }
    )
    return df.withColumn("mid_price_sqr_returns_innovation", diff("mid_price_sqr_returns", order))
