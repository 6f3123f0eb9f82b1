"""Bars: every n events, clock time, traded volume; and features of consecutive bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.series import DAY, Order, col, diff, forward_fill, position, utc_micros
from .orderflow import book_columns

#: A series of bars.
BARS = Order(by=("sample_idx",))


def event_bars(df: DataFrame, n: int = 10, take: str = "last", order: Order = DAY) -> DataFrame:
    """One row of every n: the last (an unfinished block goes) or the first, with ``event_idx`` and ``sample_idx``."""
    if take not in ("last", "first"):
        raise ValueError("take must be 'last' or 'first'")
    df = df.withColumn("event_idx", position(order).cast("long"))
    kept = df.where(F.col("event_idx") % n == (n - 1 if take == "last" else 0))
    return kept.withColumn("sample_idx", F.floor(F.col("event_idx") / n).cast("long"))


def time_bars(df: DataFrame, seconds: int = 60, fill: bool = True, order: Order = DAY) -> DataFrame:
    """One row for each clock bucket: its last non-null book, counts and volatility inside it.

    Needs mid_price, log_mid and sigma_W. With ``fill`` empty buckets between a series' first and last get 0 events and
    the state before them. The grid is a generated range for each series, joined on its bucket.
    """
    keys, eps = list(order.keys), 1e-12
    start = F.timestamp_seconds(F.floor(utc_micros(df, "ts_event") / (seconds * 1_000_000)) * seconds)
    df = df.withColumn("bucket_start", start)
    inside = Order((*order.keys, "bucket_start"), order.by)
    df = df.withColumns({"_moved": (F.lag("mid_price").over(inside.rows()) != F.col("mid_price")).cast("int"), "_r": diff("log_mid", inside)})
    state = [*book_columns(df), "mid_price", "log_mid", "sigma_W"]
    place = F.struct(*order.by)
    micros = utc_micros(df, "ts_event")
    bars = df.groupBy(*keys, "bucket_start").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in state),
        F.max("ts_event").alias("ts_last_event"),
        F.count("*").alias("event_count"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("dt_span_sec"),
        F.coalesce(F.sum("_moved"), F.lit(0)).alias("mid_change_count"),
        F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("sigma_bucket"),
    )
    bars = bars.withColumn("dt_bucket_sec", F.lit(float(seconds)))
    if fill:
        grid = bars.groupBy(*keys).agg(F.min("bucket_start").alias("_a"), F.max("bucket_start").alias("_b"))
        grid = grid.select(*keys, F.explode(F.sequence("_a", "_b", F.make_interval(secs=F.lit(seconds)))).alias("bucket_start"))
        by_time = Order(order.keys, ("bucket_start",))
        bars = grid.join(bars, [*keys, "bucket_start"], "left")
        bars = bars.withColumns({c: forward_fill(c, by_time) for c in (*state, "ts_last_event")})
        bars = bars.fillna(0, subset=["event_count", "mid_change_count", "dt_span_sec"])
    pace = F.col("event_count") / F.lit(float(seconds))
    bars = bars.withColumns(
        {
            "event_intensity": pace,
            "log_event_intensity": F.log(F.greatest(pace, F.lit(eps))),
            "move_rate_per_event": F.try_divide(F.col("mid_change_count"), F.col("event_count")),
            "move_rate_per_sec": F.col("mid_change_count") / F.lit(float(seconds)),
        }
    )
    return bars.withColumn("sample_idx", position(Order(order.keys, ("bucket_start",))).cast("long"))


def volume_bars(df: DataFrame, shares: float = 10_000, order: Order = DAY) -> DataFrame:
    """The event at which signed traded volume first reaches each multiple of ``shares``.

    Needs trade_signs and mid_changed. One trade that crosses several multiples gives a row for each; all but the first
    of them are empty (0 events, null rates).
    """
    signed = F.col("trade_buy_vol_event") + F.col("trade_sell_vol_event")
    df = df.withColumns(
        {
            "cum_trade_vol": F.sum(signed).over(order.past()),
            "_moves": F.sum("mid_changed").over(order.past()),
            "_events": F.count("*").over(order.past()),
        }
    ).withColumn("_before", F.coalesce(F.lag("cum_trade_vol").over(order.rows()), F.lit(0.0)))
    low, high = F.floor(F.col("_before") / shares) + 1, F.floor(F.col("cum_trade_vol") / shares)
    df = df.where(high >= low).withColumn("_j", F.explode(F.sequence(low, high)))
    df = df.withColumn("sample_idx", F.col("_j") - 1).withColumn("volume_threshold", F.col("_j") * F.lit(float(shares)))
    since = lambda c: F.col(c) - F.coalesce(F.lag(c).over(BARS_OF(order)), F.lit(0))
    df = df.withColumns(
        {"bucket_trade_vol": since("cum_trade_vol"), "events_in_bucket": since("_events"), "mid_change_count_vol_bucket": since("_moves")}
    )
    moves = F.col("mid_change_count_vol_bucket")
    return df.withColumns(
        {
            "move_rate_per_share": F.try_divide(moves, F.col("bucket_trade_vol")),
            "move_rate_per_event_in_vol_bucket": F.try_divide(moves, F.col("events_in_bucket")),
        }
    ).drop("_moves", "_events", "_before", "_j")


def BARS_OF(order: Order):  # noqa: N802
    return Order(order.keys, ("sample_idx",)).rows()


def targets(df: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4), value: str = "log_mid", order: Order = BARS, zero_only: bool = False) -> DataFrame:
    """Forward return, backward and forward sums over k bars, and their ratio.

    The ratio is null where the backward sum is below 1e-12 in size (``zero_only``: where it is 0, as for time bars).
    """
    out: dict[str, Column] = {}
    for k in ks:
        back, ahead = order.rows().rowsBetween(-(k - 1), 0), order.rows().rowsBetween(1, k)
        full = lambda w, k=k: F.when(F.count(value).over(w) >= k, F.sum(value).over(w))
        bwd, fwd = full(back), full(ahead)
        sound = bwd != 0 if zero_only else F.abs(bwd) >= 1e-12
        out |= {
            f"log_mid_return_fwd_{k}": F.lead(value, k).over(order.rows()) - F.col(value),
            f"log_mid_sum_bwd_{k}": bwd,
            f"log_mid_sum_fwd_{k}": fwd,
            f"log_mid_sum_ratio_{k}": F.when(sound, (fwd - bwd) / bwd),
        }
    return df.withColumns(out)


def book_features(df: DataFrame, order: Order = BARS, share_of_bid: bool = False) -> DataFrame:
    """Micro price, imbalance, spreads and crossings of the previous bar's quotes.

    ``share_of_bid``: imbalance as bid / (bid + ask), as for time and volume bars; else (bid - ask) / (bid + ask).
    """
    bid, ask, bq, aq = (F.col(c) for c in ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"))
    ratio = F.try_divide(bq, bq + aq)
    both = F.coalesce(F.try_divide(bq - aq, bq + aq), F.lit(0.0))
    df = df.withColumns(
        {
            "bid_ratio_L1": ratio,
            "micro_price": ratio * ask + (1 - ratio) * bid,
            "obi_L1": both,
            "imbalance": ratio if share_of_bid else both,
            "spread": ask - bid,
            "rel_spread": F.try_divide(ask - bid, F.col("mid_price")),
            "log_spread": F.log(F.greatest(ask, F.lit(1e-12))) - F.log(F.greatest(bid, F.lit(1e-12))),
        }
    )
    before = lambda c: F.lag(c).over(order.rows())
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    micro_mid = F.col("micro_price") - F.col("mid_price")
    return df.withColumns(
        {
            "micro_mid": micro_mid,
            "micro_mid_sign": F.signum(micro_mid),
            "mid_cross_prev_ask_up": flag(F.col("mid_price") > before("ask_px_00")),
            "mid_cross_prev_bid_dn": flag(F.col("mid_price") < before("bid_px_00")),
            "log_mid_ret": diff("log_mid", order),
            "mid_ret": diff("mid_price", order),
            "jump_gt_prev_spread": flag(F.abs(diff("mid_price", order)) > before("spread")),
        }
    )


def regularise(df: DataFrame, value: str, seconds: float, how: str = "last", order: Order = DAY, time: str = "ts_event", fill: bool = True) -> DataFrame:
    """``value`` on a regular grid of ``seconds``: the last, first, mean or sum of each bucket, empty ones filled forward.

    Gives the keys, ``bucket_start`` and ``value``.
    """
    keys, step = list(order.keys), int(seconds * 1_000_000)
    micros = utc_micros(df, time)
    df = df.withColumn("_bucket", F.floor(micros / step)).where(F.col(value).isNotNull())
    place = F.struct(time, *(c for c in order.by if c != time))
    how_ = {"last": F.max_by(value, place), "first": F.min_by(value, place), "mean": F.avg(value), "sum": F.sum(value)}[how]
    bars = df.groupBy(*keys, "_bucket").agg(how_.alias(value))
    if fill:
        grid = bars.groupBy(*keys).agg(F.explode(F.sequence(F.min("_bucket"), F.max("_bucket"))).alias("_bucket"))
        bars = grid.join(bars, [*keys, "_bucket"], "left").withColumn(value, forward_fill(value, Order(order.keys, ("_bucket",))))
    return bars.select(*keys, F.timestamp_micros(F.col("_bucket") * step).alias("bucket_start"), value)


def resample(df: DataFrame, value: str, seconds: float, how: str = "last", order: Order = DAY, first: float = 0.01) -> DataFrame:
    """Two steps: a fine regular grid of ``first`` seconds, then ``seconds`` with the same reducer, both filled.

    For 'last' the fine step changes nothing, so it is left out; else it weighs each fine bucket alike. The fine grid's
    filled buckets count in the second step without being made: a run of them is one row with its length.
    """
    if how in ("last",) or seconds <= first:
        return regularise(df, value, seconds, how, order)
    keys, step = list(order.keys), round(seconds / first)
    fine = regularise(df, value, first, how, order, fill=False)
    fine = fine.withColumn("_i", F.floor(F.unix_micros("bucket_start") / int(first * 1_000_000)))
    by = Order(order.keys, ("_i",))
    fine = fine.withColumn("_next", F.coalesce(F.lead("_i").over(by.rows()), F.col("_i") + 1))
    parts = fine.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_i") / step), F.floor((F.col("_next") - 1) / step))))
    run = F.least(F.col("_next"), (F.col("_b") + 1) * step) - F.greatest(F.col("_i"), F.col("_b") * step)
    total = F.sum(F.col(value) * run)
    reduced = {"mean": total / F.sum(run), "sum": total, "first": F.min_by(value, "_i")}[how]
    return parts.groupBy(*keys, "_b").agg(reduced.alias(value)).select(
        *keys, F.timestamp_micros(F.col("_b") * int(seconds * 1_000_000)).alias("bucket_start"), value
    )


def bucket_lists(df: DataFrame, value: str, bucket: Column | str, order: Order = DAY) -> DataFrame:
    """The values of each bucket in order, an empty list for a bucket without rows between a series' first and last."""
    keys = list(order.keys)
    lists = df.groupBy(*keys, col(bucket).alias("bucket")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*order.by, F.col(value).alias("_v")))), lambda s: s["_v"]).alias("values")
    )
    grid = lists.groupBy(*keys).agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"))).alias("bucket"))
    return grid.join(lists, [*keys, "bucket"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))


def bucket_summaries(df: DataFrame, value: str, weight: str, bucket: Column | str, order: Order = DAY) -> DataFrame:
    """Last, mean, weighted mean and middle of first and last value of each bucket."""
    place = F.struct(*order.by)
    first, last = F.min_by(value, place), F.max_by(value, place)
    return df.groupBy(*order.keys, col(bucket).alias("bucket")).agg(
        last.alias("last"),
        F.avg(value).alias("mean"),
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted"),
        ((first + last) / 2).alias("first_last"),
    )
