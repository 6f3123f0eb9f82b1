"""The end-to-end plan: events to bars, bars to symbols, symbols to sequence and class distributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.series import DAY, Order
from ..functions.tables import written
from ..operators import bars, encode, labels, ngrams, orderflow


@dataclass(frozen=True)
class Settings:
    frequency: int = 100
    resampling: str = "events"
    symbols: int = 4
    alpha: float = 0.05
    ks: tuple[int, ...] = (1, 2, 3, 4)
    longest: int = 6
    label: str = "c1"
    mode: str = "expanding_quantile"
    regular_hours: bool = True
    vpin_volume: float = 10_000
    vpin_buckets: int = 10
    tau: float = 3.0
    decimals: int | None = None


def featured_bars(events: DataFrame, s: Settings = Settings(), order: Order = DAY, needed: list[str] | None = None) -> DataFrame:
    """Bars of one kind with all features that kind has. Unused columns are pruned, so ask for what is needed; VPIN has a join that
    no pruning takes away, and is left out where ``needed`` names columns without it."""
    if s.resampling not in ("events", "seconds", "volume"):
        raise ValueError("resampling must be 'events', 'seconds' or 'volume'")
    df = orderflow.regular_hours(events) if s.regular_hours else events
    df = orderflow.fill_book(df, order)
    n = s.frequency if s.resampling == "events" else 10
    df = orderflow.event_features(df, n, 3 * s.frequency, order)
    on = Order(order.keys, ("sample_idx",))
    if s.resampling == "seconds":
        return bars.book_features(bars.targets(bars.time_bars(df, s.frequency, order=order), s.ks, order=on, zero_only=True), on, True)
    volume = s.resampling == "volume"  # its flow and imbalance stay null where they aren't defined
    if not volume:  # first, since later windows then move rows without levels
        df = orderflow.flow_levels(df, 10, n, "exponential", s.tau, order)
        df = orderflow.flows_normalised(df, (1, 3, 10), n, "exponential", s.tau, order=order)
    df = orderflow.flow_imbalance(df, n, order, strict=volume)
    df = orderflow.trade_imbalance(orderflow.trade_signs(df, order), n, order, strict=volume)
    if s.resampling == "volume":
        return bars.book_features(bars.targets(bars.volume_bars(df, s.frequency, order), s.ks, order=on), on, True)
    if needed is None or {"vpin", "dvpin"} & set(needed):
        df = orderflow.vpin(df, s.vpin_volume, s.vpin_buckets, order)
    return bars.book_features(bars.targets(bars.event_bars(df, s.frequency, order=order), s.ks, order=on), on)


def symbols(df: DataFrame, features: list[str], s: Settings = Settings(), order: Order = bars.BARS) -> DataFrame:
    """keys, order, feature, symbol: every feature of the bars encoded as a series of its own, so the plan has one recursion whatever
    their number, and a task holds one feature of one series."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in dict.fromkeys(features))))
    long = df.select(*order.keys, *order.by, each.alias("_e")).select(*order.keys, *order.by, "_e.feature", "_e.x")
    own = Order((*order.keys, "feature"), order.by)
    coded = encode.encode(long, "x", s.symbols, s.alpha, mode=s.mode, fill="bfill", order=own, decimals=s.decimals)
    return coded.select(*order.keys, *order.by, "feature", F.col("x_sym").alias("symbol"))


def encoded(df: DataFrame, predicted: str, predictors: list[str], s: Settings = Settings(), order: Order = bars.BARS) -> DataFrame:
    """Symbols of all features beside the bars' columns, and the combined symbol ``sym_<predictor>`` of each pair."""
    features, on = list(dict.fromkeys([predicted, *predictors])), [*order.keys, *order.by]
    wide = symbols(df, features, s, order).groupBy(*on).agg(*(F.max(F.when(F.col("feature") == f, F.col("symbol"))).alias(f"{f}_sym") for f in features))
    df = df.join(wide, on)
    return df.withColumns({f"sym_{p}": encode.combine(f"{predicted}_sym", f"{p}_sym", s.symbols) for p in predictors})


def distributions(df: DataFrame, predictor: str, s: Settings = Settings(), order: Order = bars.BARS) -> tuple[DataFrame, DataFrame]:
    """Sequence and class distributions by series, from :func:`encoded` bars."""
    labelled = labels.class_label(df, s.label, order=order)
    symbol = f"sym_{predictor}"
    return ngrams.counts(df, symbol, s.longest, order), ngrams.class_counts(labelled, symbol, "class", s.longest, order)


def period_distributions(events: DataFrame, predicted: str, predictor: str, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Both distributions of one predictor folded over all days, by instrument."""
    return tuple(x.drop("predictor") for x in period_plan(events, predicted, [predictor], s))


def day_symbols(events: DataFrame, predicted: str, predictors: list[str], s: Settings = Settings()) -> DataFrame:
    """keys, order, class, predictor, symbol: the combined symbol of the predicted feature and each predictor for every bar.

    Only the columns that symbols and labels need leave the bars, so the features behind all others are never computed. Bars
    and symbols are written to the shared folder once, for all that reads them.
    """
    k, order = s.label.lstrip("ca"), bars.BARS
    needed = [f"log_mid_sum_fwd_{k}", f"log_mid_sum_bwd_{k}"] if s.label.startswith("ca") else [f"log_mid_return_fwd_{k}"]
    features, on = list(dict.fromkeys([predicted, *predictors])), [*order.keys, *order.by]
    asked = list(dict.fromkeys([*features, *needed]))
    made = written(featured_bars(events, s, needed=asked).select(*on, *asked), "bars")
    coded = symbols(made, features, s, order)
    first = F.max(F.when(F.col("feature") == predicted, F.col("symbol"))).over(Window.partitionBy(*on))
    both = coded.withColumn("_p", first).where(F.col("feature").isin(*predictors))
    both = both.select(*on, F.col("feature").alias("predictor"), encode.combine("_p", "symbol", s.symbols).alias("symbol"))
    return written(both.join(labels.class_label(made, s.label, order=order).select(*on, "class"), on), "symbols")


def period_plan(events: DataFrame, predicted: str, predictors: list[str], s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Sequence and class distributions of many predictors folded over all days, by instrument and ``predictor``."""
    coded = day_symbols(events, predicted, predictors, s)
    order, by = Order((*bars.BARS.keys, "predictor"), bars.BARS.by), ["instrument_id", "predictor"]
    seq, cls = ngrams.counts(coded, "symbol", s.longest, order), ngrams.class_counts(coded, "symbol", "class", s.longest, order)
    return ngrams.fold(seq, by, s.longest), ngrams.fold_classes(cls, by, s.longest)


def labelled_period(df: DataFrame, symbol: str, predicted: str, predictor: str, period: str) -> DataFrame:
    """A distribution with the columns by which it is stored."""
    return df.withColumns({"symbol": F.lit(symbol), "predicted": F.lit(predicted), "predictor": F.lit(predictor), "period": F.lit(period)})
