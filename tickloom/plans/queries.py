"""Registered queries over the order-book view, and their DuckDB twins.

Results are rounded alike on both sides; every query reads the whole ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.series import DAY, Order, dealt, diff
from ..operators import bars, dependence, encode, kraus, labels, neighbours, ngrams, orderflow, profile, volatility
from ..sources import lob
from . import daily

_BY0 = "instrument_id, trade_date"
KEY = ["instrument_id", "trade_date", "sequence"]
BAR = ["instrument_id", "trade_date", "sample_idx"]
N, W, BLOCK, SYMBOLS, ALPHA = 10, 30, 4, 4, 0.05

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def out(df: DataFrame, keys: list[str], *columns: str, digits: int = 9) -> DataFrame:
    """Keys and columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


# --- shared SQL ---------------------------------------------------------------------------------------------------

PART = "PARTITION BY instrument_id, trade_date"
ROWS = f"{PART} ORDER BY ts_event, sequence"
NEXT = f"{PART} ORDER BY sample_idx"


def trailing(expression: str, n: int, least: int = 1, order: str = ROWS) -> str:
    frame = f"OVER ({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expression}) {frame} >= {least} THEN sum({expression}) {frame} END"


def flow_sql(k: int) -> str:
    lag = lambda c: f"lag({c}) OVER ({ROWS})"
    bp, bq, ap, aq = f"bid_px_{k:02d}", f"bid_sz_{k:02d}", f"ask_px_{k:02d}", f"ask_sz_{k:02d}"
    bid = f"CASE WHEN {bp} > {lag(bp)} THEN {bq} WHEN {bp} < {lag(bp)} THEN -{lag(bq)} WHEN {bp} = {lag(bp)} THEN {bq} - {lag(bq)} END"
    ask = f"CASE WHEN {ap} < {lag(ap)} THEN {aq} WHEN {ap} > {lag(ap)} THEN -{lag(aq)} WHEN {ap} = {lag(ap)} THEN {aq} - {lag(aq)} END"
    return f"({bid}) - ({ask})"


LOB = f"WITH lob AS ({lob.view_sql('events')})"
MID = f"""{LOB}, m0 AS (SELECT *, (bid_px_00 + ask_px_00) / 2 AS mid_price, ln((bid_px_00 + ask_px_00) / 2) AS log_mid FROM lob),
m AS (SELECT *, log_mid - lag(log_mid) OVER ({ROWS}) AS log_mid_ret,
  coalesce(CAST(mid_price <> lag(mid_price) OVER ({ROWS}) AS INT), 0) AS mid_changed,
  greatest((epoch_us(ts_event) - lag(epoch_us(ts_event), {N - 1}) OVER ({ROWS})) / 1e6, 1e-9) AS dt0,
  lag(sequence, {N - 1}) OVER ({ROWS}) AS full_block FROM m0),
ev AS (SELECT *, CASE WHEN full_block IS NOT NULL THEN dt0 END AS dt_block_sec,
  sqrt(CASE WHEN count(log_mid_ret) OVER ({ROWS} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) >= {W}
    THEN avg(log_mid_ret * log_mid_ret) OVER ({ROWS} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) END) AS sigma_W,
  sum(mid_changed) OVER ({ROWS} ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW) AS mid_change_count_n FROM m)"""
SIGN = f"""{LOB}, g AS (SELECT *, upper(action) LIKE 'T%' AS is_trade, (bid_px_00 + ask_px_00) / 2 AS mid,
  price - lag(price) OVER ({ROWS}) AS moved FROM lob),
g1 AS (SELECT *, CASE WHEN is_trade AND side = 'N' THEN nullif(CASE WHEN price > mid THEN 1 WHEN price < mid THEN -1 ELSE CAST(sign(moved) AS INT) END, 0) END AS guess FROM g),
sg AS (SELECT *, CASE WHEN is_trade AND side = 'B' THEN 1 WHEN is_trade AND side = 'A' THEN -1
  WHEN is_trade AND side = 'N' THEN coalesce(last_value(guess IGNORE NULLS) OVER ({ROWS} ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS aggressor FROM g1),
tr AS (SELECT *, CASE WHEN is_trade AND aggressor = 1 THEN size ELSE 0e0 END AS trade_buy_vol_event,
  CASE WHEN is_trade AND aggressor = -1 THEN size ELSE 0e0 END AS trade_sell_vol_event FROM sg)"""
BARS_SQL = f"""{MID}, p AS (SELECT *, row_number() OVER ({ROWS}) - 1 AS event_idx FROM ev),
b AS (SELECT *, CAST(event_idx // {BLOCK} AS BIGINT) AS sample_idx FROM p WHERE event_idx % {BLOCK} = {BLOCK - 1})"""
_EWMA = f"""e0 AS (SELECT *, CASE WHEN i = 1 THEN NULL ELSE lag(x) OVER ({NEXT}) END AS xl FROM (SELECT *, row_number() OVER ({NEXT}) - 1 AS i FROM src)),
e1 AS (SELECT *, lag(x) OVER ({NEXT}) AS xp FROM e0),
e2 AS (SELECT *, pow({1 - ALPHA}e0, i - 1) * sum((CASE WHEN i = 1 THEN 1e0 ELSE {ALPHA}e0 END) * xp * pow({1 - ALPHA}e0, 1 - i)) OVER ({NEXT} ROWS UNBOUNDED PRECEDING) AS mu0 FROM e1),
e3 AS (SELECT *, CASE WHEN i >= 2 THEN mu0 END AS mu, CASE WHEN i >= 2 THEN xp - mu0 END AS d FROM e2),
e4 AS (SELECT *, pow({1 - ALPHA}e0, i - 2) * sum((CASE WHEN i = 2 THEN 1e0 ELSE {ALPHA}e0 END) * d * d * pow({1 - ALPHA}e0, 2 - i)) OVER ({NEXT} ROWS UNBOUNDED PRECEDING) AS var FROM e3),
z0 AS (SELECT *, CASE WHEN i >= 3 THEN (x - mu) / greatest(sqrt(var), 1e-12) END AS z_raw FROM e4),
z AS (SELECT *, round(first_value(z_raw IGNORE NULLS) OVER ({NEXT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS z FROM z0)"""


def view(spark: SparkSession, d: str) -> DataFrame:
    return lob.book_view(spark, d)


def event(spark: SparkSession, d: str) -> DataFrame:
    return orderflow.event_features(dealt(view(spark, d)), N, W)


def signed(spark: SparkSession, d: str) -> DataFrame:
    return orderflow.trade_signs(view(spark, d))


def bar(spark: SparkSession, d: str) -> DataFrame:
    return bars.event_bars(event(spark, d), BLOCK)


# --- scans, filters -----------------------------------------------------------------------------------------------


@register(f"{LOB} SELECT instrument_id, trade_date, sequence, action, side, size, price, bid_px_00, ask_px_00, bid_sz_09, ask_sz_09 FROM lob")
def lob_view(spark, d):
    return view(spark, d).select(*KEY, "action", "side", "size", "price", "bid_px_00", "ask_px_00", "bid_sz_09", "ask_sz_09")


@register(
    f"""{LOB}, h AS (SELECT instrument_id, trade_date, sequence, ts_event, CASE WHEN sequence % 7 > 0 THEN bid_px_00 END AS b,
CASE WHEN sequence % 11 > 3 THEN ask_px_00 END AS a FROM lob)
SELECT instrument_id, trade_date, sequence, last_value(b IGNORE NULLS) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) AS bid_px_00,
last_value(a IGNORE NULLS) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) AS ask_px_00 FROM h"""
)
def lob_ffill(spark, d):
    gaps = view(spark, d).select(
        *KEY, "ts_event", F.when(F.col("sequence") % 7 > 0, F.col("bid_px_00")).alias("bid_px_00"),
        F.when(F.col("sequence") % 11 > 3, F.col("ask_px_00")).alias("ask_px_00"),
    )
    return orderflow.fill_book(gaps).select(*KEY, "bid_px_00", "ask_px_00")


@register(f"""{LOB} SELECT instrument_id, trade_date, sequence FROM lob
WHERE CAST(timezone('America/New_York', timezone('UTC', ts_event)) AS TIME) BETWEEN TIME '09:30:00' AND TIME '15:30:00'""")
def session_regular_hours(spark, d):
    return orderflow.regular_hours(view(spark, d)).select(*KEY)


@register(f"{LOB} SELECT instrument_id, trade_date, sequence FROM lob WHERE CAST(ts_event AS TIME) BETWEEN TIME '14:30:00' AND TIME '20:30:00'")
def session_fixed_offset(spark, d):
    return orderflow.fixed_offset_hours(view(spark, d)).select(*KEY)


@register(
    f"""{LOB}, h AS (SELECT *, CASE WHEN sequence % 5 > 1 THEN price END AS v FROM lob)
SELECT instrument_id, trade_date, sequence, coalesce(last_value(v IGNORE NULLS) OVER ({ROWS} ROWS UNBOUNDED PRECEDING), 0e0) AS v FROM h"""
)
def repaired_series(spark, d):
    v = F.when(F.col("sequence") % 5 == 0, F.lit(float("nan"))).when(F.col("sequence") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("price"))
    return orderflow.repair(view(spark, d).withColumn("v", v), "v").select(*KEY, "v")


@register(
    """SELECT DISTINCT regexp_extract(n, '^(?:[^_]*_){4}([^-]*)-(.*)_([^_]*)$', 1) AS predicted,
regexp_extract(n, '^(?:[^_]*_){4}([^-]*)-(.*)_([^_]*)$', 2) AS predictor, regexp_extract(n, '^(?:[^_]*_){4}([^-]*)-(.*)_([^_]*)$', 3) AS period
FROM (SELECT 'SEQ_DISTR_S' || CAST(user_id AS VARCHAR) || '_bivariate_log_mid-' || event_type || '_n_' || strftime(ts, '%Y%m') AS n FROM events)"""
)
def parsed_names(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.concat(F.lit("SEQ_DISTR_S"), F.col("user_id").cast("string"), F.lit("_bivariate_log_mid-"), "event_type", F.lit("_n_"), F.date_format("ts", "yyyyMM"))
    return e.select(*lob.parse_name(name)).distinct()


# --- event features -----------------------------------------------------------------------------------------------

_EV = ["mid_price", "log_mid", "log_mid_ret", "mid_changed", "mid_change_count_n", "move_rate_per_event", "dt_block_sec", "log_dt_block", "event_intensity", "log_event_intensity", "move_rate_per_sec", "sigma_W"]


@register(
    f"""{MID} SELECT instrument_id, trade_date, sequence, round(mid_price, 9) AS mid_price, round(log_mid, 9) AS log_mid, round(log_mid_ret, 9) AS log_mid_ret, mid_changed,
round(CAST(mid_change_count_n AS DOUBLE), 9) AS mid_change_count_n, round(mid_change_count_n / {N}e0, 9) AS move_rate_per_event, round(dt_block_sec, 9) AS dt_block_sec, round(ln(dt_block_sec), 9) AS log_dt_block,
round({N} / dt_block_sec, 9) AS event_intensity, round(ln({N} / dt_block_sec), 9) AS log_event_intensity, round(mid_change_count_n / dt_block_sec, 9) AS move_rate_per_sec, round(sigma_W, 9) AS sigma_W FROM ev"""
)
def event_features(spark, d):
    return out(event(spark, d), KEY, *_EV)


@register(
    f"""{LOB}, f AS (SELECT *, coalesce({flow_sql(0)}, 0e0) AS ofi_L1 FROM lob),
f2 AS (SELECT *, {trailing('ofi_L1', N)} AS ofi_L1_n, avg(bid_sz_00 + ask_sz_00) OVER ({ROWS} ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW) AS depth FROM f)
SELECT instrument_id, trade_date, sequence, round(ofi_L1, 9) AS ofi_L1, round(ofi_L1_n, 9) AS ofi_L1_n, round(coalesce(ofi_L1_n / nullif(depth, 0), 0), 9) AS ofi_L1_n_norm FROM f2"""
)
def ofi_l1(spark, d):
    return out(orderflow.flow_imbalance(view(spark, d), N), KEY, "ofi_L1", "ofi_L1_n", "ofi_L1_n_norm")


@register(
    f"""{LOB}, f AS (SELECT *, {flow_sql(3)} AS o FROM lob)
SELECT instrument_id, trade_date, sequence, round(coalesce(o, 0e0), 9) AS ofi_3, round({trailing('o', N)}, 9) AS ofi_3_n FROM f"""
)
def ofi_level(spark, d):
    return out(orderflow.flow_level(view(spark, d), 3, N), KEY, "ofi_3", "ofi_3_n")


def _levels_sql(levels: int, kind: str) -> str:
    terms = [f"{w!r}e0 * coalesce({flow_sql(k)}, 0e0)" for k, w in enumerate(orderflow.level_weights(levels, kind))]
    return " + ".join(terms)


_KINDS = {"u": ("uniform", 10), "i": ("inverse", 5), "x": ("exponential", 3)}


@register(
    f"{LOB}, f AS (SELECT *, "
    + ", ".join(f"{_levels_sql(n, kind)} AS {k}" for k, (kind, n) in _KINDS.items())
    + f""" FROM lob) SELECT instrument_id, trade_date, sequence, {', '.join(f'round({k}, 6) + 0e0 AS {k}, round({trailing(k, N, N)}, 6) + 0e0 AS {k}_n' for k in _KINDS)} FROM f"""
)
def ofi_multilevel(spark, d):
    df = view(spark, d)
    for k, (kind, n) in _KINDS.items():
        df = orderflow.flow_levels(df, n, N, kind).withColumnRenamed(f"ofi_L{n}", k).withColumnRenamed(f"ofi_L{n}_n", f"{k}_n")
    return out(df, KEY, *_KINDS, *(f"{k}_n" for k in _KINDS), digits=6)


@register(
    f"{LOB}, f AS (SELECT *, {_levels_sql(3, 'uniform')} AS o, greatest("
    + " + ".join(f"{w!r}e0 * (bid_sz_{k:02d} + ask_sz_{k:02d})" for k, w in enumerate(orderflow.level_weights(3)))
    + f""", 1e-12) AS dep FROM lob) SELECT instrument_id, trade_date, sequence, round(o / dep, 11) + 0e0 AS ofi_L3_norm,
round(({trailing('o', N)}) / greatest({trailing('dep', N)}, 1e-12), 11) + 0e0 AS ofi_L3_norm_n FROM f"""
)
def ofi_normalized(spark, d):
    return out(orderflow.flow_levels_normalised(view(spark, d), 3, N), KEY, "ofi_L3_norm", "ofi_L3_norm_n", digits=11)


@register(f"{SIGN} SELECT instrument_id, trade_date, sequence, is_trade, aggressor, trade_buy_vol_event, trade_sell_vol_event FROM tr")
def trade_sign(spark, d):
    return signed(spark, d).select(*KEY, "is_trade", "aggressor", "trade_buy_vol_event", "trade_sell_vol_event")


@register(
    f"""{SIGN}, v AS (SELECT *, {trailing('trade_buy_vol_event', N, N)} AS b, {trailing('trade_sell_vol_event', N, N)} AS s FROM tr)
SELECT instrument_id, trade_date, sequence, b AS trade_buy_vol_n, s AS trade_sell_vol_n, round(coalesce((b - s) / nullif(b + s, 0), 0), 9) AS tvi_n FROM v"""
)
def trade_imbalance(spark, d):
    return out(orderflow.trade_imbalance(signed(spark, d), N), KEY, "trade_buy_vol_n", "trade_sell_vol_n", "tvi_n")


@register(
    f"""{SIGN}, c AS (SELECT *, CASE WHEN is_trade THEN CAST(floor(sum(CASE WHEN is_trade THEN size ELSE 0 END) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) / 1000e0) AS BIGINT) END AS bucket FROM tr),
k AS (SELECT instrument_id, trade_date, bucket, abs(sum(trade_buy_vol_event) - sum(trade_sell_vol_event)) / 1000e0 AS imb FROM c WHERE bucket IS NOT NULL GROUP BY ALL),
v AS (SELECT instrument_id, trade_date, bucket, CASE WHEN count(*) OVER q >= 3 THEN avg(imb) OVER q END AS vp FROM k
  WINDOW q AS ({PART} ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
j AS (SELECT c.*, v.vp FROM c LEFT JOIN v USING (instrument_id, trade_date, bucket)),
f AS (SELECT *, coalesce(last_value(vp IGNORE NULLS) OVER ({ROWS} ROWS UNBOUNDED PRECEDING), first_value(vp IGNORE NULLS) OVER ({ROWS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vpin FROM j),
dd AS (SELECT *, vpin - lag(vpin) OVER ({ROWS}) AS ch FROM f)
SELECT instrument_id, trade_date, sequence, round(vpin, 9) AS vpin, round(first_value(ch IGNORE NULLS) OVER ({ROWS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) + 0e0 AS dvpin FROM dd"""
)
def vpin(spark, d):
    return out(orderflow.vpin(signed(spark, d), 1000, 3), KEY, "vpin", "dvpin")


_QUOTE = ["spread", "vol_weight", "vol", "vol_imb", "vol_imb_returns", "vol_imb_innovation", "mid_price_returns", "mid_price_innovation", "log_mid_price_innovation", "mid_price_sqr_returns", "mid_price_sqr_returns_innovation"]


@register(
    f"""{LOB}, q0 AS (SELECT *, (bid_px_00 + ask_px_00) / 2 AS m, (bid_sz_00 - ask_sz_00) / (bid_sz_00 + ask_sz_00) AS vi, CAST(floor(epoch_us(ts_event) / 1000000) AS BIGINT) AS s FROM lob),
q1 AS (SELECT *, m - lag(m) OVER ({ROWS}) AS r, lag(m) OVER ({ROWS}) AS pm, lag(vi) OVER ({ROWS}) AS pv, s - first_value(s) OVER ({ROWS}) AS secs, ln(m) - lag(ln(m)) OVER ({ROWS}) AS lr FROM q0)
SELECT instrument_id, trade_date, sequence, secs, CASE WHEN r > 1e-7 THEN 1 WHEN r < -1e-7 THEN -1 ELSE 0 END AS mid_price_movement, round((bid_px_00 - ask_px_00) / (bid_px_00 + ask_px_00), 9) AS spread,
round(ask_sz_00 * ask_px_00 + bid_sz_00 * bid_px_00, 6) AS vol_weight, bid_sz_00 + ask_sz_00 AS vol, round(vi, 9) AS vol_imb, round(vi - pv, 9) + 0e0 AS vol_imb_returns,
round(CASE WHEN pv = 0 THEN CASE WHEN vi = 0 THEN 0e0 ELSE 1e0 END ELSE (vi - pv) / pv END, 9) + 0e0 AS vol_imb_innovation, round(r, 9) + 0e0 AS mid_price_returns, round(r / pm, 9) + 0e0 AS mid_price_innovation,
round(lr, 9) + 0e0 AS log_mid_price_innovation, round(r * r, 9) AS mid_price_sqr_returns, round(r * r - lag(r * r) OVER ({ROWS}), 9) + 0e0 AS mid_price_sqr_returns_innovation FROM q1"""
)
def quote_features(spark, d):
    df = out(orderflow.quote_features(view(spark, d)), KEY, "secs", "mid_price_movement", *_QUOTE)
    return df.withColumn("vol_weight", F.round("vol_weight", 6))


@register(
    f"""{LOB}, u AS (SELECT *, row_number() OVER ({ROWS}) AS rn, CAST((sequence * 7) % 3 AS INT) AS sym FROM lob), u5 AS (SELECT * FROM u WHERE rn > 5)
SELECT instrument_id, trade_date, sym AS seq, count(*) AS cnt FROM u5 GROUP BY ALL"""
)
def univariate_counts(spark, d):
    """Counts of one feature's symbols after the first five rows of each series."""
    df = view(spark, d).select(*KEY, "ts_event", F.pmod(F.col("sequence") * 7, F.lit(3)).cast("int").alias("sym"))
    df = df.withColumn("_at", F.row_number().over(DAY.rows())).where("_at > 5")
    return ngrams.counts(df, "sym", 1, DAY).select("instrument_id", "trade_date", F.get("seq", F.lit(0)).alias("seq"), "cnt")


# --- bars ---------------------------------------------------------------------------------------------------------


@register(f"{BARS_SQL} SELECT instrument_id, trade_date, sample_idx, sequence, event_idx, round(log_mid, 9) AS log_mid FROM b")
def event_bars(spark, d):
    return out(bar(spark, d), BAR, "sequence", "event_idx", "log_mid")


def _time_sql(fill: bool) -> str:
    state = ["bid_px_00", "ask_sz_00", "mid_price", "log_mid", "sigma_W"]
    sql = f"""{MID}, t AS (SELECT *, time_bucket(INTERVAL 120 SECONDS, ts_event) AS bucket_start FROM ev),
t1 AS (SELECT *, CAST(lag(mid_price) OVER (PARTITION BY instrument_id, trade_date, bucket_start ORDER BY ts_event, sequence) <> mid_price AS INT) AS moved,
  log_mid - lag(log_mid) OVER (PARTITION BY instrument_id, trade_date, bucket_start ORDER BY ts_event, sequence) AS r FROM t),
g AS (SELECT instrument_id, trade_date, bucket_start, {', '.join(f'arg_max({c}, (ts_event, sequence)) FILTER ({c} IS NOT NULL) AS {c}' for c in state)}, count(*) AS event_count,
  (max(epoch_us(ts_event)) - min(epoch_us(ts_event))) / 1e6 AS dt_span_sec, coalesce(sum(moved), 0) AS mid_change_count, sqrt(avg(r * r)) AS sigma_bucket FROM t1 GROUP BY ALL)"""
    if fill:
        by = f"{PART} ORDER BY bucket_start"
        sql += f""", grid AS (SELECT instrument_id, trade_date, unnest(s) AS bucket_start FROM (SELECT instrument_id, trade_date, generate_series(min(bucket_start), max(bucket_start), INTERVAL 120 SECONDS) AS s FROM g GROUP BY ALL)),
gg AS (SELECT instrument_id, trade_date, bucket_start, {', '.join(f'last_value({c} IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING) AS {c}' for c in state)},
  coalesce(event_count, 0) AS event_count, coalesce(dt_span_sec, 0) AS dt_span_sec, coalesce(mid_change_count, 0) AS mid_change_count, sigma_bucket
  FROM grid LEFT JOIN g USING (instrument_id, trade_date, bucket_start))"""
    else:
        sql += ", gg AS (SELECT * FROM g)"
    return (
        sql
        + f""" SELECT instrument_id, trade_date, row_number() OVER ({PART} ORDER BY bucket_start) - 1 AS sample_idx, {', '.join(f'round({c}, 9) AS {c}' for c in state)}, event_count, round(dt_span_sec, 9) AS dt_span_sec,
CAST(mid_change_count AS BIGINT) AS mid_change_count, round(sigma_bucket, 9) AS sigma_bucket, round(event_count / 120e0, 9) AS event_intensity, round(ln(greatest(event_count / 120e0, 1e-12)), 9) AS log_event_intensity,
round(mid_change_count / nullif(event_count, 0), 9) AS move_rate_per_event, round(mid_change_count / 120e0, 9) AS move_rate_per_sec FROM gg"""
    )


_TIME = ["bid_px_00", "ask_sz_00", "mid_price", "log_mid", "sigma_W", "event_count", "dt_span_sec", "mid_change_count", "sigma_bucket", "event_intensity", "log_event_intensity", "move_rate_per_event", "move_rate_per_sec"]


@register(_time_sql(False))
def time_bars(spark, d):
    return out(bars.time_bars(event(spark, d), 120, fill=False), BAR, *_TIME)


@register(_time_sql(True))
def time_bars_gapfill(spark, d):
    return out(bars.time_bars(event(spark, d), 120), BAR, *_TIME)


@register(
    f"""{SIGN}, mc AS (SELECT *, coalesce(CAST(mid <> lag(mid) OVER ({ROWS}) AS INT), 0) AS mid_changed FROM tr),
c AS (SELECT *, sum(trade_buy_vol_event + trade_sell_vol_event) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) AS cum, sum(mid_changed) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) AS mv,
  row_number() OVER ({ROWS}) AS n FROM mc),
x AS (SELECT *, unnest(generate_series(CAST(floor((cum - trade_buy_vol_event - trade_sell_vol_event) / 300e0) AS BIGINT) + 1, CAST(floor(cum / 300e0) AS BIGINT))) AS j FROM c),
y AS (SELECT *, j - 1 AS sample_idx, cum - coalesce(lag(cum) OVER (PARTITION BY instrument_id, trade_date ORDER BY j), 0) AS vol,
  n - coalesce(lag(n) OVER (PARTITION BY instrument_id, trade_date ORDER BY j), 0) AS ev, mv - coalesce(lag(mv) OVER (PARTITION BY instrument_id, trade_date ORDER BY j), 0) AS moves FROM x)
SELECT instrument_id, trade_date, sample_idx, sequence, j * 300e0 AS volume_threshold, cum AS cum_trade_vol, vol AS bucket_trade_vol, ev AS events_in_bucket,
CAST(moves AS BIGINT) AS mid_change_count_vol_bucket, round(moves / nullif(vol, 0), 9) AS move_rate_per_share, round(moves / nullif(ev, 0), 9) AS move_rate_per_event_in_vol_bucket FROM y"""
)
def volume_bars(spark, d):
    df = orderflow.trade_signs(event(spark, d))
    return out(bars.volume_bars(df, 300), BAR, "sequence", "volume_threshold", "cum_trade_vol", "bucket_trade_vol", "events_in_bucket", "mid_change_count_vol_bucket", "move_rate_per_share", "move_rate_per_event_in_vol_bucket")


_K = (1, 2, 4)


def _targets_sql() -> str:
    cols = []
    for k in _K:
        back = trailing("log_mid", k, k, NEXT)
        ahead = f"OVER ({NEXT} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
        cols += [
            f"lead(log_mid, {k}) OVER ({NEXT}) - log_mid AS log_mid_return_fwd_{k}",
            f"{back} AS log_mid_sum_bwd_{k}",
            f"CASE WHEN count(log_mid) {ahead} >= {k} THEN sum(log_mid) {ahead} END AS log_mid_sum_fwd_{k}",
        ]
    return f"{BARS_SQL}, tg AS (SELECT *, {', '.join(cols)} FROM b)"


@register(
    _targets_sql()
    + " SELECT instrument_id, trade_date, sample_idx, "
    + ", ".join(
        f"round(log_mid_return_fwd_{k}, 9) + 0e0 AS log_mid_return_fwd_{k}, round(log_mid_sum_bwd_{k}, 9) AS log_mid_sum_bwd_{k}, round(log_mid_sum_fwd_{k}, 9) AS log_mid_sum_fwd_{k}, "
        f"round(CASE WHEN abs(log_mid_sum_bwd_{k}) >= 1e-12 THEN (log_mid_sum_fwd_{k} - log_mid_sum_bwd_{k}) / log_mid_sum_bwd_{k} END, 9) + 0e0 AS log_mid_sum_ratio_{k}"
        for k in _K
    )
    + " FROM tg"
)
def fwd_bwd_targets(spark, d):
    names = [f"log_mid_{w}_{k}" for k in _K for w in ("return_fwd", "sum_bwd", "sum_fwd", "sum_ratio")]
    return out(bars.targets(bar(spark, d), _K), BAR, *names)


@register(
    f"""{BARS_SQL}, r AS (SELECT *, bid_sz_00 / nullif(bid_sz_00 + ask_sz_00, 0) AS q FROM b)
SELECT instrument_id, trade_date, sample_idx, round(q, 9) AS bid_ratio_L1, round(q * ask_px_00 + (1 - q) * bid_px_00, 9) AS micro_price,
round(coalesce((bid_sz_00 - ask_sz_00) / nullif(bid_sz_00 + ask_sz_00, 0), 0), 9) AS imbalance, round(ask_px_00 - bid_px_00, 9) AS spread, round((ask_px_00 - bid_px_00) / mid_price, 9) AS rel_spread,
round(ln(ask_px_00) - ln(bid_px_00), 9) AS log_spread, round(q * ask_px_00 + (1 - q) * bid_px_00 - mid_price, 9) AS micro_mid FROM r"""
)
def micro_price_spread(spark, d):
    return out(bars.book_features(bar(spark, d)), BAR, "bid_ratio_L1", "micro_price", "imbalance", "spread", "rel_spread", "log_spread", "micro_mid")


@register(
    f"{BARS_SQL} SELECT instrument_id, trade_date, sample_idx, round(bid_sz_00 / nullif(bid_sz_00 + ask_sz_00, 0), 9) AS imbalance, round((bid_sz_00 - ask_sz_00) / nullif(bid_sz_00 + ask_sz_00, 0), 9) + 0e0 AS obi_l1 FROM b"
)
def bid_share(spark, d):
    r = bars.book_features(bar(spark, d), share_of_bid=True).withColumn("obi_l1", F.round("obi_L1", 9) + F.lit(0.0))
    return out(r, BAR, "imbalance", "obi_l1")


@register(
    f"""{BARS_SQL} SELECT instrument_id, trade_date, sample_idx, coalesce(CAST(mid_price > lag(ask_px_00) OVER ({NEXT}) AS INT), 0) AS mid_cross_prev_ask_up,
coalesce(CAST(mid_price < lag(bid_px_00) OVER ({NEXT}) AS INT), 0) AS mid_cross_prev_bid_dn, round(mid_price - lag(mid_price) OVER ({NEXT}), 9) + 0e0 AS mid_ret,
coalesce(CAST(abs(mid_price - lag(mid_price) OVER ({NEXT})) > lag(ask_px_00 - bid_px_00) OVER ({NEXT}) AS INT), 0) AS jump_gt_prev_spread FROM b"""
)
def cross_flags(spark, d):
    return out(bars.book_features(bar(spark, d)), BAR, "mid_cross_prev_ask_up", "mid_cross_prev_bid_dn", "mid_ret", "jump_gt_prev_spread")


@register(
    f"""{MID}, b AS (SELECT instrument_id, trade_date, time_bucket(INTERVAL 300 SECONDS, ts_event) AS bucket_start, arg_max(mid_price, (ts_event, sequence)) AS v FROM ev GROUP BY ALL),
g AS (SELECT instrument_id, trade_date, unnest(s) AS bucket_start FROM (SELECT instrument_id, trade_date, generate_series(min(bucket_start), max(bucket_start), INTERVAL 300 SECONDS) AS s FROM b GROUP BY ALL))
SELECT instrument_id, trade_date, CAST(epoch_us(bucket_start) AS BIGINT) AS start_us, round(last_value(v IGNORE NULLS) OVER ({PART} ORDER BY bucket_start ROWS UNBOUNDED PRECEDING), 9) AS mid_price
FROM g LEFT JOIN b USING (instrument_id, trade_date, bucket_start)"""
)
def resampled(spark, d):
    r = bars.resample(event(spark, d), "mid_price", 300)
    return out(r.withColumn("start_us", F.unix_micros("bucket_start")), ["instrument_id", "trade_date", "start_us"], "mid_price")


@register(
    f"""{LOB}, b AS (SELECT *, CAST(sequence // 40 AS BIGINT) AS bucket FROM lob) SELECT instrument_id, trade_date, bucket, round(arg_max(price, (ts_event, sequence)), 9) AS last, round(avg(price), 9) AS mean,
round(sum(price * size) / sum(size), 9) AS weighted, round((arg_min(price, (ts_event, sequence)) + arg_max(price, (ts_event, sequence))) / 2, 9) AS first_last FROM b GROUP BY ALL"""
)
def bucket_reducers(spark, d):
    r = bars.bucket_summaries(view(spark, d), "price", "size", F.floor(F.col("sequence") / 40))
    return out(r, ["instrument_id", "trade_date", "bucket"], "last", "mean", "weighted", "first_last")


@register(
    f"""{LOB}, b AS (SELECT instrument_id, trade_date, CAST(sequence // 3 AS BIGINT) AS bucket, list(size ORDER BY ts_event, sequence) AS v FROM lob GROUP BY ALL),
g AS (SELECT instrument_id, trade_date, unnest(s) AS bucket FROM (SELECT instrument_id, trade_date, generate_series(min(bucket), max(bucket)) AS s FROM b GROUP BY ALL))
SELECT instrument_id, trade_date, bucket, coalesce(array_to_string(v, ','), '') AS sizes, CAST(coalesce(len(v), 0) AS INT) AS n FROM g LEFT JOIN b USING (instrument_id, trade_date, bucket)"""
)
def bucket_values(spark, d):
    r = bars.bucket_lists(view(spark, d), "size", F.floor(F.col("sequence") / 3))
    return r.select("instrument_id", "trade_date", "bucket", F.array_join(F.col("values").cast("array<string>"), ",").alias("sizes"), F.size("values").alias("n"))


# --- encoding -----------------------------------------------------------------------------------------------------

_SRC = f"{BARS_SQL}, src AS (SELECT *, log_mid AS x FROM b), {_EWMA}"


@register(
    f"""{BARS_SQL}, s AS (SELECT *, row_number() OVER ({NEXT}) - 1 AS i FROM b),
a AS (SELECT *, pow({1 - ALPHA}e0, i) * sum((CASE WHEN i = 0 THEN 1e0 ELSE {ALPHA}e0 END) * log_mid * pow({1 - ALPHA}e0, -i)) OVER ({NEXT} ROWS UNBOUNDED PRECEDING) AS mu FROM s),
v AS (SELECT *, pow({1 - ALPHA}e0, i) * sum((CASE WHEN i = 0 THEN 1e0 ELSE {ALPHA}e0 END) * (log_mid - mu) * (log_mid - mu) * pow({1 - ALPHA}e0, -i)) OVER ({NEXT} ROWS UNBOUNDED PRECEDING) AS va FROM a)
SELECT instrument_id, trade_date, sample_idx, round((log_mid - mu) / sqrt(va), 6) AS log_mid_z FROM v WHERE i > 0"""
)
def ewma_zscore(spark, d):
    z = encode.zscore(bar(spark, d).select(*BAR, "log_mid"), "log_mid", ALPHA, bars.BARS)
    return out(z.where("sample_idx > 0"), BAR, "log_mid_z", digits=6)


@register(f"{_SRC} SELECT instrument_id, trade_date, sample_idx, round(z_raw, 6) AS log_mid_z FROM z0")
def ewma_zscore_predictive(spark, d):
    return out(encode.zscore_predictive(bar(spark, d).select(*BAR, "log_mid"), "log_mid", ALPHA, order=bars.BARS), BAR, "log_mid_z", digits=6)


def _symbols(spark, d, **kw) -> DataFrame:
    return encode.encode(bar(spark, d).select(*BAR, "log_mid"), "log_mid", SYMBOLS, ALPHA, order=bars.BARS, decimals=9, **kw)


_EDGES = [f"round(quantile_cont(z, {i / SYMBOLS}) OVER ({NEXT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9)" for i in range(1, SYMBOLS)]
_GROW = f"""q AS (SELECT *, {', '.join(f'{e} AS q{i}' for i, e in enumerate(_EDGES))} FROM z),
y AS (SELECT *, CASE WHEN q0 IS NOT NULL AND z IS NOT NULL THEN CAST(z >= q0 AS INT) + CAST(z >= q1 AS INT) + CAST(z >= q2 AS INT) END AS s0 FROM q),
sy AS (SELECT *, coalesce(first_value(s0 IGNORE NULLS) OVER ({NEXT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS sym FROM y)"""


@register(f"{_SRC}, {_GROW} SELECT instrument_id, trade_date, sample_idx, sym AS log_mid_sym FROM sy")
def expanding_quantile_symbols(spark, d):
    return _symbols(spark, d, fill="bfill").select(*BAR, "log_mid_sym")


@register(
    f"""{_SRC}, e AS (SELECT instrument_id, trade_date, {', '.join(f'quantile_cont(z, {i / SYMBOLS}) AS q{i}' for i in range(1, SYMBOLS))} FROM z GROUP BY ALL)
SELECT instrument_id, trade_date, {', '.join(f'round(q{i}, 6) AS q{i}' for i in range(1, SYMBOLS))} FROM e"""
)
def quantile_bins(spark, d):
    z = _symbols(spark, d, mode="fixed_normal", fill="none")
    e = encode.quantile_edges(z, "log_mid_z", SYMBOLS, bars.BARS)
    return e.select("instrument_id", "trade_date", *(F.round(F.get("edges", F.lit(i - 1)), 6).alias(f"q{i}") for i in range(1, SYMBOLS)))


@register(
    f"""{_SRC}, e AS (SELECT *, {', '.join(f'quantile_cont(z, {i / SYMBOLS}) OVER (PARTITION BY instrument_id, trade_date) AS q{i}' for i in range(1, SYMBOLS))} FROM z)
SELECT instrument_id, trade_date, sample_idx, CASE WHEN z IS NULL THEN -1 ELSE CAST(z >= q1 AS INT) + CAST(z >= q2 AS INT) + CAST(z >= q3 AS INT) END AS log_mid_sym FROM e"""
)
def daily_quantile_symbols(spark, d):
    return _symbols(spark, d, mode="daily_quantile", fill="none").select(*BAR, "log_mid_sym")


@register(
    f"""{_SRC}, pl AS (SELECT *, row_number() OVER ({NEXT}) AS place, count(*) OVER ({PART}) AS whole FROM z),
e AS (SELECT {_BY0}, {', '.join(f'quantile_cont(z, {i / SYMBOLS}) AS q{i}' for i in range(1, SYMBOLS))} FROM pl WHERE place <= greatest(1, floor(whole * 0.5e0)) GROUP BY ALL),
y AS (SELECT pl.*, CASE WHEN z IS NOT NULL THEN CAST(z >= q1 AS INT) + CAST(z >= q2 AS INT) + CAST(z >= q3 AS INT) END AS s0 FROM pl JOIN e USING ({_BY0}))
SELECT {_BY0}, sample_idx, coalesce(s0, -1) AS log_mid_sym FROM y"""
)
def prefix_quantile_symbols(spark, d):
    return _symbols(spark, d, mode="prefix_quantile", fill="bfill_ffill").select(*BAR, "log_mid_sym")


@register(
    f"""{_SRC}, f AS (SELECT *, sample_idx <= 20 AS fit, count(*) FILTER (sample_idx <= 20) OVER ({PART}) AS many FROM z),
e AS (SELECT {_BY0}, {', '.join(f'quantile_cont(z, {i / SYMBOLS}) AS q{i}' for i in range(1, SYMBOLS))} FROM f WHERE fit AND many >= {SYMBOLS} GROUP BY ALL)
SELECT {_BY0}, sample_idx, CASE WHEN z IS NULL OR q1 IS NULL THEN -1 ELSE CAST(z >= q1 AS INT) + CAST(z >= q2 AS INT) + CAST(z >= q3 AS INT) END AS log_mid_sym FROM f LEFT JOIN e USING ({_BY0})"""
)
def history_quantile_symbols(spark, d):
    return _symbols(spark, d, mode="history_quantile", fit_until=20, time="sample_idx", fill="none").select(*BAR, "log_mid_sym")


def _fixed_sql(edges: list[float]) -> str:
    return f"{_SRC} SELECT instrument_id, trade_date, sample_idx, CASE WHEN z IS NULL THEN -1 ELSE {' + '.join(f'CAST(z >= {e!r}e0 AS INT)' for e in edges)} END AS log_mid_sym FROM z"


@register(_fixed_sql([-1.5, 0.0, 1.5]))
def fixed_uniform_symbols(spark, d):
    return _symbols(spark, d, mode="fixed_uniform", fill="none").select(*BAR, "log_mid_sym")


@register(_fixed_sql([-0.6744897501960817, 0.0, 0.6744897501960817]))
def fixed_normal_symbols(spark, d):
    return _symbols(spark, d, mode="fixed_normal", fill="none").select(*BAR, "log_mid_sym")


def _moments_sql(alpha: float) -> str:
    """The exponential mean and debiased deviation of log_mid: weights w of the values so far, adjust=False."""
    q = f"{1 - alpha}e0"
    weight = f"(CASE WHEN i = 0 THEN 1e0 ELSE {alpha}e0 END) * pow({q}, -i)"
    so_far = f"OVER ({NEXT} ROWS UNBOUNDED PRECEDING)"
    return f"""{BARS_SQL}, s AS (SELECT *, row_number() OVER ({NEXT}) - 1 AS i, first_value(log_mid) OVER ({NEXT}) AS x0 FROM b),
w AS (SELECT *, log_mid - x0 AS x, {weight} AS wt FROM s),
e AS (SELECT *, pow({q}, i) * sum(wt * x) {so_far} AS mx, pow({q}, i) * sum(wt * x * x) {so_far} AS mxx, pow({q}, 2 * i) * sum(wt * wt) {so_far} AS w2 FROM w),
mo AS (SELECT *, x0 + mx AS mean, CASE WHEN i > 0 THEN sqrt(greatest((mxx - mx * mx) / (1 - w2), 0e0)) END AS sd FROM e)"""


@register(
    f"""{_moments_sql(0.25)} SELECT instrument_id, trade_date, sample_idx, CASE WHEN d < -s THEN 0 WHEN d < 0 THEN 1 WHEN d < s THEN 2 ELSE 3 END AS log_mid_sym FROM (SELECT *, round(log_mid - mean, 12) AS d, round(coalesce(sd, 0), 12) AS s FROM mo)"""
)
def band_symbols(spark, d):
    df = encode.band_symbols(bar(spark, d).select(*BAR, "log_mid"), "log_mid", order=bars.BARS, decimals=12)
    return df.select(*BAR, "log_mid_sym")


@register(
    f"""{_moments_sql(0.25)} SELECT instrument_id, trade_date, sample_idx, CASE WHEN s IS NULL THEN 0 WHEN d <= -s THEN -2 WHEN d <= -round(0.01e0 * s, 12) THEN -1
WHEN d <= round(0.01e0 * s, 12) THEN 0 WHEN d <= s THEN 1 ELSE 2 END AS log_mid_sym FROM (SELECT *, round(log_mid - mean, 12) AS d, round(sd, 12) AS s FROM mo)"""
)
def five_symbols(spark, d):
    df = encode.five_symbols(bar(spark, d).select(*BAR, "log_mid"), "log_mid", order=bars.BARS, decimals=12)
    return df.select(*BAR, "log_mid_sym")


@register(
    f"""{_moments_sql(0.05)}, zz AS (SELECT *, CASE WHEN i >= 9 AND sd > 0 THEN (log_mid - mean) / sd END AS zg FROM mo)
SELECT instrument_id, trade_date, sample_idx, CASE WHEN zg IS NULL THEN -1 ELSE CAST(zg >= -0.6744897501960817e0 AS INT) + CAST(zg >= 0e0 AS INT) + CAST(zg >= 0.6744897501960817e0 AS INT) END AS log_mid_sym FROM zz"""
)
def gaussian_symbols(spark, d):
    return encode.gaussian_symbols(bar(spark, d).select(*BAR, "log_mid"), "log_mid", min_periods=10, order=bars.BARS).select(*BAR, "log_mid_sym")


@register(
    f"""{MID} SELECT instrument_id, trade_date, sequence, CASE WHEN log_mid_ret > 1e-6 THEN 1 WHEN log_mid_ret < -1e-6 THEN -1 ELSE 0 END AS three,
CASE WHEN log_mid_ret <= 0 THEN -1 ELSE 1 END AS two, CASE WHEN log_mid_ret <= 0 THEN 0 ELSE 1 END AS zero_one FROM ev"""
)
def discretised(spark, d):
    r = "log_mid_ret"
    return event(spark, d).select(*KEY, encode.sign_of(r).alias("three"), encode.two_signs(r).alias("two"), encode.zero_one(r).alias("zero_one"))


# Static bins of two features give pairs whose SQL twin stays short; the growing bins have their own query above.
_PAIR = f"""{BARS_SQL}, pr AS (SELECT *, (bid_sz_00 - ask_sz_00) / (bid_sz_00 + ask_sz_00) AS imbalance, log_mid - lag(log_mid) OVER ({NEXT}) AS ret FROM b),
bs AS (SELECT *, CASE WHEN ret IS NULL THEN 1 ELSE CAST(ret >= -2e-4 AS INT) + CAST(ret >= 0e0 AS INT) + CAST(ret >= 2e-4 AS INT) END
 + 4 * (CAST(imbalance >= -0.5e0 AS INT) + CAST(imbalance >= 0e0 AS INT) + CAST(imbalance >= 0.5e0 AS INT)) AS sym FROM pr)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    df = bars.book_features(bar(spark, d))
    ret = encode.symbol("log_mid_ret", [-2e-4, 0.0, 2e-4], missing=1)
    return df.withColumn("sym", encode.combine(ret, encode.symbol("imbalance", [-0.5, 0.0, 0.5]), SYMBOLS))


@register(f"{_PAIR} SELECT instrument_id, trade_date, sample_idx, sym FROM bs")
def bivariate_symbols(spark, d):
    return pairs(spark, d).select(*BAR, "sym")


# --- labels -------------------------------------------------------------------------------------------------------

_RET = f"{_PAIR}, lb AS (SELECT *, lead(log_mid, 1) OVER ({NEXT}) - log_mid AS f1, lead(log_mid, 4) OVER ({NEXT}) - log_mid AS f4 FROM bs)"
_C = "CASE WHEN {0} > {1} THEN 1 WHEN {0} < -{1} THEN -1 ELSE 0 END"


@register(f"{_RET} SELECT instrument_id, trade_date, sample_idx, {_C.format('f1', '4.15e-5')} AS c1, {_C.format('f4', '7.5e-5')} AS c4 FROM lb")
def class_label_c(spark, d):
    df = bars.targets(bar(spark, d), (1, 4))
    return labels.class_label(labels.class_label(df, "c1", out="c1"), "c4", out="c4").select(*BAR, "c1", "c4")


_FILLED = "last_value({0} IGNORE NULLS) OVER (" + NEXT + " ROWS UNBOUNDED PRECEDING)"


@register(
    f"{_RET} SELECT instrument_id, trade_date, sample_idx, {_C.format('g1', '4.15e-5')} AS c1, {_C.format('g4', '7.5e-5')} AS c4 FROM (SELECT *, {_FILLED.format('f1')} AS g1, {_FILLED.format('f4')} AS g4 FROM lb)"
)
def class_label_filled(spark, d):
    df = bars.targets(bar(spark, d), (1, 4))
    return labels.class_label(labels.class_label(df, "c1", True, out="c1"), "c4", True, out="c4").select(*BAR, "c1", "c4")


@register(
    _targets_sql()
    + """ SELECT instrument_id, trade_date, sample_idx, CASE WHEN log_mid_sum_fwd_2 > log_mid_sum_bwd_2 * (1 + 7e-6 * 1.5e0) THEN 1
WHEN log_mid_sum_fwd_2 < log_mid_sum_bwd_2 * (1 - 7e-6 * 1.5e0) THEN -1 ELSE 0 END AS ca2 FROM tg"""
)
def class_label_ca(spark, d):
    return labels.class_label(bars.targets(bar(spark, d), _K), "ca2", out="ca2").select(*BAR, "ca2")


@register(
    f"""{BARS_SQL} SELECT instrument_id, trade_date, sample_idx, round(avg(log_mid) OVER ({NEXT} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 9) AS ahead,
CASE WHEN lead(log_mid_ret) OVER ({NEXT}) <= 0 THEN 0 ELSE 1 END AS next_sign, CASE WHEN round(avg(log_mid) OVER ({NEXT} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 9) > round(log_mid, 9) THEN 1 ELSE 0 END AS rises,
CASE WHEN round(avg(log_mid) OVER ({NEXT} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) > round(avg(log_mid) OVER ({NEXT} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 9) THEN 1 ELSE 0 END AS falls FROM b"""
)
def prefix_suffix_classes(spark, d):
    df = bar(spark, d)
    ahead, before = F.round(labels.suffix_mean("log_mid", 3), 9), F.round(F.avg("log_mid").over(bars.BARS.rows().rowsBetween(-2, 0)), 9)
    return df.select(
        *BAR, ahead.alias("ahead"), labels.next_sign("log_mid_ret").alias("next_sign"),
        F.when(ahead > F.round("log_mid", 9), 1).otherwise(0).alias("rises"), F.when(before > ahead, 1).otherwise(0).alias("falls"),
    )


@register(
    f"""{BARS_SQL}, r AS (SELECT *, CAST(round(log_mid * 1e6) AS BIGINT) AS x FROM b),
a AS (SELECT *, sum(x) OVER f AS sf, count(x) OVER f AS nf, sum(x) OVER p AS sp, count(x) OVER p AS np FROM r
  WINDOW f AS ({NEXT} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), p AS ({NEXT} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT instrument_id, trade_date, sample_idx, CASE WHEN sf > x * nf THEN 1 ELSE 0 END AS rises, CASE WHEN sp * nf > sf * np THEN 1 ELSE 0 END AS falls FROM a"""
)
def suffix_mean_classes(spark, d):
    """The classes by their own functions, of all rows; values in whole millionths, so that equal means are ties on both sides."""
    df = bar(spark, d).withColumn("x", F.round(F.col("log_mid") * 1e6).cast("long"))
    return df.withColumns({"rises": labels.rises("x", 3), "falls": labels.falls_on_average("x", 3, 3)}).select(*BAR, "rises", "falls")


@register(
    f"""{BARS_SQL}, w AS (SELECT {_BY0}, sample_idx, list(sequence) OVER ({NEXT} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p, list(sequence) OVER ({NEXT} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS s FROM b)
SELECT {_BY0}, sample_idx, array_to_string(p, ',') AS prefix, array_to_string(s, ',') AS suffix FROM w WHERE len(p) = 3 AND len(s) = 2"""
)
def prefix_suffix_windows(spark, d):
    df = labels.windows(bar(spark, d), "sequence", 3, 2)
    return df.select(*BAR, *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("prefix", "suffix")))


# --- sequences ----------------------------------------------------------------------------------------------------

LONGEST = 3
_BY = "instrument_id, trade_date"


def _grams_sql(longest: int, extra: str = "") -> str:
    parts = []
    for n in range(1, longest + 1):
        seq = " || ',' || ".join(f"CAST(lag(sym, {k}) OVER ({NEXT}) AS VARCHAR)" for k in reversed(range(n)))
        parts.append(f"SELECT {_BY}, {n} AS length, {seq} AS seq, row_number() OVER ({NEXT}) AS place{extra} FROM lb")
    return f"{_RET}, gr AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE place >= length)"


def _seq(df: DataFrame, *columns, by=("instrument_id", "trade_date")) -> DataFrame:
    return df.select(*by, "length", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"), *columns)


def _counted(spark, d) -> DataFrame:
    return ngrams.counts(pairs(spark, d), "sym", LONGEST)


_CNT = f"{_grams_sql(LONGEST)}, ct AS (SELECT {_BY}, length, seq, count(*) AS cnt FROM gr GROUP BY ALL)"
_SHARE = "sum(cnt) OVER (PARTITION BY {0} length)"


@register(f"{_CNT} SELECT {_BY}, length, seq, cnt, CAST({_SHARE.format(_BY + ',')} AS BIGINT) AS total, round(cnt / {_SHARE.format(_BY + ',')}, 9) AS prob FROM ct")
def ngram_counts(spark, d):
    return _seq(_counted(spark, d), "cnt", "total", F.round("prob", 9).alias("prob"))


@register(
    f"""{_RET}, al AS (SELECT DISTINCT {_BY}, sym FROM bs), ev1 AS (SELECT {_BY}, 1 AS length, CAST(sym AS VARCHAR) AS seq FROM al UNION ALL
SELECT a.instrument_id, a.trade_date, 2, CAST(a.sym AS VARCHAR) || ',' || CAST(c.sym AS VARCHAR) FROM al a JOIN al c USING ({_BY})),
gr AS (SELECT {_BY}, 1 AS length, CAST(sym AS VARCHAR) AS seq FROM bs UNION ALL
SELECT * FROM (SELECT {_BY}, 2, CAST(lag(sym) OVER ({NEXT}) AS VARCHAR) || ',' || CAST(sym AS VARCHAR) AS seq FROM bs) WHERE seq IS NOT NULL),
ct AS (SELECT {_BY}, length, seq, count(*) AS cnt FROM gr GROUP BY ALL), fl AS (SELECT {_BY}, length, seq, coalesce(cnt, 0) AS cnt FROM ev1 LEFT JOIN ct USING ({_BY}, length, seq))
SELECT {_BY}, length, seq, cnt, CAST({_SHARE.format(_BY + ',')} AS BIGINT) AS total, round(coalesce(cnt / nullif({_SHARE.format(_BY + ',')}, 0), 0), 9) AS prob FROM fl"""
)
def ngram_counts_zero_filled(spark, d):
    return _seq(ngrams.zero_filled(pairs(spark, d), "sym", 2), "cnt", "total", F.round("prob", 9).alias("prob"))


_CLS = f"""{_grams_sql(LONGEST, ", " + _C.format("f1", "4.15e-5") + " AS cls")},
cc AS (SELECT {_BY}, length, seq, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = -1) AS n2, count(*) AS total FROM gr GROUP BY ALL)"""


def _classed(spark, d) -> DataFrame:
    return ngrams.class_counts(labels.class_label(bars.targets(pairs(spark, d), (1,)), "c1"), "sym", "class", LONGEST)


def _slots() -> list[Column]:
    return [F.get("class_counts", F.lit(i)).alias(f"n{i}") for i in range(3)] + [F.round(F.get("class_probs", F.lit(i)), 9).alias(f"p{i}") for i in range(3)]


_SLOTS = "n0, n1, n2, round(n0 / total, 9) AS p0, round(n1 / total, 9) AS p1, round(n2 / total, 9) AS p2, total"


@register(f"{_CLS} SELECT {_BY}, length, seq, {_SLOTS} FROM cc")
def ngram_class_probs(spark, d):
    return _seq(_classed(spark, d), *_slots(), "total")


@register(
    f"""{_CLS}, al AS (SELECT DISTINCT {_BY}, sym FROM bs), ev1 AS (SELECT {_BY}, 1 AS length, CAST(sym AS VARCHAR) AS seq FROM al UNION ALL
SELECT a.instrument_id, a.trade_date, 2, CAST(a.sym AS VARCHAR) || ',' || CAST(c.sym AS VARCHAR) FROM al a JOIN al c USING ({_BY})),
fl AS (SELECT {_BY}, length, seq, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(total, 0) AS total FROM ev1 LEFT JOIN cc USING ({_BY}, length, seq))
SELECT {_BY}, length, seq, n0, n1, n2, {', '.join(f'round(coalesce(n{i} / nullif(total, 0), 0), 9) AS p{i}' for i in range(3))}, total FROM fl"""
)
def ngram_class_zero_filled(spark, d):
    df = labels.class_label(bars.targets(pairs(spark, d), (1,)), "c1")
    return _seq(ngrams.class_counts(df, "sym", "class", 2, non_zero_only=False), *_slots(), "total")


_FOLD = f"{_CNT}, fo AS (SELECT length, seq, CAST(sum(cnt) AS BIGINT) AS cnt FROM ct GROUP BY ALL), fs AS (SELECT *, CAST({_SHARE.format('')} AS BIGINT) AS total, cnt / {_SHARE.format('')} AS prob FROM fo)"


@register(f"{_FOLD} SELECT length, seq, cnt, total, round(prob, 9) AS prob FROM fs")
def fold_sequence_distr(spark, d):
    return _seq(ngrams.fold(_counted(spark, d)), "cnt", "total", F.round("prob", 9).alias("prob"), by=())


@register(
    f"""{_CLS}, fc AS (SELECT length, seq, CAST(sum(n0) AS BIGINT) AS n0, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, CAST(sum(total) AS BIGINT) AS total FROM cc GROUP BY ALL)
SELECT length, seq, {_SLOTS} FROM fc"""
)
def fold_class_distr(spark, d):
    return _seq(ngrams.fold_classes(_classed(spark, d)), *_slots(), "total", by=())


@register(f"{_FOLD} SELECT length, seq, cnt, round(prob, 9) AS prob FROM fs WHERE length IN (2, 3) AND prob > 0.002e0")
def filter_distr(spark, d):
    return _seq(ngrams.filtered(ngrams.fold(_counted(spark, d)), [2, 3], 0.002), "cnt", F.round("prob", 9).alias("prob"), by=())


@register(
    f"""{_CNT}, r AS (SELECT seq, CAST(sum(cnt) AS BIGINT) AS c FROM ct WHERE length = 2 AND instrument_id = 0 GROUP BY ALL), rr AS (SELECT seq, c / sum(c) OVER () AS prob, row_number() OVER (ORDER BY c DESC, seq) - 1 AS pos FROM r),
o AS (SELECT seq, sum(cnt) AS c FROM ct WHERE length = 2 AND instrument_id = 1 GROUP BY ALL), oo AS (SELECT seq, c / sum(c) OVER () AS other FROM o)
SELECT pos, '(' || seq || ')' AS label, round(prob, 9) AS prob, round(coalesce(other, 0), 9) AS other FROM rr LEFT JOIN oo USING (seq)"""
)
def align_distr(spark, d):
    from pyspark.sql import Window

    both = ngrams.fold(_counted(spark, d).where("length = 2"), ["instrument_id"])
    first = both.where("instrument_id = 0")
    place = F.row_number().over(Window.orderBy(F.col("cnt").desc(), F.array_join(F.col("seq").cast("array<string>"), ","))) - 1
    first = first.select("length", "seq", "prob", place.alias("pos"))  # at most alphabet ** 2 rows
    r = ngrams.aligned(first, {"other": both.where("instrument_id = 1")})
    return r.select("pos", "label", F.round("prob", 9).alias("prob"), F.round("other", 9).alias("other"))


@register(f"{_PAIR}, vc AS (SELECT {_BY}, sym AS value, count(*) AS cnt FROM bs GROUP BY ALL) SELECT *, round(cnt / sum(cnt) OVER (PARTITION BY {_BY}), 9) AS prob FROM vc")
def value_shares(spark, d):
    return ngrams.value_shares(pairs(spark, d), "sym", ["instrument_id", "trade_date"]).withColumn("prob", F.round("prob", 9))


# --- dependence ---------------------------------------------------------------------------------------------------

_LAGS = 3


def _lag_union(select: str, lags: list[int], source: str = "bs") -> str:
    return " UNION ALL ".join(f"SELECT {_BY}, {k} AS lag, {select.format(k=k, K=abs(k))} FROM {source}" for k in lags)


@register(
    f"{BARS_SQL}, l AS ({_lag_union('log_mid AS x, lag(log_mid, {k}) OVER (' + NEXT + ') AS y', [1, 2, 3], 'b')}) SELECT {_BY}, lag, round(corr(x, y), 6) AS value FROM l WHERE y IS NOT NULL GROUP BY ALL"
)
def acf(spark, d):
    return dependence.autocorrelation(bar(spark, d), "log_mid", _LAGS).withColumn("value", F.round("value", 6))


@register(
    f"""{_PAIR}, c AS (SELECT {_BY}, sample_idx, ret - avg(ret) OVER ({PART}) AS a, imbalance - avg(imbalance) OVER ({PART}) AS i, stddev_pop(ret) OVER ({PART}) * stddev_pop(imbalance) OVER ({PART}) AS s FROM pr WHERE ret IS NOT NULL),
l AS ({' UNION ALL '.join(f"SELECT {_BY}, {k} AS lag, {'lag(a, ' + str(-k) + ') OVER (' + NEXT + ')' if k < 0 else 'a'} AS a, {'lag(i, ' + str(k) + ') OVER (' + NEXT + ')' if k > 0 else 'i'} AS i, s FROM c" for k in range(-_LAGS, _LAGS + 1))})
SELECT {_BY}, lag, round(avg(a * i) / max(s), 6) AS value, count(*) AS pairs, round(1.959963984540054e0 / sqrt(count(*)), 9) AS ci FROM l WHERE a IS NOT NULL AND i IS NOT NULL GROUP BY ALL"""
)
def cross_correlation(spark, d):
    r = dependence.cross_correlation(pairs(spark, d), "log_mid_ret", "imbalance", _LAGS)
    return r.withColumns({"value": F.round("value", 6), "ci": F.round("ci", 9)})


_MI = """, jc AS (SELECT {0}, x, y, count(*) AS cnt FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
jm AS (SELECT *, sum(cnt) OVER (PARTITION BY {0}) AS n, sum(cnt) OVER (PARTITION BY {0}, x) AS nx, sum(cnt) OVER (PARTITION BY {0}, y) AS ny FROM jc)
SELECT {0}, round(sum(cnt / n * log2(cnt * n / (nx * ny))), 6) AS value, CAST(max(n) AS BIGINT) AS pairs FROM jm GROUP BY ALL"""


@register(
    f"""{_PAIR}, ab AS (SELECT {_BY}, sample_idx, sym % 4 AS a, sym // 4 AS i FROM bs),
l AS ({' UNION ALL '.join(f"SELECT {_BY}, {k} AS lag, {'lag(a, ' + str(-k) + ') OVER (' + NEXT + ')' if k < 0 else 'a'} AS x, {'lag(i, ' + str(k) + ') OVER (' + NEXT + ')' if k > 0 else 'i'} AS y FROM ab" for k in range(-_LAGS, _LAGS + 1))})"""
    + _MI.format(_BY + ", lag")
)
def mi_lag(spark, d):
    df = pairs(spark, d).withColumns({"a": F.col("sym") % 4, "i": F.floor(F.col("sym") / 4).cast("int")})
    return dependence.mutual_information(df, "a", "i", list(range(-_LAGS, _LAGS + 1)), fewest=0).withColumn("value", F.round("value", 6))


_HIST = f"""{_PAIR}, l0 AS ({' UNION ALL '.join(f"SELECT {_BY}, {k} AS lag, imbalance AS x, lead(bid_sz_00, {k}) OVER ({NEXT}) AS y FROM pr" for k in range(_LAGS + 1))}),
l1 AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM l0 WHERE y IS NOT NULL WINDOW w AS (PARTITION BY {_BY}, lag)),
l AS (SELECT {_BY}, lag, coalesce(least(CAST(floor((x - x0) / nullif(x1 - x0, 0) * 5) AS INT), 4), 2) AS x, coalesce(least(CAST(floor((y - y0) / nullif(y1 - y0, 0) * 5) AS INT), 4), 2) AS y FROM l1)"""


@register(_HIST + _MI.format(_BY + ", lag"))
def mi_hist(spark, d):
    return dependence.histogram_information(pairs(spark, d), "imbalance", "bid_sz_00", list(range(_LAGS + 1)), 5).withColumn("value", F.round("value", 6))


@register(
    f"""{_HIST}, jc AS (SELECT {_BY}, lag, x, y, count(*) AS cnt FROM l GROUP BY ALL),
jm AS (SELECT *, sum(cnt) OVER (PARTITION BY {_BY}, lag) AS n, sum(cnt) OVER (PARTITION BY {_BY}, lag, x) AS nx, sum(cnt) OVER (PARTITION BY {_BY}, lag, y) AS ny FROM jc),
mi AS (SELECT {_BY}, lag, round(sum(cnt / n * log2(cnt * n / (nx * ny))), 6) AS value, CAST(max(n) AS BIGINT) AS pairs FROM jm GROUP BY ALL),
cells AS (SELECT a.range AS back, c.range AS ahead FROM range(3) a, range(2) c)
SELECT {_BY}, CAST(back AS INT) AS back, CAST(ahead AS INT) AS ahead, value, pairs FROM mi JOIN cells ON lag = back + ahead"""
)
def mi_space_time(spark, d):
    return dependence.space_time_information(pairs(spark, d), "imbalance", "bid_sz_00", 2, 1, 5).withColumn("value", F.round("value", 6))


@register(
    f"""{_PAIR}, jc AS (SELECT {_BY}, sym, count(*) AS c FROM bs GROUP BY ALL), pe AS (SELECT *, c / sum(c) OVER (PARTITION BY {_BY}) AS p FROM jc) SELECT {_BY}, round(-sum(p * log2(p)), 6) AS value FROM pe GROUP BY ALL"""
)
def symbol_entropy(spark, d):
    return dependence.entropy(pairs(spark, d), "sym", ["instrument_id", "trade_date"]).withColumn("value", F.round("value", 6))


def _te_sql(source: str, target: str, lags: range) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {_BY}, {k} AS lag, {target} AS a, lag({source}, {k}) OVER ({NEXT}) AS b, lag({target}) OVER ({NEXT}) AS c FROM ab" for k in lags
    )
    return f"""{_PAIR}, ab AS (SELECT {_BY}, sample_idx, sym % 4 AS a, sym // 4 AS i FROM bs), l AS ({rows}),
jc AS (SELECT {_BY}, lag, a, b, c, count(*) AS cnt FROM l WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
jm AS (SELECT *, sum(cnt) OVER (PARTITION BY {_BY}, lag) AS n, sum(cnt) OVER (PARTITION BY {_BY}, lag, c) AS nc, sum(cnt) OVER (PARTITION BY {_BY}, lag, a, c) AS nac, sum(cnt) OVER (PARTITION BY {_BY}, lag, b, c) AS nbc FROM jc)
SELECT {_BY}, lag, round(greatest(sum(cnt / n * log2(cnt * nc / (nac * nbc))), 0), 6) AS value, CAST(max(n) AS BIGINT) AS pairs FROM jm GROUP BY ALL"""


def _two(spark, d) -> DataFrame:
    return pairs(spark, d).withColumns({"a": F.col("sym") % 4, "i": F.floor(F.col("sym") / 4).cast("int")})


@register(_te_sql("i", "a", range(1, 4)))
def te_lag(spark, d):
    return dependence.transfer_entropy(_two(spark, d), "i", "a", [1, 2, 3]).withColumn("value", F.round("value", 6))


@register(_te_sql("a", "a", range(2, 4)))
def te_self(spark, d):
    return dependence.self_transfer_entropy(_two(spark, d), "a", 3).withColumn("value", F.round("value", 6))


@register(
    f"""{_PAIR}, ab AS (SELECT instrument_id, trade_date, sample_idx, sym % 4 AS y, sym // 4 AS xx FROM bs), ab2 AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date, sample_idx) AS sample, y, xx FROM ab),
l AS ({' UNION ALL '.join(f"SELECT instrument_id, {k} AS lag, y, lag(y) OVER (PARTITION BY instrument_id ORDER BY sample) AS h, lag(xx, {k}) OVER (PARTITION BY instrument_id ORDER BY sample) AS x FROM ab2" for k in (1, 2))}),
jc AS (SELECT instrument_id, lag, y, h, x, count(*) AS cnt FROM l WHERE h IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
sz AS (SELECT instrument_id, max(xx) + 1 AS kx, max(y) + 1 AS ky FROM ab2 GROUP BY ALL),
gr AS (SELECT instrument_id, lag.range AS lag, y.range AS y, h.range AS h, x.range AS x FROM sz, range(1, 3) lag, range(16) y, range(16) h, range(16) x WHERE y.range < ky AND h.range < ky AND x.range < kx),
g AS (SELECT gr.*, coalesce(cnt, 0) AS cnt FROM gr LEFT JOIN jc USING (instrument_id, lag, y, h, x)),
cm AS (SELECT *, sum(cnt) OVER (PARTITION BY instrument_id, lag, h, x) + 1 AS hx, sum(cnt) OVER (PARTITION BY instrument_id, lag, y, h) + 1 AS yh, sum(cnt) OVER (PARTITION BY instrument_id, lag, h) + 1 AS hh FROM g)
SELECT instrument_id, CAST(lag AS INT) AS lag, round(sum((cnt + 1) * log2((cnt + 1) / hx / (yh / hh))) / sum(cnt + 1), 6) AS value FROM cm GROUP BY ALL"""
)
def te_counterfactual(spark, d):
    order = Order(("instrument_id",), ("trade_date", "sample_idx"))
    return dependence.counterfactual_entropy(_two(spark, d), "i", "a", [1, 2], order=order).withColumn("value", F.round("value", 6))


def _histogram_sql(rows: str, by: str, sigma: float | None) -> str:
    """From the definition: bins by search among edges, and p(x'), p(x', y), p(x', x), p(x', y, x) each counted, and smoothed, on its own."""
    stats = ", ".join(
        f"CAST(greatest(least(floor((max({c}) - min({c})) / nullif(2 * CASE WHEN q3_{c} = q1_{c} THEN 1e-8 ELSE q3_{c} - q1_{c} END / pow(count({c}), 1e0 / 3e0), 0)), 64), 1) AS INT) AS b_{c}" for c in "pq"
    )
    quartiles = ", ".join(f"quantile_cont({c}, 0.25) OVER w AS q1_{c}, quantile_cont({c}, 0.75) OVER w AS q3_{c}" for c in "pq")
    edges = ", ".join(f"list_transform(range(1, {b}), lambda i: l_{c} + i * ((h_{c} - l_{c}) / {b})) AS e_{c}" for c, b in (("f", "b_p"), ("q", "b_q"), ("p", "b_p")))
    bins = ", ".join(f"len(list_filter(e_{c}, lambda e: {c} >= e)) AS {c}" for c in "fqp")
    sql = f"""{rows}, w AS (SELECT *, {quartiles} FROM t WINDOW w AS (PARTITION BY {by})),
s1 AS (SELECT {by}, {stats} FROM w GROUP BY {by}, q1_p, q3_p, q1_q, q3_q),
s2 AS (SELECT {by}, {', '.join(f'min({c}) - CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS l_{c}, max({c}) + CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS h_{c}' for c in 'fqp')}
  FROM t WHERE f IS NOT NULL AND q IS NOT NULL AND p IS NOT NULL GROUP BY {by}),
st AS (SELECT *, {edges} FROM s1 JOIN s2 USING ({by})),
ce AS (SELECT {by}, b_p, b_q, {bins} FROM t JOIN st USING ({by}) WHERE t.f IS NOT NULL AND t.q IS NOT NULL AND t.p IS NOT NULL)"""
    tables = {"n3": "fqp", "n2": "fq", "nd": "fp", "n1": "f"}
    for name, axes in tables.items():
        cols = ", ".join(axes)
        sql += f",\n{name}_0 AS (SELECT {by}, b_p, b_q, {cols}, CAST(count(*) AS DOUBLE) AS c FROM ce GROUP BY ALL)"
        for k, axis in enumerate(axes if sigma else ""):
            b, radius = "b_q" if axis == "q" else "b_p", int(4 * sigma + 0.5)
            mirror = f"CASE WHEN m < {b} THEN m ELSE 2 * {b} - 1 - m END"
            rest = ", ".join(c for c in axes if c != axis)
            sql += f""",
{name}_{k + 1} AS (SELECT {by}, b_p, b_q, {rest + ', ' if rest else ''}{mirror} AS {axis}, sum(c * w) AS c FROM (
  SELECT *, (({axis} + d) % (2 * {b}) + 2 * {b}) % (2 * {b}) AS m FROM {name}_{k}, (SELECT CAST(range AS INT) AS d, exp(-0.5 * range * range / {sigma * sigma}) / sum(exp(-0.5 * range * range / {sigma * sigma})) OVER () AS w FROM range({-radius}, {radius + 1}))) GROUP BY ALL)"""
    last = {name: f"{name}_{len(axes) if sigma else 0}" for name, axes in tables.items()}
    return (
        sql
        + f""",
tt AS (SELECT {by}, sum(c) AS n FROM n1_0 GROUP BY {by})
SELECT {by}, round(sum(a.c / n * log2(a.c * e.c / (b.c * d.c))), 6) + 0e0 AS value FROM {last['n3']} a JOIN {last['n2']} b USING ({by}, f, q) JOIN {last['nd']} d USING ({by}, f, p) JOIN {last['n1']} e USING ({by}, f) JOIN tt USING ({by}) GROUP BY {by}"""
    )


def _pair_rows(delay: int) -> str:
    return f"{BARS_SQL}, t AS (SELECT {_BY}, lead(bid_sz_00, {delay}) OVER ({NEXT}) AS f, bid_sz_00 AS p, ask_sz_00 AS q FROM b)"


def _te(spark, d, **options) -> DataFrame:
    return dependence.histogram_transfer_entropy(bar(spark, d), "bid_sz_00", "ask_sz_00", **options).withColumn("value", F.round("value", 6) + F.lit(0.0))


@register(_histogram_sql(_pair_rows(1), _BY, None))
def te_histogram(spark, d):
    return _te(spark, d)


@register(_histogram_sql(_pair_rows(3), _BY, None))
def te_histogram_delayed(spark, d):
    return _te(spark, d, delay=3)


@register(_histogram_sql(_pair_rows(1), _BY, 0.8))
def te_histogram_smoothed(spark, d):
    return _te(spark, d, sigma=0.8)


_SYMBOLS = f"{_PAIR}, ab AS (SELECT {_BY}, sample_idx, sym % 4 AS y, sym // 4 AS x FROM bs)"
_LONG = "PARTITION BY instrument_id ORDER BY trade_date, sample_idx"


def _dense_history_sql(history: int, lags: list[int]) -> str:
    """Every cell of the smoothed tables."""
    h = " + ".join(f"lag(y, {j}) OVER ({_LONG}) * CAST(pow(ky, {j - 1}) AS INT)" for j in range(1, history + 1))
    return f"""{_SYMBOLS}, sz AS (SELECT instrument_id, max(x) + 1 AS kx, max(y) + 1 AS ky FROM ab GROUP BY ALL),
l AS ({' UNION ALL '.join(f'SELECT instrument_id, {k} AS lag, y, {h} AS h, lag(x, {k}) OVER ({_LONG}) AS x FROM ab JOIN sz USING (instrument_id)' for k in lags)}),
jc AS (SELECT instrument_id, lag, y, h, x, count(*) AS cnt FROM l WHERE h IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
gr AS (SELECT instrument_id, lag.lag, y.range AS y, h.range AS h, x.range AS x FROM sz, (SELECT DISTINCT lag FROM jc) lag, range(16) y, range({16**history}) h, range(16) x WHERE y.range < ky AND h.range < pow(ky, {history}) AND x.range < kx),
g AS (SELECT gr.*, coalesce(cnt, 0) AS cnt FROM gr LEFT JOIN jc USING (instrument_id, lag, y, h, x)),
cm AS (SELECT *, sum(cnt) OVER (PARTITION BY instrument_id, lag, h, x) + 1 AS hx, sum(cnt) OVER (PARTITION BY instrument_id, lag, y, h) + 1 AS yh, sum(cnt) OVER (PARTITION BY instrument_id, lag, h) + 1 AS hh FROM g)
SELECT instrument_id, lag, round(sum((cnt + 1) * log2((cnt + 1) / hx / (yh / hh))) / sum(cnt + 1), 6) AS value FROM cm GROUP BY ALL"""


_BY_INSTRUMENT = Order(("instrument_id",), ("trade_date", "sample_idx"))


@register(_dense_history_sql(3, [1, 2, 5]))
def te_counterfactual_history(spark, d):
    r = dependence.counterfactual_entropy(_two(spark, d), "i", "a", [1, 2, 5], history=3, order=_BY_INSTRUMENT)
    return r.withColumn("value", F.round("value", 6))


@register(
    f"""{_SYMBOLS}, sz AS (SELECT instrument_id, max(x) + 1 AS kx, max(y) + 1 AS ky FROM ab GROUP BY ALL),
l AS ({' UNION ALL '.join(f"SELECT instrument_id, {k} AS lag, y, lag(y, 1) OVER ({_LONG}) || ',' || lag(y, 2) OVER ({_LONG}) || ',' || lag(x, {k + 1}) OVER ({_LONG}) AS c, lag(x, {k}) OVER ({_LONG}) AS x FROM ab" for k in (1, 4))}),
jc AS (SELECT instrument_id, lag, c, x, y, count(*) AS m FROM l WHERE c IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
gr AS (SELECT t.instrument_id, lag, c, x.range AS x, y.range AS y, kx, ky FROM (SELECT DISTINCT instrument_id, lag, c FROM jc) t JOIN sz ON t.instrument_id = sz.instrument_id, range(16) x, range(16) y WHERE x.range < kx AND y.range < ky),
g AS (SELECT gr.*, coalesce(m, 0) AS m FROM gr LEFT JOIN jc USING (instrument_id, lag, c, x, y)),
pc AS (SELECT *, (m + 0.5) / (sum(m) OVER (PARTITION BY instrument_id, lag, c, x) + 0.5 * ky) AS py,
  (sum(m) OVER (PARTITION BY instrument_id, lag, c, x) + 0.5) / (sum(m) OVER (PARTITION BY instrument_id, lag, c) + 0.5 * kx) AS px, sum(m) OVER (PARTITION BY instrument_id, lag) AS n FROM g),
cf AS (SELECT *, sum(px * py) OVER (PARTITION BY instrument_id, lag, c, y) AS f FROM pc)
SELECT instrument_id, lag, round(sum(m / n * log2(py / f)), 6) AS value FROM cf WHERE m > 0 GROUP BY ALL"""
)
def te_dirichlet(spark, d):
    r = dependence.dirichlet_entropy(_two(spark, d), "i", "a", [1, 4], history=2, past=1, order=_BY_INSTRUMENT)
    return r.withColumn("value", F.round("value", 6))


_STEPS, _BACK = 3, 20


@register(
    _histogram_sql(
        f"{BARS_SQL}, t AS ({' UNION ALL '.join(f'SELECT {_BY}, {k} AS apart, bid_sz_00 AS q, lead(bid_sz_00, {k}) OVER ({NEXT}) AS p, lead(bid_sz_00, {k + 1}) OVER ({NEXT}) AS f FROM b QUALIFY p IS NOT NULL' for k in range(2, _STEPS + _BACK + 1))})",
        f"{_BY}, apart", None,
    ).replace(f"SELECT {_BY}, apart, round", f"SELECT {_BY}, CAST(s.range AS INT) AS step, CAST(apart - s.range AS INT) AS lag, round").replace(
        f"JOIN tt USING ({_BY}, apart) GROUP BY {_BY}, apart", f"JOIN tt USING ({_BY}, apart) JOIN range(1, {_STEPS + 1}) s ON apart - s.range BETWEEN 1 AND {_BACK} GROUP BY {_BY}, apart, s.range"
    )
)
def te_step_lag(spark, d):
    r = dependence.step_lag_entropy(bar(spark, d), "bid_sz_00", _STEPS, _BACK)
    return r.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _neighbours_sql(x: str, lags: list[int], k: int) -> str:
    """All pairs of points of each instrument, day and lag."""
    by = f"{_BY}, lag"
    psi = "list_sum(list_transform(range(1, CAST({0} AS BIGINT)), lambda i: 1e0 / i))"  # digamma plus Euler's constant, which cancels
    count = "sum(CASE WHEN {c} < greatest(d, 1) THEN 1 ELSE 0 END)"
    return f"""{_PAIR}, l AS ({' UNION ALL '.join(f'SELECT {_BY}, {j} AS lag, sample_idx AS i, {x} AS x, lead({x}, {j}) OVER ({NEXT}) AS y FROM pr' for j in lags)}),
sc AS (SELECT *, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM l WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY {by})),
pt AS (SELECT {by}, i, CAST(round_even(x / CASE WHEN sx = 0 THEN 1 ELSE sx END * 4294967296e0, 0) AS BIGINT) AS u, CAST(round_even(y / CASE WHEN sy = 0 THEN 1 ELSE sy END * 4294967296e0, 0) AS BIGINT) AS v FROM sc),
pp AS MATERIALIZED (SELECT {', '.join(f'a.{c}' for c in by.split(', '))}, a.i, abs(a.u - b.u) AS du, abs(a.v - b.v) AS dv FROM pt a JOIN pt b ON a.instrument_id = b.instrument_id AND a.trade_date = b.trade_date AND a.lag = b.lag AND a.i <> b.i),
kd AS (SELECT {by}, i, list_sort(list(greatest(du, dv)))[{k}] AS d FROM pp GROUP BY ALL),
nn AS (SELECT {by}, i, d, {count.format(c='du')} AS nu, {count.format(c='dv')} AS nv FROM pp JOIN kd USING ({by}, i) GROUP BY ALL),
tt AS (SELECT {by}, count(*) AS pairs FROM pt GROUP BY ALL)
SELECT {by}, pairs, round(greatest(coalesce({psi.format('pairs')}, 0) + {psi.format(k)} - s, 0), 6) + 0e0 AS value FROM tt LEFT JOIN (
  SELECT {by}, avg(coalesce({psi.format('nu + 1')}, 0) + coalesce({psi.format('nv + 1')}, 0)) AS s FROM nn WHERE d IS NOT NULL GROUP BY ALL) USING ({by})"""


_KNN = [1, 2, 5]


@register(_neighbours_sql("ret", _KNN, 5))
def mi_neighbours(spark, d):
    r = neighbours.neighbour_information(pairs(spark, d), "log_mid_ret", "log_mid_ret", _KNN)
    return r.withColumn("value", F.round("value", 6) + F.lit(0.0))


@register(_neighbours_sql("imbalance", [1], 3))
def mi_neighbours_imbalance(spark, d):
    r = neighbours.neighbour_information(pairs(spark, d), "imbalance", "imbalance", [1], 3)
    return r.withColumn("value", F.round("value", 6) + F.lit(0.0))


_FAR = 20  # the longest lag of the profile


def _profile_sql() -> str:
    """Each measure from its definition over pairs of rows, joined; nothing is shared but those."""
    by = f"{_BY}, lag"
    mi = lambda rows: f"WITH l AS ({rows}){_MI.format(by)}"
    some = lambda lag, x, y, where: f"SELECT {_BY}, {lag} AS lag, {x} AS x, {y} AS y FROM far WHERE {where}"

    def histogram(rows: str, bins: int) -> str:
        one = lambda c: f"coalesce(least(CAST(floor(({c} - {c}0) / nullif({c}1 - {c}0, 0) * {bins}) AS INT), {bins - 1}), {bins // 2}) AS {c}"
        ends = ", ".join(f"{f}({c}) OVER w AS {c}{i}" for c in "xy" for i, f in enumerate(("min", "max")))
        return mi(f"SELECT {by}, {one('x')}, {one('y')} FROM (SELECT *, {ends} FROM ({rows}) WINDOW w AS (PARTITION BY {by}))")

    def transfer(a: str, b: str, c: str, first: int) -> str:
        over = lambda *cols: f"sum(cnt) OVER (PARTITION BY {', '.join((by, *cols))})"
        return f"""WITH jc AS (SELECT {_BY}, k AS lag, {a} AS a, {b} AS b, {c} AS c, count(*) AS cnt FROM far WHERE k BETWEEN {first} AND {_FAR} GROUP BY ALL),
jm AS (SELECT *, {over()} AS n, {over('c')} AS nc, {over('a', 'c')} AS nac, {over('b', 'c')} AS nbc FROM jc)
SELECT {by}, round(greatest(sum(cnt / n * log2(cnt * nc / (nac * nbc))), 0), 6) AS value, CAST(max(n) AS BIGINT) AS pairs FROM jm GROUP BY ALL"""

    smoothed = f"""WITH jc AS (SELECT {_BY}, k AS lag, nsy AS y, oy AS h, psx AS x, count(*) AS cnt FROM far WHERE k BETWEEN 1 AND {_FAR} GROUP BY ALL),
sz AS (SELECT {_BY}, max(sx) + 1 AS kx, max(sy) + 1 AS ky FROM sr GROUP BY ALL),
g AS (SELECT {_BY}, lag, y, h, x, coalesce(cnt, 0) AS cnt FROM sz JOIN (SELECT range AS lag FROM range(1, {_FAR + 1})) ON true JOIN (SELECT range AS y FROM range(4)) ON y < ky
  JOIN (SELECT range AS h FROM range(4)) ON h < ky JOIN (SELECT range AS x FROM range(4)) ON x < kx LEFT JOIN jc USING (instrument_id, trade_date, lag, y, h, x)),
cm AS (SELECT *, sum(cnt) OVER (PARTITION BY {by}, h, x) + 1 AS hx, sum(cnt) OVER (PARTITION BY {by}, y, h) + 1 AS yh, sum(cnt) OVER (PARTITION BY {by}, h) + 1 AS hh FROM g)
SELECT {by}, CASE WHEN sum(cnt) >= 50 THEN round(sum((cnt + 1) * log2((cnt + 1) / hx / (yh / hh))) / sum(cnt + 1), 6) END AS value, sum(cnt) AS pairs FROM cm GROUP BY ALL"""
    delayed = " UNION ALL ".join(f"SELECT {_BY}, {k} AS lag, lead(x, {k}) OVER (PARTITION BY {_BY} ORDER BY i) AS f, x AS p, y AS q FROM sr" for k in range(1, _FAR + 1))
    z = 1.959963984540054
    cross = lambda lag, a, b, where: f"SELECT {_BY}, {lag} AS lag, avg(({a} - mx) * ({b} - my)) / max(dx * dy) AS v, count(*) AS pairs FROM far JOIN mo USING ({_BY}) WHERE {where} GROUP BY ALL"
    measures = {
        "information": histogram(some("k", "px", "ny", f"k <= {_FAR}") + " UNION ALL " + some("-k", "nx", "py", f"k BETWEEN 1 AND {_FAR}"), 20),
        "symbol_information": mi(some("k", "nsx", "psx", f"k BETWEEN 1 AND {_FAR}")),
        "transfer": transfer("nsy", "psx", "oy", 1),
        "self_transfer": transfer("nsx", "psx", "ox", 2),
        "counterfactual": smoothed,
    }
    long = " UNION ALL ".join(f"SELECT {by}, '{m}' AS measure, 0 AS ahead, value, pairs, NULL AS low, NULL AS high FROM ({sql})" for m, sql in measures.items())
    th = _histogram_sql(f"WITH t AS ({delayed})", by, None)
    return f"""{_PAIR}, sr AS MATERIALIZED (SELECT {_BY}, row_number() OVER ({NEXT}) AS i, ret AS x, imbalance AS y, sym % 4 AS sx, sym // 4 AS sy FROM bs WHERE ret IS NOT NULL AND imbalance IS NOT NULL),
mo AS (SELECT {_BY}, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS dx, stddev_pop(y) AS dy, count(*) AS n FROM sr GROUP BY ALL),
far AS MATERIALIZED (SELECT a.instrument_id, a.trade_date, a.i - b.i AS k, a.x AS nx, a.y AS ny, a.sx AS nsx, a.sy AS nsy, b.x AS px, b.y AS py, b.sx AS psx, b.sy AS psy, o.sx AS ox, o.sy AS oy
  FROM sr a JOIN sr b ON a.instrument_id = b.instrument_id AND a.trade_date = b.trade_date AND a.i - b.i BETWEEN 0 AND {2 * _FAR}
  LEFT JOIN sr o ON a.instrument_id = o.instrument_id AND a.trade_date = o.trade_date AND o.i = a.i - 1),
co AS ({cross('k', 'nx', 'py', f'k <= {_FAR}')} UNION ALL {cross('-k', 'px', 'ny', f'k BETWEEN 1 AND {_FAR}')}),
au AS (SELECT {_BY}, k AS lag, sum((nx - mx) * (px - mx)) / max(n * dx * dx) AS v, max(n) AS n, count(*) AS pairs, corr(nx, px) AS c FROM far JOIN mo USING ({_BY}) WHERE k <= {_FAR} GROUP BY ALL),
ab AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE {z}e0 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN v * v END) OVER (PARTITION BY {_BY} ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS w FROM au),
te AS ({th}),
ma AS ({histogram(some('k', 'px', 'ny', 'true'), 30)}),
al AS ({long}
UNION ALL SELECT {by}, 'transfer_histogram', 0, value, (SELECT max(n) FROM mo WHERE mo.instrument_id = te.instrument_id AND mo.trade_date = te.trade_date) - lag, NULL, NULL FROM te
UNION ALL SELECT {_BY}, back, 'space_time', apart - back, value, pairs, NULL, NULL FROM (SELECT {_BY}, lag AS apart, value, pairs, unnest(range(greatest(lag - {_FAR}, 0), least(lag, {_FAR}) + 1)) AS back FROM ma)
UNION ALL SELECT {by}, 'correlation', 0, round(v, 6), pairs, round(-{z}e0 / sqrt(pairs), 6), round({z}e0 / sqrt(pairs), 6) FROM co
UNION ALL SELECT {by}, 'autocorrelation', 0, round(v, 6), pairs, round(v - w, 6), round(v + w, 6) FROM ab
UNION ALL SELECT {by}, 'self_correlation', 0, round(c, 6), pairs, NULL, NULL FROM au WHERE lag > 0)
SELECT {_BY}, measure, CAST(lag AS INT) AS lag, CAST(ahead AS INT) AS ahead, value + 0e0 AS value, CAST(pairs AS BIGINT) AS pairs, low, high FROM al"""


@register(_profile_sql())
def lag_profile(spark, d):
    r = profile.lag_profile(_two(spark, d), profile.Profile("log_mid_ret", "imbalance", "a", "i", _FAR, fewest=0))
    return r.withColumns({"value": F.round("value", 6) + F.lit(0.0), "low": F.round("low", 6), "high": F.round("high", 6)})


# --- volatility ---------------------------------------------------------------------------------------------------


@register(
    f"""{MID}, b AS (SELECT {_BY}, time_bucket(INTERVAL 60 SECONDS, ts_event) AS t, arg_max(log_mid, (ts_event, sequence)) AS v FROM ev GROUP BY ALL),
r AS (SELECT *, v - lag(v) OVER ({PART} ORDER BY t) AS r FROM b),
h AS (SELECT {_BY}, time_bucket(INTERVAL 3600 SECONDS, t) AS hour, sum(r * r) AS rv FROM r GROUP BY ALL),
g AS (SELECT {_BY}, unnest(s) AS hour FROM (SELECT {_BY}, generate_series(min(hour), max(hour), INTERVAL 3600 SECONDS) AS s FROM h GROUP BY ALL))
SELECT {_BY}, CAST(epoch_us(hour) AS BIGINT) AS start_us, round(sqrt(coalesce(rv, 0)), 9) AS volatility FROM g LEFT JOIN h USING ({_BY}, hour)"""
)
def realized_vol(spark, d):
    r = volatility.realised(event(spark, d), "log_mid", 3600, grid=60)
    return out(r.withColumn("start_us", F.unix_micros("bucket_start")), ["instrument_id", "trade_date", "start_us"], "volatility")


@register(
    f"""{MID}, i AS (SELECT {_BY}, log_mid AS x, row_number() OVER ({ROWS}) - 1 AS i, count(*) OVER ({PART}) - 1 AS n FROM ev),
k AS (SELECT *, greatest(2, least(CAST(floor(pow(n, 2e0 / 3e0)) AS BIGINT), n)) AS k FROM i),
sb AS (SELECT *, x - lag(x) OVER ({PART} ORDER BY i) AS f, x - lag(x) OVER (PARTITION BY {_BY}, i % k ORDER BY i) AS s FROM k),
ps AS (SELECT {_BY}, i % k AS m, sum(f * f) AS fast, sum(s * s) AS slow, count(s) AS steps, max(n) AS n FROM sb GROUP BY ALL)
SELECT {_BY}, round(CASE WHEN max(n) >= 2 THEN avg(slow) FILTER (steps >= 1) - avg(steps) FILTER (steps >= 1) / max(n) * sum(fast) END, 12) AS tsrv FROM ps GROUP BY ALL"""
)
def tsrv(spark, d):
    return out(volatility.two_scale(event(spark, d), "mid_price"), ["instrument_id", "trade_date"], "tsrv", digits=12)


@register(
    f"""{MID}, r AS (SELECT {_BY}, log_mid - lag(log_mid) OVER ({ROWS}) AS f, log_mid - lag(log_mid, 5) OVER ({ROWS}) AS s FROM ev)
SELECT {_BY}, round(CASE WHEN count(f) >= 5 THEN sum(s * s) / 5 - (count(f) - 5 + 1) / (count(f) * 5e0) * sum(f * f) END, 12) AS tsrv FROM r GROUP BY ALL"""
)
def tsrv_offsets(spark, d):
    return out(volatility.two_scale_offsets(event(spark, d), "log_mid", 5), ["instrument_id", "trade_date"], "tsrv", digits=12)


_RETURNS = f"""{MID}, f AS (SELECT {_BY}, CAST(floor(epoch_us(ts_event) / 10000e0) AS BIGINT) AS i, avg(mid_price) AS v FROM ev GROUP BY ALL),
f1 AS (SELECT *, coalesce(lead(i) OVER ({PART} ORDER BY i), i + 1) AS nx FROM f),
f2 AS (SELECT {_BY}, i, nx, v, unnest(generate_series(CAST(floor(i / 6000e0) AS BIGINT), CAST(floor((nx - 1) / 6000e0) AS BIGINT))) AS b FROM f1),
g AS (SELECT {_BY}, b, sum(v * (least(nx, (b + 1) * 6000) - greatest(i, b * 6000))) / sum(least(nx, (b + 1) * 6000) - greatest(i, b * 6000)) AS mean, arg_max(v, i) AS last FROM f2 GROUP BY ALL)"""


@register(
    f"""{_RETURNS}, r AS (SELECT {_BY}, b * 60000000 AS start_us, mean - lag(mean) OVER ({PART} ORDER BY b) AS ret FROM g) SELECT {_BY}, start_us, round(ret, 9) + 0e0 AS ret FROM r WHERE ret IS NOT NULL"""
)
def mean_returns(spark, d):
    r = volatility.mean_returns(event(spark, d), "mid_price", 60)
    return out(r.withColumns({"start_us": F.unix_micros("bucket_start"), "ret": F.round("ret", 9) + F.lit(0.0)}), ["instrument_id", "trade_date", "start_us"], "ret")


@register(
    f"""{_RETURNS}, r AS (SELECT {_BY}, b * 60000000 AS start_us, last - coalesce(lag(last) OVER ({PART} ORDER BY b), first_value(v0) OVER ({PART} ORDER BY b)) AS ret
  FROM g JOIN (SELECT {_BY}, arg_min(v, i) AS v0 FROM f GROUP BY ALL) USING ({_BY})) SELECT {_BY}, start_us, round(ret, 9) + 0e0 AS ret FROM r"""
)
def summed_returns(spark, d):
    r = volatility.summed_returns(event(spark, d), "mid_price", 60)
    return out(r.withColumns({"start_us": F.unix_micros("bucket_start"), "ret": F.round("ret", 9) + F.lit(0.0)}), ["instrument_id", "trade_date", "start_us"], "ret")


_BUCKET, _STEP = 3600, 60  # an hour's slots of a second, since the twin makes every slot; the default grid is tested beside it
# Every slot of the filled grid, with its place in its bucket.
_GRID_SLOTS = f"""{MID}, f AS (SELECT {_BY}, CAST(floor(epoch_us(ts_event) / 1000000e0) AS BIGINT) AS i, avg(mid_price) AS v FROM ev WHERE mid_price > 0 GROUP BY ALL),
f1 AS (SELECT *, coalesce(lead(i) OVER ({PART} ORDER BY i), i + 1) AS nx FROM f),
sl AS (SELECT {_BY}, ln(v) AS x, unnest(range(i, nx)) AS i FROM f1),
g AS (SELECT {_BY}, x, i // {_BUCKET} AS b, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY {_BY}, i // {_BUCKET}) AS n FROM sl WINDOW w AS (PARTITION BY {_BY}, i // {_BUCKET} ORDER BY i)),
k AS (SELECT *, greatest(2, least({_STEP}, n - 1)) AS k FROM g)"""


@register(
    f"""{_GRID_SLOTS}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY {_BY}, b ORDER BY t) AS f, x - lag(x) OVER (PARTITION BY {_BY}, b, t % k ORDER BY t) AS s FROM k),
sb AS (SELECT {_BY}, b, t % k AS m, sum(f * f) AS fast, sum(s * s) AS slow, count(s) AS steps, max(n) AS n FROM d GROUP BY ALL)
SELECT {_BY}, b * {_BUCKET * 1_000_000} AS start_us, round(CASE WHEN max(n) >= 3 THEN avg(slow) FILTER (steps >= 1) - avg(steps) FILTER (steps >= 1) / (max(n) - 1) * sum(fast) END, 12) + 0e0 AS tsrv FROM sb GROUP BY ALL"""
)
def tsrv_buckets(spark, d):
    r = volatility.two_scale_buckets(event(spark, d), "mid_price", _BUCKET, k=_STEP, grid=1.0)
    return r.select("instrument_id", "trade_date", F.unix_micros("bucket_start").alias("start_us"), (F.round("tsrv", 12) + F.lit(0.0)).alias("tsrv"))


@register(
    f"""{_GRID_SLOTS}, c AS (SELECT *, sum(x) OVER w AS s, count(*) OVER w AS c FROM g WHERE n >= {_STEP} WINDOW w AS (PARTITION BY {_BY}, b, t % {_STEP} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {_BY}, b * {_BUCKET * 1_000_000} AS start_us, round(avg(s / c) FILTER (t <= n - {_STEP}) - avg(c) FILTER (t <= n - {_STEP}) / max(n) * avg(x), 6) AS tsmp FROM c GROUP BY ALL"""
)
def tsmp_buckets(spark, d):
    r = volatility.two_scale_mean_buckets(event(spark, d), "mid_price", _BUCKET, k=_STEP, grid=1.0)
    return out(r.withColumn("start_us", F.unix_micros("bucket_start")), ["instrument_id", "trade_date", "start_us"], "tsmp", digits=6)


#: Every set of parameters for the queries below: share of the variance, alpha, beta.
_SETS = [(1.0, 0.05, 0.9), (0.8, 0.1, 0.7), (1.2, 0.3, 0.4), (1.0, 0.0, 0.5)]
# The recursion row by row; returns are changes of the log mid price from bar to bar.
_VARIANCE = f"""WITH RECURSIVE {MID.removeprefix('WITH ')}, p0 AS (SELECT *, row_number() OVER ({ROWS}) - 1 AS event_idx FROM ev),
b AS (SELECT {_BY}, event_idx // {BLOCK} AS sample_idx, log_mid FROM p0 WHERE event_idx % {BLOCK} = {BLOCK - 1}),
r AS (SELECT {_BY}, sample_idx, log_mid - lag(log_mid) OVER ({NEXT}) AS ret FROM b),
e AS (SELECT *, ret - avg(ret) OVER ({PART}) AS e, row_number() OVER ({NEXT}) - 1 AS i FROM r WHERE ret IS NOT NULL),
s AS MATERIALIZED (SELECT *, sum(CASE WHEN i < 75 THEN pow(0.94e0, i) * e * e END) OVER ({PART}) / sum(CASE WHEN i < 75 THEN pow(0.94e0, i) END) OVER ({PART}) AS v0, avg(e * e) OVER ({PART}) AS v FROM e),
q AS (SELECT * FROM (VALUES {', '.join(f'({n}, {a!r}e0, {b!r}e0, {c!r}e0)' for n, (a, b, c) in enumerate(_SETS))}) t(set_no, share, alpha, beta)),
k AS (SELECT {_BY}, sample_idx, i, e, set_no, alpha, beta, share * (1 - alpha - beta) * v AS omega, share * (1 - alpha - beta) * v + (alpha + beta) * v0 AS variance FROM s, q WHERE i = 0
  UNION ALL SELECT s.instrument_id, s.trade_date, s.sample_idx, s.i, s.e, k.set_no, k.alpha, k.beta, k.omega, k.omega + k.alpha * k.e * k.e + k.beta * k.variance
  FROM k JOIN s ON s.instrument_id = k.instrument_id AND s.trade_date = k.trade_date AND s.i = k.i + 1)"""


def _bar_returns(spark, d) -> DataFrame:
    return bar(spark, d).select(*BAR, diff("log_mid", bars.BARS).alias("ret"))


@register(f"{_VARIANCE.replace('share * (1 - alpha - beta) * v', 'share')} SELECT {_BY}, sample_idx, round(sqrt(variance), 9) AS volatility FROM k WHERE set_no = 0".replace("(0, 1.0e0,", "(0, 1e-9,"))
def conditional_volatility(spark, d):
    r = volatility.conditional_variance(_bar_returns(spark, d), "ret", 1e-9, _SETS[0][1], _SETS[0][2], bars.BARS)
    return out(r.withColumn("volatility", F.sqrt("variance")), BAR, "volatility")


@register(
    f"""{_VARIANCE}, l AS (SELECT {_BY}, set_no, max(omega) AS omega, sum(-0.5 * (ln(2 * pi()) + ln(variance) + e * e / variance)) AS loglik FROM k GROUP BY ALL)
SELECT {_BY}, set_no, round(loglik, 6) AS loglik FROM l"""
)
def conditional_likelihoods(spark, d):
    """Every parameter set's likelihood for each instrument and day, in one aggregate."""
    sets = F.explode(F.array(*(F.struct(F.lit(n).alias("set"), F.lit(a).alias("share"), F.lit(b).alias("alpha"), F.lit(c).alias("beta")) for n, (a, b, c) in enumerate(_SETS))))
    r = _bar_returns(spark, d)
    every = r.select("instrument_id", "trade_date").distinct().withColumn("p", sets).select("instrument_id", "trade_date", "p.*")
    told = volatility.likelihoods(r, "ret", every, bars.BARS, min(beta for *_, beta in _SETS))
    return told.select("instrument_id", "trade_date", F.col("set").alias("set_no"), F.round("loglik", 6).alias("loglik"))


# --- sequence model, whole plan -----------------------------------------------------------------------------------


def _training(spark, d) -> DataFrame:
    return ngrams.training_rows(ngrams.fold(_counted(spark, d)), LONGEST, 1e-4)


@register()
def kraus_score(spark, d):
    scored = kraus.score(_training(spark, d), kraus.KrausModel.random(SYMBOLS * SYMBOLS, 4, seed=7))
    return scored.select(F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"), "emp_prob", "prob")


@register()
def kraus_loss(spark, d):
    """Losses before and after some training steps."""
    rows = _training(spark, d).repartition(8).cache()
    start = kraus.KrausModel.random(SYMBOLS * SYMBOLS, 4, seed=7)
    after, _ = kraus.fit(rows, start, steps=5)
    result = None
    for name, model in (("before", start), ("after", after)):
        s = kraus.score(rows, model)
        p, e = F.col("prob"), F.col("emp_prob")
        one = s.agg(kraus.likelihood_loss(p, e).alias("nll"), kraus.square_loss(p, e).alias("mse"), kraus.total_square_loss(p, e).alias("total")).withColumn("model", F.lit(name))
        result = one if result is None else result.unionByName(one)
    return result




_PATH = {"tvi_n": "tvi_n", "obi_L1": "obi_l1", "ofi_L1_n_norm": "o1_norm", "ofi_L3_norm_n": "o3_n", "ofi_L10_norm_n": "o10_n", "ofi_L1_n": "o1_sum", "ofi_L1_norm_n": "o1_n", "micro_price": "micro"}


def _path_sql(block: int, longest: int) -> str:
    """The active path from events to folded distributions, each step from its definition; falling level weights exp(-k / 3)."""
    weight = {n: [f"(exp(-{k}e0 / 3) / ({' + '.join(f'exp(-{j}e0 / 3)' for j in range(n))}))" for k in range(n)] for n in (1, 3, 10)}
    flow = {n: " + ".join(f"{w} * coalesce({flow_sql(k)}, 0e0)" for k, w in enumerate(weight[n])) for n in weight}
    depth = {n: "greatest(" + " + ".join(f"{w} * (bid_sz_{k:02d} + ask_sz_{k:02d})" for k, w in enumerate(weight[n])) + ", 1e-12)" for n in weight}
    by, feature = f"{_BY}, feature", f"{PART}, feature"
    ewma, grow = _EWMA.replace(PART, feature), _GROW.replace(PART, feature)
    next_ = f"PARTITION BY {_BY}, predictor ORDER BY sample_idx"
    grams = " UNION ALL ".join(
        f"SELECT instrument_id, predictor, {n} AS length, {' || chr(44) || '.join(f'CAST(lag(sym, {k}) OVER ({next_}) AS VARCHAR)' for k in reversed(range(n)))} AS seq, cls, row_number() OVER ({next_}) AS place FROM cb" for n in range(1, longest + 1)
    )
    share = "sum(count(*)) OVER (PARTITION BY instrument_id, predictor, length)"
    return f"""{SIGN}, a0 AS (SELECT *, {', '.join(f'{flow[n]} AS o{n}, {depth[n]} AS d{n}' for n in weight)}, bid_sz_00 + ask_sz_00 AS dep, ln((bid_px_00 + ask_px_00) / 2) AS log_mid, row_number() OVER ({ROWS}) - 1 AS event_idx FROM tr),
a1 AS (SELECT *, {', '.join(f"{trailing(f'o{n}', 10)} / greatest({trailing(f'd{n}', 10)}, 1e-12) AS o{n}_n" for n in weight)}, {trailing('o1', 10)} AS o1_sum,
  avg(dep) OVER ({ROWS} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS dep_mean, {trailing('trade_buy_vol_event', 10, 10)} AS tb, {trailing('trade_sell_vol_event', 10, 10)} AS ts FROM a0),
a2 AS (SELECT {_BY}, event_idx // {block} AS sample_idx, log_mid, coalesce((tb - ts) / nullif(tb + ts, 0), 0) AS tvi_n, (bid_sz_00 - ask_sz_00) / (bid_sz_00 + ask_sz_00) AS obi_l1,
  coalesce(o1_sum / nullif(dep_mean, 0), 0) AS o1_norm, o1_n, o3_n, o10_n, o1_sum, bid_sz_00 / (bid_sz_00 + ask_sz_00) * ask_px_00 + (1 - bid_sz_00 / (bid_sz_00 + ask_sz_00)) * bid_px_00 AS micro
  FROM a1 WHERE event_idx % {block} = {block - 1}),
src AS ({' UNION ALL '.join(f"SELECT {_BY}, sample_idx, '{name}' AS feature, {c} AS x FROM a2" for name, c in {'log_mid': 'log_mid', **_PATH}.items())}), {ewma}, {grow},
lc AS (SELECT {_BY}, sample_idx, CASE WHEN f > 4.15e-5 THEN 1 WHEN f < -4.15e-5 THEN -1 ELSE 0 END AS cls FROM (SELECT {_BY}, sample_idx, lead(log_mid) OVER ({NEXT}) - log_mid AS f FROM a2)),
cb AS MATERIALIZED (SELECT {_BY}, sample_idx, q.feature AS predictor, p.sym + 4 * q.sym AS sym, cls FROM sy p JOIN sy q USING ({_BY}, sample_idx) JOIN lc USING ({_BY}, sample_idx) WHERE p.feature = 'log_mid' AND q.feature <> 'log_mid'),
gm AS (SELECT * FROM ({grams}) WHERE place >= length),
fo AS (SELECT instrument_id, predictor, length, seq, count(*) AS cnt, CAST({share} AS BIGINT) AS whole, count(*) / {share} AS prob,
  count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = -1) AS n2 FROM gm GROUP BY instrument_id, predictor, length, seq)
SELECT instrument_id, predictor, length, seq, cnt, whole AS total, round(prob, 9) AS prob, 'sequence' AS kind FROM fo
{" ".join(f"UNION ALL SELECT instrument_id, predictor, length, seq, n{i}, cnt, round(n{i} / cnt, 9), 'class {c}' FROM fo" for i, c in enumerate(ngrams.CLASSES))}"""


@register(_path_sql(10, 6))
def period_pipeline(spark, d):
    """The whole active path, growing bins included, of all predictors, folded over all days by instrument: rows of kind
    sequence, and of each class how often a sequence's last row has it, of how many, and that share."""
    s = daily.Settings(frequency=10, regular_hours=False, vpin_volume=1000, vpin_buckets=3, decimals=9)
    seq, cls = daily.period_plan(view(spark, d), "log_mid", list(_PATH), s)
    by = ("instrument_id", "predictor")
    one = F.explode(F.array(*(F.struct(F.get("class_counts", F.lit(i)).alias("cnt"), F.get("class_probs", F.lit(i)).alias("prob"), F.lit(f"class {c}").alias("kind")) for i, c in enumerate(ngrams.CLASSES))))
    cls = cls.withColumn("one", one).select(*by, "length", "seq", "one.cnt", "total", "one.prob", "one.kind")
    return _seq(seq.withColumn("kind", F.lit("sequence")).select(*cls.columns).unionByName(cls), "cnt", "total", F.round("prob", 9).alias("prob"), "kind", by=by)
