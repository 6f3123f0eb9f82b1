"""Definitions restated in pandas, hand-computed values and properties."""

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.series import Order, ln, rolling
from tickloom.operators import bars, dependence, encode, kraus, labels, ngrams, orderflow
from tickloom.plans import daily, queries
from tickloom.sources import lob

ONE = Order(("k",), ("i",))


def series(spark, values, name="x"):
    return spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(values)], f"k int, i long, {name} double")


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_rolling_needs_non_null_values(spark):
    df = rolling(series(spark, [1.0, None, 3.0, 4.0, 5.0]), {"s": ("x", 3, 2)}, ONE)
    assert column(df, "s") == [None, None, 4.0, 7.0, 12.0]


def test_logarithms_are_the_nearest_doubles(spark):
    x = [100 + 0.005 * i for i in range(4000)] + [100.14, 100.13999999999999, 0.5, 5e-324, 1e308]
    y = column(series(spark, x).withColumn("y", ln("x")), "y")
    assert max(abs((Decimal(b) - Decimal(a).ln()) / Decimal(math.ulp(b))) for a, b in zip(x, y, strict=True)) < 0.501  # 0.504 at 100.14 by F.log
    assert column(series(spark, [1.0, 100.14, 100.13999999999999]).withColumn("y", ln("x")), "y") == [0.0] + [math.log(100.14)] * 2
    odd = column(series(spark, [0.0, -1.0, None, math.inf, math.nan]).withColumn("y", ln("x")), "y")
    assert odd[:4] == [None, None, None, math.inf] and math.isnan(odd[4])


@pytest.mark.parametrize("name", ["bivariate_symbols", "align_distr", "fold_sequence_distr", "fold_class_distr", "filter_distr", "discretised"])
def test_equal_prices_that_doubles_tell_apart_have_no_return(name, spark, tmp_path):
    """Events whose mid prices are 100.14 and the double below it in turn, by which Spark's logarithms differ and C's don't."""
    import duckdb

    duckdb.sql(
        f"""COPY (SELECT CAST(CASE WHEN range % 8 < 4 THEN 18 ELSE 49 END + 102 * range AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * range AS ts,
        CAST(range // 50 AS BIGINT) AS user_id, 'view' AS event_type, 1e0 AS value, '' AS props FROM range(200)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_predictive_zscore(spark):
    z = column(encode.zscore_predictive(series(spark, [1.0, 2, 4, 7, 11, 16]), "x", 0.05, order=ONE), "x_z")
    assert [v is None or math.isnan(v) for v in z[:3]] == [True] * 3
    assert np.allclose(z[3:], [5.189757, 5.781680, 5.441302], atol=1e-6)


def test_encoding_is_causal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60).cumsum().tolist()
    a = column(encode.encode(series(spark, x), "x", order=ONE, fill="none"), "x_sym")
    b = column(encode.encode(series(spark, x[:40] + [99.0] * 20), "x", order=ONE, fill="none"), "x_sym")
    assert a[:40] == b[:40] and set(a) <= {-1, 0, 1, 2, 3}


def test_encode_rejects_unknown_modes(spark):
    with pytest.raises(ValueError):
        encode.encode(series(spark, [1.0]), "x", mode="other", order=ONE)
    with pytest.raises(ValueError):
        encode.expanding_symbols(series(spark, [1.0]), "x", 1, order=ONE)


def test_ngrams_by_hand(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([0, 1, 0, 1])], "k int, i long, s int")
    got = {(r.length, tuple(r.seq)): (r.cnt, r.total) for r in ngrams.counts(df, "s", 6, ONE).collect()}
    assert got == {
        (1, (0,)): (2, 4), (1, (1,)): (2, 4), (2, (0, 1)): (2, 3), (2, (1, 0)): (1, 3), (3, (0, 1, 0)): (1, 2), (3, (1, 0, 1)): (1, 2), (4, (0, 1, 0, 1)): (1, 1),
    }


def test_class_probabilities_of_the_fixture(spark):
    day = spark.createDataFrame([(1, [0], [800, 1278, 1332]), (1, [0], [52, 0, 0])], "length int, seq array<int>, class_counts array<bigint>")
    r = ngrams.fold_classes(day).first()
    assert r.total == 3462 and list(r.class_counts) == [852, 1278, 1332]
    assert np.allclose(r.class_probs, [0.24610051993067592, 0.36915077989601386, 0.3847487001733102], atol=1e-15)


def test_fold_equals_recount_and_shares_sum_to_one(spark, sf):
    df = bars.event_bars(orderflow.event_features(lob.book_view(spark, sf), 4, 8), 2)
    df = df.withColumn("s", F.pmod(F.col("sequence"), F.lit(3)).cast("int"))
    per_day = ngrams.counts(df, "s", 3)
    whole = ngrams.fold(per_day)
    again = ngrams.fold(ngrams.fold(per_day, ["instrument_id"]))
    key = lambda t: sorted((r.length, tuple(r.seq), r.cnt, r.total) for r in t.collect())
    assert key(whole) == key(again)
    assert all(abs(r.s - 1) < 1e-12 for r in whole.groupBy("length").agg(F.sum("prob").alias("s")).collect())


def test_volume_bars_repeat_a_row_that_crosses_twice(spark):
    df = spark.createDataFrame([(0, 0, 4.0, 0.0, 0), (0, 1, 25.0, 0.0, 1), (0, 2, 3.0, 0.0, 0)], "k int, i long, trade_buy_vol_event double, trade_sell_vol_event double, mid_changed int")
    got = bars.volume_bars(df, 10, ONE).orderBy("sample_idx").collect()
    assert [(r.i, r.volume_threshold, r.events_in_bucket) for r in got] == [(1, 10.0, 2), (1, 20.0, 0), (2, 30.0, 1)]
    assert got[1].move_rate_per_share is None


def test_invalid_arguments(spark):
    df = series(spark, [1.0])
    with pytest.raises(ValueError):
        bars.event_bars(df, 2, "middle", ONE)
    with pytest.raises(ValueError):
        orderflow.flow_level(df, 10)
    with pytest.raises(ValueError):
        labels.class_label(df, "c1", order=ONE)
    with pytest.raises(KeyError):
        labels.class_label(df, "c3", order=ONE)
    with pytest.raises(ValueError):
        daily.featured_bars(df, daily.Settings(resampling="ticks"))


def test_markov_chain_has_little_transfer_entropy_beyond_one_step(spark):
    rng = np.random.default_rng(42)
    p = rng.dirichlet(np.ones(5) * 0.3, 5)
    x = [0]
    for _ in range(1999):
        x.append(int(rng.choice(5, p=p[x[-1]])))
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, i long, x int")
    mi = dependence.mutual_information(df, "x", "x", [1], order=ONE).first().value
    te = max(r.value for r in dependence.self_transfer_entropy(df, "x", 4, ONE).collect())
    assert mi > 0.3 and te < 0.1 * mi


def test_cross_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(0, i, 1.0, float(i % 3)) for i in range(12)], "k int, i long, x double, y double")
    assert {r.value for r in dependence.cross_correlation(df, "x", "y", 2, ONE).collect()} == {0.0}


def test_kraus_probabilities_are_a_distribution(spark):
    model = kraus.KrausModel.random(3, 2, seed=1)
    assert model.residual() < 1e-12
    seqs = [[a, b] for a in range(3) for b in range(3)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq array<int>")
    p = {tuple(r.seq): r.prob for r in kraus.score(df, model).collect()}
    assert abs(sum(p.values()) - 1) < 1e-12
    assert all(abs(model.path(list(s))[1] - v) < 1e-12 for s, v in p.items())


def test_kraus_training_lowers_the_loss(spark):
    df = spark.createDataFrame([([0, 1], 0.5), ([1, 0], 0.4), ([2], 0.1)], "seq array<int>, emp_prob double")
    model, losses = kraus.fit(df, kraus.KrausModel.random(3, 2, seed=2), steps=4)
    assert losses[-1] < losses[0] and model.residual() < 1e-10


def test_null_quotes_fill_forward_and_unquoted_rows_go(spark):
    df = spark.createDataFrame([(0, 0, None, None), (0, 1, 1.0, 2.0), (0, 2, None, float("nan"))], "k int, i long, bid_px_00 double, ask_px_00 double")
    got = [(r.bid_px_00, r.ask_px_00) for r in orderflow.drop_unquoted(df, ONE).orderBy("i").collect()]
    assert got == [(1.0, 2.0), (1.0, 2.0)]


def test_causal_vpin_does_not_look_ahead(spark, sf):
    df = orderflow.trade_signs(lob.book_view(spark, sf)).where("instrument_id = 0")
    a = orderflow.vpin(df, 500, 2, causal=True).select("trade_date", "sequence", "vpin").toPandas().set_index("sequence")
    middle = int(df.agg(F.percentile("sequence", F.lit(0.5))).first()[0])
    later = df.withColumns({c: F.when(F.col("sequence") > middle, F.lit(9.0)).otherwise(F.col(c)) for c in ("trade_buy_vol_event", "size")})
    b = orderflow.vpin(later, 500, 2, causal=True).select("sequence", "vpin").toPandas().set_index("sequence").vpin
    past = a.index[a.index <= middle]
    assert a.vpin.notna().any() and a.vpin.isna().any() and len(past) > 100
    same = (a.vpin[past] == b[past]) | (a.vpin[past].isna() & b[past].isna())
    assert same.all()


@pytest.mark.parametrize(("kind", "frequency", "predictor"), [("seconds", 60, "imbalance"), ("volume", 400, "trade_ofi_n")])
def test_plan_over_clock_and_volume_bars(spark, sf, kind, frequency, predictor):
    day = lob.book_view(spark, sf).where("instrument_id = 0").where(F.dayofmonth("trade_date") < 4)
    s = daily.Settings(frequency=frequency, resampling=kind, regular_hours=False, longest=3)
    made = daily.featured_bars(day, s).select(*bars.BARS.keys, "sample_idx", "log_mid", predictor, "log_mid_return_fwd_1").cache()
    seq, cls = daily.period_plan(day, "log_mid", [predictor], s)
    rows = seq.collect()
    assert made.count() > 20 and {r.length for r in rows} == {1, 2, 3}
    per_day = {r.trade_date: r["count"] for r in made.groupBy("trade_date").count().collect()}
    for n in (1, 2, 3):  # every bar of a day ends one sequence of each length, but for its first
        assert sum(r.cnt for r in rows if r.length == n) == sum(max(c - n + 1, 0) for c in per_day.values())
    assert {r.total for r in cls.where("length = 1").agg(F.sum("total").alias("total")).collect()} == {made.count()}


def test_store_and_read_distributions(spark, tmp_path):
    df = spark.createDataFrame([(1, [0], 2, 2, 1.0)], "length int, seq array<int>, cnt long, total long, prob double")
    lob.write_distribution(daily.labelled_period(df, "S", "log_mid", "tvi_n", "202401"), str(tmp_path / "d"))
    assert lob.read_distribution(spark, str(tmp_path / "d"), predictor="tvi_n").count() == 1


def test_zstd_csv(spark, tmp_path):
    import zstandard
    from pyspark.sql import types as T

    text = "ts_event,price\n1,1.5\n2,2.5\n"
    (tmp_path / "x-20250102.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    got = lob.read_zstd_csv(spark, str(tmp_path), T.StructType().add("ts_event", T.LongType()).add("price", T.DoubleType())).collect()
    assert [(r.ts_event, r.price, str(r.trade_date)) for r in got] == [(1, 1.5, "2025-01-02"), (2, 2.5, "2025-01-02")]


def test_resampled_mean_weighs_fine_buckets_alike(spark):
    ts = pd.DatetimeIndex(["2024-01-01 00:00:00.0", "2024-01-01 00:00:00.5", "2024-01-01 00:00:03.0"])
    df = spark.createDataFrame([(0, i, t.to_pydatetime(), v) for i, (t, v) in enumerate(zip(ts, [1.0, 3.0, 5.0], strict=True))], "k int, i long, ts_event timestamp, x double")
    got = bars.resample(df, "x", 2, "mean", Order(("k",), ("ts_event", "i")), first=0.5).orderBy("bucket_start").collect()
    want = pd.Series([1.0, 3, 5], ts).resample("500ms").mean().ffill().resample("2s").mean()
    assert np.allclose([r.x for r in got], want.to_numpy())


def test_book_round_trip(spark, tmp_path):
    from datetime import datetime

    rows = [(7, datetime(2024, 1, d, 15, 0), d, "T") for d in (2, 3)]
    df = spark.createDataFrame(rows, "instrument_id long, ts_event timestamp, sequence long, action string").withColumn("trade_date", F.to_date("ts_event"))
    lob.write_book(df, str(tmp_path / "book"))
    back = lob.read_book(spark, str(tmp_path / "book")).where("trade_date = date'2024-01-03'")
    assert [(r.sequence, r.bid_px_00) for r in back.collect()] == [(3, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_session_filters_do_not_read_the_session_zone(spark, sf, zone):
    want = {}
    for z in ("UTC", zone):
        spark.conf.set("spark.sql.session.timeZone", z)
        try:
            day = lob.book_view(spark, sf)
            instants = day.withColumn("ts_event", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("sequence") * 7_000_000))
            got = [f(x).agg(F.count("*"), F.sum("sequence")).first() for x in (day, instants) for f in (orderflow.regular_hours, orderflow.fixed_offset_hours)]
            gaps = orderflow.event_features(day, 5, 9).agg(F.round(F.sum("dt_block_sec"), 3)).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        want.setdefault("rows", (got, gaps))
        assert want["rows"] == (got, gaps) and all(r[0] > 0 for r in got)


def test_trailing_sums_forget_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    for odd in (nan, inf, -inf):
        got = column(rolling(series(spark, [1.0, 1.0, odd, 1.0, 1.0, 1.0]), {"s": ("x", 2, 1)}, ONE), "s")
        assert got == [1.0, 2.0, 1.0, 1.0, 2.0, 2.0]
    got = column(rolling(series(spark, [1.0, 1.0, 1e17, 1.0, 1.0, 1.0]), {"s": ("x", 2, 2)}, ONE), "s")
    assert got[0] is None and got[1] == 2.0 and got[4:] == [2.0, 2.0]


def test_dependence_ignores_values_that_are_not_finite(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=80).tolist(), rng.normal(size=80).tolist()
    clean = [(0, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    odd = clean + [(0, 80, float("inf"), 1.0), (0, 81, 1.0, float("-inf")), (0, 82, float("nan"), 0.0), (0, 83, None, 0.0)]
    for fn in (lambda d: dependence.cross_correlation(d, "x", "y", 2, ONE), lambda d: dependence.histogram_information(d, "x", "y", [0], 5, ONE)):
        a, b = (
            {r.lag: r.value for r in fn(spark.createDataFrame(rows, "k int, i long, x double, y double")).collect()} for rows in (clean, odd)
        )
        assert a.keys() == b.keys() and all(math.isfinite(v) for v in b.values())
        assert np.allclose([a[k] for k in a], [b[k] for k in a])
    assert all(math.isfinite(r.value) for r in dependence.autocorrelation(spark.createDataFrame(odd, "k int, i long, x double, y double"), "x", 3, ONE).collect())


def test_sequences_in_order_and_sampled(spark):
    df = spark.createDataFrame([(0, i, int(c)) for i, c in enumerate("0120120011020210012")], "k int, i long, s int")
    counted = ngrams.counts(df, "s", 3, Order(("k",), ("i",)))
    rows = [(r.length, list(r.seq), r.cnt, r.first) for r in counted.collect()]
    for how, key in {"lexicographic": lambda r: (r[0], r[1]), "count": lambda r: (r[0], -r[2], r[1]), "first_seen": lambda r: (r[0], r[3])}.items():
        assert [(r.length, list(r.seq)) for r in ngrams.ordered(counted, how).collect()] == [r[:2] for r in sorted(rows, key=key)]
    with pytest.raises(ValueError):
        ngrams.ordered(counted, "other")
    told = lambda seed: sorted((r.length, tuple(r.seq)) for r in ngrams.sampled(counted, 0.4, ["k"], 1, seed).collect())
    some = told(0)
    assert some == told(0) and set(some) <= {(n, tuple(q)) for n, q, *_ in rows} and told(1) != some
    for n in (1, 2, 3):
        every = sum(r[0] == n for r in rows)
        assert sum(r[0] == n for r in some) == (every if n == 1 else max(1, round(every * 0.4)))


def test_ratio_of_sums_near_zero(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1e-13, 2.0, 0.0, 5.0])], "k int, sample_idx long, log_mid double")
    ratio = lambda zero: [r.log_mid_sum_ratio_1 for r in bars.targets(df, (1,), order=Order(("k",), ("sample_idx",)), zero_only=zero).orderBy("sample_idx").collect()]
    assert ratio(False) == [None, -1.0, None, None]
    assert ratio(True) == [(2.0 - 1e-13) / 1e-13, -1.0, None, None]
