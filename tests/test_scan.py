"""Blocked scans, long trailing sums and symbols against pandas and hand-computed values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scan, series
from tickloom.functions.scan import Ewm
from tickloom.functions.series import Order
from tickloom.operators import encode, orderflow

ONE = Order(("k",), ("i",))


def frame(spark, values, name="x"):
    return spark.createDataFrame([(0, i, None if v is None or v != v else float(v)) for i, v in enumerate(values)], f"k int, i long, {name} double")


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def alike(got, want):
    got, want = ([math.nan if v is None else v for v in x] for x in (got, want))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True)


def gappy(n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = 4.6 + rng.normal(size=n).cumsum() * 1e-3
    x[rng.random(n) < 0.2] = math.nan
    x[100:170] = math.nan
    return x


@pytest.mark.parametrize("alpha", [0.05, 0.6, 1.0, 1e-3])
@pytest.mark.parametrize("block", [7, 4096])
def test_recursive_means_equal_pandas(spark, monkeypatch, alpha, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    x = gappy()
    x[:3] = math.nan
    s = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=5)
    got = scan.ewm(frame(spark, x), {"m": Ewm("x", alpha, 5, previous=True)}, ONE)
    alike(column(got, "m"), s.mean())
    alike(column(got, "m_prev"), s.mean().shift(1))


@pytest.mark.parametrize("block", [7, 4096])
def test_debiased_deviations_equal_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    x = gappy()
    got = scan.ewm_deviation(frame(spark, x), {"m": Ewm("x", 0.05), "n": Ewm("x", 0.1, 9)}, ONE)
    alike(column(got, "m_sd"), pd.Series(x).ewm(alpha=0.05, adjust=False).std())
    want = pd.Series(x).ewm(alpha=0.1, adjust=False, min_periods=9)
    alike(column(got, "n"), want.mean())
    alike(column(got, "n_sd"), want.std())


def test_predictive_scores_of_many_features_equal_pandas(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    rng = np.random.default_rng(8)
    a, b = gappy(120), rng.normal(size=120)
    df = frame(spark, a, "a").join(frame(spark, b, "b"), ["k", "i"])
    got = encode.zscores_predictive(df, ["a", "b"], 0.05, order=ONE)
    for name, x in (("a", pd.Series(a)), ("b", pd.Series(b))):
        before = x.shift(1)
        mean = before.ewm(alpha=0.05, adjust=False, min_periods=2).mean()
        sd = ((before - mean) ** 2).ewm(alpha=0.05, adjust=False, min_periods=2).mean() ** 0.5
        alike(column(got, f"{name}_z"), (x - mean) / sd.clip(lower=1e-12))


def test_growing_quantiles_equal_pandas(spark):
    x = pd.Series(gappy(150)).round(4)
    df = frame(spark, x, "z").withColumn("w", -F.col("z"))
    got = encode.expanding_symbols(df, {"z": "a", "w": "b"}, 4, 3, ONE)
    for name, v in (("a", x), ("b", -x)):
        before = v.shift(1).expanding(3)
        edges = [before.quantile(i / 4) for i in (1, 2, 3)]
        want = sum((v >= e).astype(int) for e in edges).where(v.notna() & edges[0].notna(), -1)
        assert column(got, name) == want.tolist()


def test_long_trailing_sums(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, 700).astype(float)
    x[rng.random(700) < 0.1] = math.nan
    x[300] = 1e17
    got = series.rolling(frame(spark, x), {"a": ("x", 100, 1), "b": ("x", 100, 95), "c": ("x", 300, 1), "d": ("x", 5, 5)}, ONE)
    for name, n, least in (("a", 100, 1), ("b", 100, 95), ("c", 300, 1), ("d", 5, 5)):
        mine, want = column(got, name), []
        for i in range(700):
            w = x[max(0, i - n + 1) : i + 1]
            w = w[~np.isnan(w)]
            want.append(math.fsum(w) if len(w) >= least else None)
        assert [v is None for v in mine] == [v is None for v in want]
        clean = [(g, w) for i, (g, w) in enumerate(zip(mine, want, strict=True)) if w is not None and not 300 <= i < 300 + n]
        assert all(g == w for g, w in clean) and len(clean) > 100


def test_backward_fill_is_not_quadratic(spark):
    x = [None] * 30_000 + [5.0, None]
    df = frame(spark, x).withColumn("y", series.backward_fill("x", ONE))
    assert df.agg(F.count("y"), F.sum("y")).first()[:] == (30_001, 150_005.0)


def test_five_symbols_by_hand(spark):
    # flat: the deviation is 0 and the value at the lower bound; the first value has no deviation
    assert column(encode.five_symbols(frame(spark, [1.0, 1.0, 1.0, 2.0, 1.5]), "x", order=ONE), "x_sym")[:4] == [0, -2, -2, 2]
    # alpha 0.5: means 0, 2, deviations none, sqrt(8) (weights 1/2, 1/2: variance 4 / (1 - 1/2)); distance 2 lies within
    assert column(encode.five_symbols(frame(spark, [0.0, 4.0]), "x", 0.5, 0.5, ONE), "x_sym") == [0, 1]
    assert column(encode.five_symbols(frame(spark, [0.0, None, 4.0]), "x", 0.5, 0.5, ONE), "x_sym")[1] == 0


def test_band_symbols_by_hand(spark):
    x = [1.0, 2.0, 3.0, 2.5, None, 9.0]
    s = pd.Series(x)
    mean, sd = s.ewm(alpha=0.25, adjust=False).mean(), s.rolling(8, min_periods=1).std().fillna(0.0)
    want = [-1 if v != v else 0 if v < m - d else 1 if v < m else 2 if v < m + d else 3 for v, m, d in zip(s, mean, sd, strict=True)]
    assert column(encode.band_symbols(frame(spark, x), "x", deviation="rolling", order=ONE), "x_sym") == want
    assert want[0] == 3 and want[4] == -1
    # alpha 0.5: means 0, 2, deviation sqrt(8): 4 is in the upper half
    assert column(encode.band_symbols(frame(spark, [0.0, 4.0]), "x", 0.5, order=ONE), "x_sym") == [3, 2]


def test_gaussian_symbols_where_there_is_no_score(spark):
    x = frame(spark, [1.0, 2.0, 4.0, 3.0])
    plain = column(encode.gaussian_symbols(x, "x", min_periods=3, order=ONE), "x_sym")
    legacy = column(encode.gaussian_symbols(x, "x", min_periods=3, legacy_offset=True, order=ONE), "x_sym")
    assert plain[:2] == [-1, -1] and legacy[:2] == [2, 2]
    assert [a - 1 for a in plain[2:]] == legacy[2:]


def test_fills_leave_symbols_of_minus_one(spark):
    x = [1.0, 2.0, 4.0, 3.0, None, 7.0, None]
    z = column(encode.encode(frame(spark, x), "x", fill="none", order=ONE), "x_z")
    for fill in ("ffill", "bfill_ffill"):
        got = encode.encode(frame(spark, x), "x", fill=fill, order=ONE)
        assert column(got, "x_sym")[0] == -1 and column(got, "x_sym")[-1] == -1
        assert z[-1] is None and column(got, "x_z")[-1] == z[5]
    assert column(encode.encode(frame(spark, x), "x", fill="bfill", order=ONE), "x_sym")[0] >= 0


def test_strict_flow_stays_null_where_it_is_not_defined(spark):
    rows = [(0, i, 10.0, 11.0, float(5 + i), 5.0, "A", "N", 1.0, 10.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, i long, bid_px_00 double, ask_px_00 double, bid_sz_00 double, ask_sz_00 double, action string, side string, size double, price double")
    strict = orderflow.trade_imbalance(orderflow.trade_signs(orderflow.flow_imbalance(df, 2, ONE, strict=True), ONE), 2, ONE, strict=True)
    assert column(strict, "ofi_L1") == [None, 1.0, 1.0, 1.0] and column(strict, "ofi_L1_n") == [None, None, 2.0, 2.0]
    assert column(strict, "trade_ofi_n") == [None] * 4
    assert column(orderflow.flow_imbalance(df, 2, ONE), "ofi_L1_n") == [0.0, 1.0, 2.0, 2.0]
