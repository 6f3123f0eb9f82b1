"""Nearest neighbours, histogram transfer entropy and conditional variance against brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.series import Order
from tickloom.operators import dependence, neighbours, profile, volatility

ONE = Order(("k",), ("i",))


def two(spark, x, y, k=0):
    return spark.createDataFrame([(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, i long, x double, y double")


# --- neighbours -----------------------------------------------------------------------------------------------------


def _information(x, y, k):
    whole = lambda c: np.rint(c / (c.std() or 1) * 2.0**32).astype(np.int64)
    u, v = whole(x), whole(y)
    du, dv = abs(u[:, None] - u), abs(v[:, None] - v)
    np.fill_diagonal(du, 2**62)
    d = np.sort(np.maximum(du, dv), 1)[:, k - 1][:, None]
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    near = lambda a: np.mean([psi(n + 1) for n in (np.where(d > 0, a < d, a == 0)).sum(1)])
    return max(0.0, psi(len(x)) + psi(k) - near(du) - near(dv))


def _clouds(n=600):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=n) * 1e-6, rng.standard_cauchy(n), np.repeat(rng.normal(size=20), 15), [1e7, -3e5]])
    y = np.concatenate([rng.normal(size=n) * 1e-6, rng.standard_cauchy(n), np.repeat(rng.normal(size=20), 15), [1e-9, 4e8]])
    return x, y + 0.5 * np.clip(x, -3, 3)


@pytest.mark.parametrize("tile", [4096, 16])
def test_neighbour_information_of_dense_sparse_and_repeated_points(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    x, y = _clouds()
    got = neighbours.neighbour_information(two(spark, x, y), "x", "y", [0], 5, ONE).first()
    assert got.pairs == len(x) and abs(got.value - _information(x, y, 5)) < 1e-9


def test_pairs_made_for_neighbours_grow_as_the_points_do(spark):
    x, y = _clouds(1500)
    points = neighbours._lattice(two(spark, x, y).withColumn("lag", F.lit(0)).select("k", "lag", "x", "y"), ["k", "lag"])
    celled = neighbours._celled(points, ["k", "lag"], 5).toPandas()
    met = 0
    for t, asking in celled.groupby("t"):
        cells = collections.Counter(zip(celled.a.astype(int).to_numpy() >> t, celled.b.astype(int).to_numpy() >> t, strict=True))
        for a, b in zip(asking.a.astype(int).to_numpy() >> t, asking.b.astype(int).to_numpy() >> t, strict=True):
            met += sum(cells[a + i, b + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    assert met < 300 * len(celled)


def test_neighbour_information_of_few_points_and_odd_values(spark):
    df = two(spark, [1, 2, 3, float("nan"), float("inf"), 4], [1, 2, 3, 4, 5, 6])
    got = neighbours.neighbour_information(df, "x", "y", [0], 5, ONE).first()
    assert (got.value, got.pairs) == (None, 4)
    same = neighbours.neighbour_information(two(spark, [2] * 12, [7] * 12), "x", "y", [0], 5, ONE).first()
    assert abs(same.value - max(0, _information(np.full(12, 2.0), np.full(12, 7.0), 5))) < 1e-9


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 60).select(neighbours.digamma(F.col("id")).alias("p")).collect()]
    want = [-0.5772156649015329 + sum(1 / i for i in range(1, n)) for n in range(1, 60)]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


# --- histogram transfer entropy -------------------------------------------------------------------------------------


def _transfer(x, y, delay, sigma=None):
    n = len(x) - delay
    iqr = lambda c: float(np.subtract(*np.percentile(c, [75, 25]))) or 1e-8
    bx, by = (max(1, min(int((c.max() - c.min()) / (2 * iqr(c) / len(c) ** (1 / 3))), 64)) for c in (x, y))
    f, q, p = x[delay:], y[:-delay], x[:-delay]
    p3 = np.histogramdd(np.array([f, q, p]).T, [bx, by, bx])[0] / n
    p2, pd = np.histogramdd(np.array([f, q]).T, [bx, by])[0] / n, np.histogramdd(np.array([f, p]).T, [bx, bx])[0] / n
    p1 = np.histogram(f, bx)[0] / n
    if sigma:
        r = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)

        def smooth(a):
            for axis in range(a.ndim):
                m = np.zeros((a.shape[axis],) * 2)
                for i in range(a.shape[axis]):
                    for d, v in zip(range(-r, r + 1), w / w.sum(), strict=True):
                        j = (i + d) % (2 * a.shape[axis])
                        m[min(j, 2 * a.shape[axis] - 1 - j), i] += v
                a = np.moveaxis(np.tensordot(m, a, (1, axis)), 0, axis)
            return a

        p1, p2, pd, p3 = map(smooth, (p1, p2, pd, p3))
    some = p3 > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        return float((p3 * np.log2(p3 * p1[:, None, None] / (p2[:, :, None] * pd[:, None, :])))[some].sum())


def _driven(n=400):
    rng = np.random.default_rng(1)
    y = rng.normal(size=n)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = 0.5 * x[t - 1] + y[t - 1] + 0.2 * rng.normal()
    return x, y


@pytest.mark.parametrize(("delay", "sigma"), [(1, None), (3, None), (1, 0.7), (2, 2.5)])
def test_histogram_transfer_entropy(spark, delay, sigma):
    x, y = _driven()
    got = dependence.histogram_transfer_entropy(two(spark, x, y), "x", "y", delay, sigma=sigma, order=ONE).first().value
    assert abs(got - _transfer(x, y, delay, sigma)) < 1e-9


def test_transfer_entropy_where_the_quartiles_are_equal(spark):
    x, y = _driven(200)
    x[x < 1.2] = 0.0  # most values alike: as many bins as there may be
    got = dependence.histogram_transfer_entropy(two(spark, x, y), "x", "y", order=ONE).first().value
    assert abs(got - _transfer(x, y, 1)) < 1e-9


def test_steps_and_lags(spark):
    x, _ = _driven(150)
    got = {(r.step, r.lag): r.value for r in dependence.step_lag_entropy(two(spark, x, x), "x", 2, 3, sigma=0.5, order=ONE).collect()}
    assert len(got) == 6
    for (step, lag), value in got.items():
        assert abs(value - _transfer(x[lag + step :], x[: len(x) - lag - step], 1, 0.5)) < 1e-9


# --- conditional variance -------------------------------------------------------------------------------------------


def _recursion(r, omega, alpha, beta):
    e = r - r.mean()
    w = 0.94 ** np.arange(min(75, len(e)))
    v = [omega + (alpha + beta) * float((w * e[: len(w)] ** 2).sum() / w.sum())]
    for x in e[:-1]:
        v.append(omega + alpha * x * x + beta * v[-1])
    return e, np.array(v)


def _loglik(r, *p):
    e, v = _recursion(r, *p)
    return float(-0.5 * (np.log(2 * np.pi) + np.log(v) + e * e / v).sum())


def _clustered(n, seed):
    rng, v, out = np.random.default_rng(seed), 1e-6, []
    for _ in range(n):
        out.append(math.sqrt(v) * rng.normal())
        v = 2e-7 + 0.25 * out[-1] ** 2 + 0.6 * v
    return np.array(out)


def returns(spark, *series):
    return spark.createDataFrame([(k, i, float(v)) for k, s in enumerate(series) for i, v in enumerate(s)], "k int, i long, ret double")


@pytest.mark.parametrize("block", [16, 4096])
def test_conditional_variance_is_the_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    r = _clustered(300, 2)
    got = [x.variance for x in volatility.conditional_variance(returns(spark, r), "ret", 1e-7, 0.2, 0.7, ONE).orderBy("i").collect()]
    assert np.allclose(got, _recursion(r, 1e-7, 0.2, 0.7)[1], rtol=1e-10)
    with pytest.raises(ValueError):
        volatility.conditional_variance(returns(spark, r), "ret", 1e-7, 0.2, 1.0, ONE)


def test_fit_is_as_likely_as_a_fine_grid(spark):
    data = [_clustered(500, 5), _clustered(400, 6), np.zeros(20)]
    got = {x.k: x for x in volatility.fit_conditional_variance(returns(spark, *data), "ret", ONE).collect()}
    assert set(got) == {0, 1}  # nothing to fit in a constant series
    for k, x in got.items():
        v = data[k].var()
        grid = max(_loglik(data[k], s * (1 - a - b) * v, a, b) for s in (0.5, 0.7, 1, 1.4, 2) for a in np.arange(0, 0.6, 0.05) for b in np.arange(0, 0.95, 0.05) if a + b < 0.999)
        assert x.loglik > grid - 0.05 and abs(_loglik(data[k], x.omega, x.alpha, x.beta) - x.loglik) < 1e-6


def test_summed_returns_fill_gaps_with_zero(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    ticks = [(0.0, 1.0), (0.004, 3.0), (0.5, 5.0), (3.2, 9.0)]
    df = spark.createDataFrame([(0, i, t0 + timedelta(seconds=s), v) for i, (s, v) in enumerate(ticks)], "k int, i long, ts_event timestamp, x double")
    got = volatility.summed_returns(df, "x", 1, Order(("k",), ("ts_event", "i"))).orderBy("bucket_start").collect()
    assert [r.ret for r in got] == [3.0, 0.0, 0.0, 4.0]  # fine means 2, 5, 9


# --- two scales by bucket ---------------------------------------------------------------------------------------------


def _dense(ticks, seconds, grid):
    """bucket: log prices of all its slots."""
    slots, out, x = collections.defaultdict(list), collections.defaultdict(list), None
    for t, p in ticks:
        if p is not None and p > 0:
            slots[t // grid].append(p)
    for i in range(min(slots), max(slots) + 1):
        x = math.log(np.mean(slots[i])) if i in slots else x
        out[i * grid // (seconds * 1_000_000)].append(x)
    return out


@pytest.mark.parametrize("k", [None, 2, 7, 400])
def test_two_scales_by_bucket_equal_a_grid_with_every_slot(spark, k):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.integers(0, 9_000_000, 300), rng.integers(31_000_000, 33_400_000, 400), [33_990_000, 33_999_999, 34_000_000]])
    ticks = [(int(t), float(p)) for t, p in zip(sorted(at), np.exp(rng.normal(size=len(at)) * 0.01 + 3), strict=True)]
    ticks[50], ticks[51] = (ticks[50][0], None), (ticks[51][0], -1.0)
    df = spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate(ticks)], "k int, i long, us long, p double").withColumn("ts_event", F.timestamp_micros("us"))
    order = Order(("k",), ("ts_event", "i"))
    rv = {r.b: r.tsrv for r in volatility.two_scale_buckets(df, "p", 2, order, k).select((F.unix_micros("bucket_start") / 2_000_000).cast("int").alias("b"), "tsrv").collect()}
    mp = {r.b: r.tsmp for r in volatility.two_scale_mean_buckets(df, "p", 2, order, k).select((F.unix_micros("bucket_start") / 2_000_000).cast("int").alias("b"), "tsmp").collect()}
    want = {b: np.array(x) for b, x in _dense(ticks, 2, 10_000).items()}
    assert rv.keys() == want.keys() and len(want) == 18
    for b, x in want.items():
        n, j = len(x), max(2, min(k or 20, len(x) - 1))
        if n < 3:
            assert rv[b] is None
        else:
            subs = [np.diff(x[m::j]) for m in range(j) if len(x[m::j]) > 1]
            rv_ = np.mean([(s * s).sum() for s in subs]) - np.mean([len(s) for s in subs]) / (n - 1) * (np.diff(x) ** 2).sum()
            assert abs(rv[b] - rv_) < 1e-12
        j = k or 20
        assert (b in mp) == (n >= j)
        if n >= j:
            subs = [x[m::j] for m in range(n - j + 1)]
            assert abs(mp[b] - (np.mean([s.mean() for s in subs]) - np.mean([len(s) for s in subs]) / n * x.mean())) < 1e-9


def test_two_scales_by_bucket_of_nothing(spark):
    df = spark.createDataFrame([], "instrument_id int, trade_date date, ts_event timestamp, sequence long, p double")
    assert volatility.two_scale_buckets(df, "p", 1).count() == 0 and volatility.two_scale_mean_buckets(df, "p", 1).count() == 0


# --- all lag measures in one table --------------------------------------------------------------------------------------


def test_profile_equals_each_measure_of_its_own(spark):
    rng = np.random.default_rng(11)
    n, far = 240, 4
    x = np.concatenate([rng.normal(size=n), np.full(60, 2.0)])
    y = np.roll(x, 1) * 0.7 + rng.normal(size=len(x))
    rows = [(int(k), i, float(a), float(b), int(s), int(t)) for k, xs, ys in ((0, x, y), (1, x[-60:], y[-60:]), (2, x[:1], y[:1])) for i, (a, b, s, t) in enumerate(zip(xs, ys, np.digitize(xs, [-0.5, 0.5]), np.digitize(ys, [0]), strict=True))]
    rows[7], rows[9] = (0, 7, float("nan"), 1.0, 1, 1), (0, 9, None, 1.0, None, 1)
    rows[20] = (*rows[20][:4], -1, rows[20][5])
    df = spark.createDataFrame(rows, "k int, i long, x double, y double, a int, b int")
    got = profile.lag_profile(df, profile.Profile("x", "y", "a", "b", far, bins=5, matrix_bins=6), ONE).toPandas()
    assert not got.duplicated(["k", "measure", "lag", "ahead"]).any()
    sound = df.where("x is not null and not isnan(x)")
    lags = list(range(1, far + 1))
    own = {
        "correlation": dependence.cross_correlation(sound, "x", "y", far, ONE),
        "self_correlation": dependence.autocorrelation(sound, "x", far, ONE),
        "information": dependence.histogram_information(sound, "x", "y", list(range(-far, far + 1)), 5, ONE),
        "space_time": dependence.space_time_information(sound, "x", "y", far, far, 6, ONE).withColumnRenamed("back", "lag"),
        "symbol_information": dependence.mutual_information(sound, "a", "a", lags, order=ONE),
        "transfer": dependence.transfer_entropy(sound, "a", "b", lags, ONE),
        "self_transfer": dependence.self_transfer_entropy(sound, "a", far, ONE),
        "counterfactual": dependence.counterfactual_entropy(sound, "a", "b", lags, order=ONE),
    }
    for d in lags:
        own[f"transfer_histogram {d}"] = dependence.histogram_transfer_entropy(sound, "x", "y", d, order=ONE).withColumn("lag", F.lit(d))
    value = lambda v: None if v is None or v != v else round(float(v), 9) + 0.0
    for name, frame in own.items():
        name, *d = name.split()
        mine = got[(got.measure == name) & ((got.lag == int(d[0])) if d else True)]
        want = sorted((r.k, r.lag, getattr(r, "ahead", 0), value(r.value) or 0) for r in frame.toPandas().itertuples() if value(r.value) is not None)
        assert want and want == sorted((r.k, r.lag, r.ahead, value(r.value) or 0) for r in mine.itertuples() if value(r.value) is not None), name


def test_profile_autocorrelation_and_its_band(spark):
    x = np.random.default_rng(2).normal(size=80).cumsum()
    df = spark.createDataFrame([(0, i, float(v), float(-v), 0, 0) for i, v in enumerate(x)] + [(1, i, 3.0, 3.0, 0, 0) for i in range(5)], "k int, i long, x double, y double, a int, b int")
    got = {(r.k, r.lag): r for r in profile.lag_profile(df, profile.Profile("x", "y", "a", "b", 6), ONE).where("measure = 'autocorrelation'").collect()}
    d = x - x.mean()
    r = [(d[k:] * d[: len(d) - k]).sum() / (d * d).sum() for k in range(7)]
    for k in range(7):
        half = 0 if k == 0 else 1.959963984540054 * math.sqrt((1 + 2 * sum(v * v for v in r[1:k])) / len(x))
        assert abs(got[0, k].value - r[k]) < 1e-12 and abs(got[0, k].high - r[k] - half) < 1e-12 and abs(got[0, k].low - r[k] + half) < 1e-12
    assert all(got[1, k].value is None for k in range(5)) and (1, 5) not in got


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "k int, i long, x double, y double, a int, b int")
    assert profile.lag_profile(df, profile.Profile("x", "y", "a", "b", 3), ONE).count() == 0


def test_one_long_series_of_a_profile_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(profile, "_BLOCK", 8)
    rows = spark.range(50).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("_place"), F.col("id").alias("_now"))
    wide = profile._with_past(rows, ["k"], 3)
    assert wide.select(F.spark_partition_id()).distinct().count() > 1
    assert {r["_now"]: r["_past"] for r in wide.collect()} == {i: [i - j for j in range(min(i, 3) + 1)] for i in range(50)}
    assert wide.count() == 50


def test_likelihoods_of_known_sets_have_long_blocks(spark, sf, monkeypatch):
    from tickloom.plans import queries

    sizes, real = [], scan.block_size
    monkeypatch.setattr(scan, "block_size", lambda alpha: sizes.append(real(alpha)) or real(alpha))
    queries.QUERIES["conditional_likelihoods"](spark, sf)
    assert min(sizes) > 200  # 4 rows before
