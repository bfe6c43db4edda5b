"""Formulas on hand-made frames and path operators against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions import measures as m, stats
from riskframe.operators import align, attribution, prep, risk, series, validation


def frame(spark, values, key="k", start="2024-01-01"):
    days = pd.date_range(start, periods=len(values))
    return spark.createDataFrame([(key, d.to_pydatetime(), None if v is None else float(v)) for d, v in zip(days, values)],
                                 "k string, ts timestamp, ret double")


def one(df):
    return df.first().asDict()


def test_edge_series(spark):
    cases = {"up": [0.01, 0.02, 0.03], "flat": [0.0, 0.0, 0.0], "single": [0.05], "fall_first": [-0.1, 0.05, 0.01]}
    df = None
    for k, v in cases.items():
        df = frame(spark, v, k) if df is None else df.unionByName(frame(spark, v, k))
    got = {r["k"]: r for r in risk.performance_profile(df, "k").collect()}
    assert got["up"]["max_drawdown"] == 0 and got["up"]["omega_ratio"] is None and got["up"]["win_loss_ratio"] is None
    assert got["flat"]["sharpe_ratio"] == 0 and got["flat"]["win_rate"] == 0
    assert got["single"]["volatility"] is None and got["single"]["total_return"] == pytest.approx(0.05)
    # The peak starts at the first observation, so the loss on day one does not show.
    assert got["fall_first"]["max_drawdown"] == 0


def test_unknown_styles_raise():
    for call in (lambda: m.sharpe("r", style="x"), lambda: m.sortino("r", style="x"), lambda: m.styled_set("r", "x"),
                 lambda: m.capture("r", "b", "sideways")):
        with pytest.raises(ValueError):
            call()


def test_cvar_uses_ties_at_the_cut(spark):
    got = one(risk.tail_table(frame(spark, [-0.02] * 5 + [0.01] * 95), "k", probs=(0.05,)))
    assert got["var"] == pytest.approx(np.percentile([-0.02] * 5 + [0.01] * 95, 5))
    assert got["cvar"] == pytest.approx(-0.02)


def test_streaks(spark):
    got = one(series.win_loss_streaks(frame(spark, [1, 1, 0, 1, -1, -1, 0, -1]), "k"))
    assert (got["max_win_streak"], got["max_loss_streak"], got["current_streak"]) == (2, 2, -1)


@pytest.mark.parametrize("style", sorted(series.DRAWDOWN_STYLES))
def test_drawdown_periods_against_a_loop(spark, style):
    limit, strict, exit_test, keep_open, depth = series.DRAWDOWN_STYLES[style]
    rng = np.random.default_rng(11)
    r = rng.normal(0.0005, 0.012, 600)
    w = np.cumprod(1 + r)
    dd = w / np.maximum.accumulate(w) - 1
    want, open_at = [], None
    for t in range(len(r)):
        enters = dd[t] < -limit if strict else dd[t] <= -limit
        leaves = dd[t] > -0.001 if exit_test == "above" else abs(dd[t]) < 0.001
        if open_at is None and enters:
            open_at = t
        elif open_at is not None and leaves:
            want.append((open_at, t, True))
            open_at = None
    if open_at is not None and keep_open:
        want.append((open_at, len(r) - 1, False))
    got = series.drawdown_periods(frame(spark, r), "k", style=style).orderBy("start_date").collect()
    day = pd.Timestamp("2024-01-01")
    assert [((g["start_date"] - day).days, (g["end_date"] - day).days, g["recovered"]) for g in got] == want
    for g, (a, b, _) in zip(got, want):
        deepest = w[a:b + 1].min() / w[a] - 1 if depth == "entry" else dd[a:b + 1].min()
        assert g["max_drawdown"] == pytest.approx(deepest)


def test_fill_and_interpolate(spark):
    df = frame(spark, [None, 1.0, None, None, 4.0, None])
    filled = prep.forward_fill(df, ["ret"], "k", back=True).orderBy("ts").toPandas()["ret"].tolist()
    assert filled == [1, 1, 1, 1, 4, 4]
    line = prep.interpolate(df, "ret", "k").orderBy("ts").toPandas()["ret"].tolist()
    assert line == pytest.approx([1, 1, 2, 3, 4, 4])


def test_exponential_mean_and_moments_match_pandas(spark):
    values = np.random.default_rng(3).normal(size=400)
    df = frame(spark, values)
    got = series.ema(df, "ret", (12, 26), "k").orderBy("ts").toPandas()
    for span in (12, 26):
        np.testing.assert_allclose(got[f"ema_{span}"], pd.Series(values).ewm(span=span).mean(), rtol=1e-12)
    cut = series.ema(df, "ret", (12,), "k", chunk_rows=37).orderBy("ts").toPandas()  # across the edges of chunks
    np.testing.assert_allclose(cut["ema_12"], got["ema_12"], rtol=1e-12)
    moments = series.rolling_moments(df, "ret", 20, "k").orderBy("ts").toPandas()
    roll = pd.Series(values).rolling(20)
    np.testing.assert_allclose(moments["skew_20"], roll.skew(), atol=1e-8)
    np.testing.assert_allclose(moments["kurt_20"], roll.kurt(), atol=1e-8)


def test_regime_features_match_pandas(spark):
    values = np.random.default_rng(4).normal(0, 0.01, 120)
    got = series.regime_features(frame(spark, values), (5,), "k").orderBy("ts").toPandas()
    s = pd.Series(values)
    want = s.rolling(5).apply(lambda x: x.autocorr(lag=1)).bfill().fillna(0)
    np.testing.assert_allclose(got["rolling_5d_autocorr"], want, atol=1e-9)
    reversion = (s - s.rolling(5).mean()).rolling(5).mean().bfill().fillna(0)
    np.testing.assert_allclose(got["rolling_5d_mean_reversion"], reversion, atol=1e-12)


def test_normal_distribution_functions(spark):
    xs = [-8.0, -3.5, -1.0, 0.0, 0.5, 2.0, 4.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(stats.normal_cdf("x")).collect()]
    np.testing.assert_allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rtol=1e-9, atol=1e-16)


def test_kolmogorov_smirnov_statistic(spark):
    values = np.random.default_rng(6).normal(size=200)
    got = one(validation.kolmogorov_smirnov(frame(spark, values), "k"))
    z = np.sort((values - values.mean()) / values.std(ddof=1))
    cdf = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    n = len(z)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    assert got["statistic"] == pytest.approx(want, abs=1e-12) and 0 <= got["p_value"] <= 1


def test_contributions_agree_and_add_up(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=50)
    rows = [(s, d.to_pydatetime(), float(rng.normal(0, 0.01))) for s in "abc" for d in days]
    rets = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    weights = spark.createDataFrame([("p", "a", .5), ("p", "b", .3), ("p", "c", .2)], "portfolio_id string, symbol string, weight double")
    from riskframe.operators.weights import annual_covariances
    table = risk.component_contributions(weights, annual_covariances(rets))
    direct = risk.contributions_from_returns(weights, rets)
    a = {r["symbol"]: r["percentage"] for r in table.collect()}
    b = {r["symbol"]: r["percentage"] for r in direct.collect()}
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1)


def test_brinson_effects_add_up_to_the_active_return(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{i}", "x" if i < 3 else "y", t, *map(float, rng.random(2)), *map(float, rng.normal(size=2))) for i in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, "symbol string, sector string, ts int, pw double, bw double, ret double, bret double")
    total = attribution.brinson(df).where("symbol IS NULL").first()
    active = sum(r[3] * r[5] - r[4] * r[6] for r in rows)
    assert total["total_contribution"] == pytest.approx(active)


def test_as_of_and_range_join(spark):
    history = spark.createDataFrame([("2024-01-01", 1.0), ("2024-02-01", 2.0)], "d string, v double").selectExpr("cast(d as timestamp) ts", "v")
    points = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), ("2024-01-20",), ("2024-03-01",)], "d string").selectExpr("cast(d as timestamp) ts")
    got = [r["v"] for r in align.as_of(points, history, ["v"]).orderBy("ts").collect()]
    assert got == [None, 1.0, 1.0, 2.0]
    windows = spark.createDataFrame([("2024-01-01", "2024-02-01")], "a string, b string").selectExpr("cast(a as timestamp) a", "cast(b as timestamp) b")
    assert align.range_join(windows, history, "a", "b").count() == 1


def test_quality_statuses(spark):
    from riskframe.operators.quality import status_of
    df = spark.createDataFrame([(95.0,), (80.0,), (65.0,), (40.0,), (10.0,)], "s double")
    got = [r[0] for r in df.select(status_of(F.col("s"))).collect()]
    assert got == ["EXCELLENT", "GOOD", "FAIR", "POOR", "UNAVAILABLE"]
