"""Regressions, weights, ledgers, trade lists and resampling against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions import costs
from riskframe.operators import backtest as bt, factors as fa, hedge, quality, regime as rg, series, weights as wt


@pytest.fixture(scope="module")
def returns(spark):
    """Five assets by 252 days, normal returns, seeded."""
    rng = np.random.default_rng(42)
    days = pd.date_range("2023-01-02", periods=252)
    rows = [(f"A{i}", d.to_pydatetime(), float(v)) for i in range(5) for d, v in zip(days, rng.normal(0.08 / 252, 0.2 / 252 ** .5, 252))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, ret double").cache()


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    n = 60
    f = rng.normal(0, 0.01, (n, 2))
    y = 0.001 + f @ np.array([1.2, -0.4]) + rng.normal(0, 0.002, n)
    df = spark.createDataFrame([("a", *map(float, (*f[i], y[i]))) for i in range(n)], "symbol string, f1 double, f2 double, ret double")
    got = fa.fit_ols(df, "symbol", "ret", ["f1", "f2"]).first()
    x = np.column_stack([np.ones(n), f])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    res = y - x @ beta
    se = np.sqrt(res @ res / (n - 3) * np.diag(np.linalg.inv(x.T @ x)))
    np.testing.assert_allclose([got["alpha"], got["beta_f1"], got["beta_f2"]], beta, rtol=1e-9)
    np.testing.assert_allclose([got["t_alpha"], got["t_f1"], got["t_f2"]], beta / se, rtol=1e-8)
    assert got["r_squared"] == pytest.approx(1 - res @ res / ((y - y.mean()) ** 2).sum())
    assert fa.fit_ols(df.limit(12), "symbol", "ret", ["f1", "f2"]).count() == 0
    plain = fa.fit_ols(df, "symbol", "ret", ["f1", "f2"], plain_t=True).first()
    bare = np.sqrt(res @ res / (n - 3) * np.diag(np.linalg.inv(f.T @ f)))
    np.testing.assert_allclose([plain["t_f1"], plain["t_f2"]], beta[1:] / bare, rtol=1e-8)


def test_student_tail(spark):
    # Known values: P(|T_10| > 2.228) = 0.05, P(|T_1| > 1) = 0.5, P(|T_120| > 1.98) = 0.05.
    df = spark.createDataFrame([(2.228139, 10.0), (1.0, 1.0), (1.97993, 120.0), (0.0, 5.0)], "t double, dof double")
    got = [r["p_value"] for r in fa.student_p_values(df, "t", "dof").collect()]
    np.testing.assert_allclose(got, [0.05, 0.5, 0.05, 1.0], atol=1e-5)


@pytest.mark.parametrize("assets,defined", [(6, False), (7, True)])
def test_factor_sort_needs_more_than_six_assets(spark, assets, defined):
    rows = [("2024-01-01", f"s{i}", 0.01 * i, float(10 + i), float(i)) for i in range(assets)]
    df = spark.createDataFrame(rows, "ts string, symbol string, ret double, cap double, bm double")
    assert (fa.size_value_factors(df).first()["SMB"] is not None) == defined


def test_principal_components(spark, returns):
    loadings, scores = fa.pca_factors(returns, 2)
    wide = returns.toPandas().pivot(index="ts", columns="symbol", values="ret")
    values, vectors = np.linalg.eigh(wide.cov())
    got = loadings.where("factor = 'PC1'").toPandas().set_index("symbol")["loading"].sort_index()
    assert abs(got.to_numpy() @ vectors[:, -1]) == pytest.approx(1)
    assert scores.where("factor = 'PC1'").agg(F.var_samp("score")).first()[0] == pytest.approx(values[-1])


def test_weight_rules(spark, returns):
    methods = wt.WeightingMethods()
    for name in methods.names():
        w = methods.weights(name, returns).toPandas()["weight"]
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
    with pytest.raises(ValueError):
        methods.weights("unknown", returns)
    methods.register("first", lambda r, keys=None: r.select("symbol").distinct().withColumn("weight", F.lit(0.2)))
    assert methods.weights("first", returns).count() == 5
    clipped = wt.bound_weights(wt.momentum_weights(returns, 1).withColumn("k", F.lit(1)), 0.05, 0.5, "k").toPandas()["weight"]
    assert clipped.sum() == pytest.approx(1) and clipped.min() > 0


def test_scoring_survives_a_singular_covariance(spark):
    cov = spark.createDataFrame([(i, j, 0.04 if i == j else (0.04 if {i, j} == {"b", "c"} else 0.01)) for i in "abc" for j in "abc"],
                                "i string, j string, cov double")
    cand = spark.createDataFrame([(0, "a", .4), (0, "b", .3), (0, "c", .3), (1, "a", .2), (1, "b", .5), (1, "c", .4)], "cand_id int, symbol string, weight double")
    mu = spark.createDataFrame([("a", .08), ("b", .05), ("c", .06)], "symbol string, mu double")
    scores = wt.score_mean_variance(cand, mu, cov, risk_aversion=2.0)
    got = {r["cand_id"]: r for r in scores.collect()}
    assert got[0]["feasible"] and not got[1]["feasible"]
    assert wt.best_candidate(scores).first()["cand_id"] == 0


def test_probability_propagation(spark):
    p, m = [0.2, 0.5, 0.3], [[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]
    df = spark.createDataFrame([(p, m)], "p array<double>, m array<array<double>>")
    got = df.select(wt.propagate("p", "m", 3).alias("x")).first()["x"]
    np.testing.assert_allclose(got, np.array(p) @ np.linalg.matrix_power(np.array(m), 3))


def test_ledger_of_a_hot_position_in_small_chunks(spark):
    rng = np.random.default_rng(3)
    rows, q = [], 0.0
    for t in range(400):
        side = "Buy" if q <= 0 or rng.random() < 0.55 else "Sell"
        size = float(rng.integers(1, 20)) if side == "Buy" else float(q if rng.random() < 0.2 else min(q, rng.integers(1, 10)))
        rows.append(("p", "x", t, side, size, float(rng.integers(90, 110)), 1.0))
        q += size if side == "Buy" else -size
    df = spark.createDataFrame(rows, "portfolio_id string, symbol string, ts int, side string, quantity double, price double, commission double")
    got = bt.position_ledger(df, order=("ts",), bucket=F.floor(F.col("ts") / 30), chunk_rows=13).orderBy("ts").collect()
    q, avg = 0.0, 0.0
    for r, row in zip(got, rows):
        _, _, _, side, size, price, _ = row
        pnl = 0.0
        if side == "Buy":
            avg = (q * avg + size * price) / (q + size) if q + size > 0 else avg
            q += size
        else:
            pnl = (price - avg) * size if q > 0 else 0.0
            q -= size
            avg = 0.0 if q == 0 else avg
        assert (r["position"], r["average_cost"], r["realised_pnl"]) == pytest.approx((q, avg, pnl), abs=1e-8)


def test_holdings_trades(spark):
    w = [("p", d, s, x) for d, a, b in (("2024-01-01", .6, .4), ("2024-01-02", .6, .4), ("2024-01-03", .3, .7), ("2024-01-04", .305, .695)) for s, x in (("a", a), ("b", b))]
    weights = spark.createDataFrame(w, "portfolio_id string, d string, symbol string, weight double").selectExpr("portfolio_id", "cast(d as timestamp) ts", "symbol", "weight")
    prices = weights.select("symbol", "ts", F.when(F.col("symbol") == "a", 10.0).otherwise(20.0).alias("close"))
    got = bt.holdings_trades(weights, prices, 100_000.0).orderBy("ts", "symbol").collect()
    assert [(r["symbol"], r["side"], r["notes"]) for r in got] == [("a", "Buy", "Initial purchase"), ("b", "Buy", "Initial purchase"), ("a", "Sell", "Rebalancing"), ("b", "Buy", "Rebalancing")]
    def cost(v):
        p = v / 1e6
        return v * 0.001 + v * (0.1 * p + 0.05 * p ** .5 + 0.0001)
    value = 100_000 - cost(60_000) - cost(40_000)
    assert got[2]["trade_value"] == pytest.approx(60_000 - 0.3 * value)


def test_bootstrap_is_the_same_for_any_partitioning(spark, returns):
    a = bt.bootstrap(returns, 5, 40).orderBy("sim_id", "step", "symbol").collect()
    b = bt.bootstrap(returns.repartition(13), 5, 40).orderBy("sim_id", "step", "symbol").collect()
    assert a == b and len(a) == 5 * 40 * 5


def test_cost_models(spark):
    with pytest.raises(ValueError):
        costs.impact("unknown", "q", "v", F.lit(True))
    df = spark.createDataFrame([(100.0, 1000.0, "buy", 50.0), (100.0, 1000.0, "sell", 50.0), (1.0, 0.0, "buy", 5.0)], "quantity double, volume double, side string, price double")
    got = bt.cost_table(df).collect()
    assert got[0]["market_impact"] == pytest.approx(0.001 * 0.1 ** .5) and got[1]["market_impact"] == -got[0]["market_impact"]
    assert got[2]["market_impact"] == 0 and got[2]["commission"] == 1.0


def test_hedge_plan_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("p", "a", 30.0, 1000.0), ("p", "b", 40.0, 1000.0), ("p", "c", 15.0, 1000.0)], "portfolio_id string, instrument string, hedge_cost double, nav double")
    got = {r["instrument"]: r["selected"] for r in hedge.hedge_plan(df).collect()}
    assert got == {"a": True, "b": False, "c": True}
    with pytest.raises(KeyError):
        hedge.HedgeStrategies().ratios(df, "portfolio_id", ["unknown"])


def test_consensus_breaks_ties_low_and_names_follow_means(spark):
    votes = spark.createDataFrame([("k", 1, "m1", 2), ("k", 1, "m2", 0), ("k", 2, "m1", 1), ("k", 2, "m2", 1)], "k string, ts int, model string, regime int")
    got = {r["ts"]: (r["consensus"], r["strength"]) for r in rg.consensus(votes, "k").collect()}
    assert got == {1: (0, 0.5), 2: (1, 1.0)}


def test_noisy_ohlc_fails_the_consistency_check(spark):
    rng = np.random.default_rng(8)
    rows = [("x", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=t)).to_pydatetime(), *map(float, 100 + rng.normal(0, 5, 4)), 10) for t in range(100)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long")
    assert not quality.ohlc_checks(bars).first()["passed"]


def test_regression_with_factors_of_very_different_size(spark):
    rng = np.random.default_rng(8)
    n = 400
    small, large = 4 + 0.0005 * rng.normal(size=n), 1e9 + 1e7 * rng.normal(size=n)
    y = 0.01 + 5.0 * small + 2e-9 * large + 0.001 * rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "y": y, "a": small, "b": large, "c": 2 * small}))
    want = np.linalg.lstsq(np.column_stack([np.ones(n), small - 4, (large - 1e9) / 1e7]), y, rcond=None)[0]
    got = fa.fit_ols(df, "k", "y", ["a", "b"]).first()
    assert got["full_rank"] and abs(got["beta_a"] / want[1] - 1) < 1e-8 and abs(got["beta_b"] * 1e7 / want[2] - 1) < 1e-8
    assert not fa.fit_ols(df, "k", "y", ["a", "c"]).first()["full_rank"]


def test_exponential_mean_over_gaps(spark):
    values = [None, 1.0, None, None, 4.0, 2.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "symbol string, ts int, x double")
    got = [r["ema_3"] for r in series.ema(df, "x", (3,)).orderBy("ts").collect()]
    num = den = 0.0
    for v, g in zip(values, got):
        num, den = num / 2 + (v or 0.0), den / 2 + (v is not None)
        assert (g is None or g != g) if den == 0 else abs(g - num / den) < 1e-12
