"""Chunked scans, exact quantiles, pair blocks and recurrences against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.plans.chunked import Chunks
from riskframe.plans.pairs import covariances, pair_moments
from riskframe.plans.quantiles import exact_quantiles
from riskframe.plans.scans import affine_scan


@pytest.fixture(scope="module")
def hot():
    """One key holds more than a third of the rows; gaps leave some hours empty; some values are missing."""
    rng = np.random.default_rng(5)
    n = 1500
    keys = rng.choice(["hot", "a", "b", "c"], n, p=[0.4, 0.2, 0.2, 0.2])
    minutes = np.sort(rng.choice(60 * 24 * 20, n, replace=False))
    value = np.round(rng.normal(0, 0.01, n), 5)
    frame = pd.DataFrame({"k": keys, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "min"), "i": range(n), "x": value})
    frame["y"] = frame["x"].where(rng.random(n) > 0.2)
    return frame


@pytest.fixture(scope="module")
def table(spark, hot):
    rows = [(r.k, r.ts.to_pydatetime(), int(r.i), float(r.x), None if pd.isna(r.y) else float(r.y)) for r in hot.itertuples()]
    return spark.createDataFrame(rows, "k string, ts timestamp, i long, x double, y double").cache()


@pytest.fixture(scope="module")
def chunks(spark):
    return Chunks(["k"], ["ts", "i"], F.date_trunc("hour", F.col("ts")))


def collect(df, column):
    return df.select("i", column).toPandas().sort_values("i")[column].to_numpy(float)


def test_rank_and_previous(table, hot, chunks):
    want = hot.groupby("k").cumcount() + 1
    np.testing.assert_array_equal(collect(chunks.rank(table), "rn"), want)
    lag = hot.groupby("k")["y"].shift()
    np.testing.assert_allclose(collect(chunks.previous(table, {"p": "y"}), "p"), lag)


def test_running(table, hot, chunks):
    got = chunks.running(table.withColumn("g", 1 + F.col("x")), {
        "s": ("sum", "x"), "p": ("prod", "g"), "hi": ("max", "x"), "lo": ("min", "x"), "l": ("last", "y")})
    by = hot.groupby("k")
    np.testing.assert_allclose(collect(got, "s"), by["x"].cumsum(), atol=1e-12)
    np.testing.assert_allclose(collect(got, "p"), (1 + hot["x"]).groupby(hot["k"]).cumprod())
    np.testing.assert_allclose(collect(got, "hi"), by["x"].cummax())
    np.testing.assert_allclose(collect(got, "lo"), by["x"].cummin())
    np.testing.assert_allclose(collect(got, "l"), by["y"].ffill())


@pytest.mark.parametrize("rows,chunk", [(1, 7), (5, 7), (30, 7), (20, 1000)])
def test_rolling_crosses_several_chunks(table, hot, chunks, rows, chunk):
    got = chunks.rolling(table, rows, {"m": lambda w: F.avg("x").over(w), "n": lambda w: F.count("x").over(w)}, chunk)
    roll = hot.groupby("k")["x"].rolling(rows, min_periods=1)
    np.testing.assert_allclose(collect(got, "m"), roll.mean().droplevel(0).sort_index(), atol=1e-12)
    np.testing.assert_array_equal(collect(got, "n"), roll.count().droplevel(0).sort_index())


@pytest.mark.parametrize("accuracy", [20, 1000, 100_000])
def test_exact_quantiles_are_numpy_percentiles(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ten": list(range(10)), "ties": [1.0] * 30 + [2.0] * 3,
              "hot": list(rng.exponential(size=3000)), "grid": list(np.round(rng.normal(size=500), 1))}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ten", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    for k, vs in groups.items():
        np.testing.assert_allclose(got[k], np.percentile(vs, [100 * p for p in probs]), atol=1e-12, err_msg=k)


@pytest.mark.parametrize("blocks", [1, 3])
def test_pair_covariances_with_holes(spark, blocks):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.normal(size=(60, 7)), columns=list("abcdefg"), index=pd.date_range("2023-11-01", periods=60))
    wide = wide.mask(rng.random(wide.shape) < 0.15)
    rows = [(t.to_pydatetime(), s, float(v)) for (t, s), v in wide.stack().items()]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, ret double")
    got = covariances(pair_moments(df, blocks=blocks, dates_per_slice="month")).toPandas()
    assert len(got) == 49
    cov, corr = wide.cov(), wide.corr()
    for r in got.itertuples():
        assert r.cov == pytest.approx(cov.loc[r.i, r.j], abs=1e-12)
        assert r.corr == pytest.approx(corr.loc[r.i, r.j], abs=1e-12)


def test_affine_scan_over_chunks(spark, table, hot):
    df = table.withColumns({"a": F.when(F.col("i") % 50 == 0, 0.0).otherwise(0.9), "b": F.col("x")})
    got = affine_scan(df, ["k"], ["ts", "i"], "a", "b", "o", F.date_trunc("day", F.col("ts")), chunk_rows=17)
    want = np.empty(len(hot))
    state = {}
    for r in hot.itertuples():
        want[r.i] = state.get(r.k, 0.0)
        state[r.k] = (0.0 if r.i % 50 == 0 else 0.9) * want[r.i] + r.x
    np.testing.assert_allclose(collect(got, "o"), want, atol=1e-12)
