"""Hidden Markov models against brute force, and chunked passes against unchunked ones."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import hmm


@pytest.fixture(scope="module")
def toy():
    return hmm.Gaussian(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[-1.0], [1.0]]), np.array([[[0.5]], [[0.8]]]))


def test_posterior_and_path_against_enumeration(toy):
    x = np.array([[-1.2], [0.3], [1.5], [-0.2], [0.9]])
    logb = toy.log_density(x)
    scores = {}
    for path in itertools.product(range(2), repeat=len(x)):
        s = np.log(toy.start[path[0]]) + logb[0, path[0]]
        for t in range(1, len(x)):
            s += np.log(toy.trans[path[t - 1], path[t]]) + logb[t, path[t]]
        scores[path] = s
    total = np.logaddexp.reduce(list(scores.values()))
    want = np.zeros((len(x), 2))
    for path, s in scores.items():
        for t, k in enumerate(path):
            want[t, k] += np.exp(s - total)
    _, gamma, xi, score = hmm.forward_backward(toy, x, True, toy.start, np.ones(2))
    np.testing.assert_allclose(gamma, want, atol=1e-12)
    assert score == pytest.approx(total) and xi.sum() == pytest.approx(len(x) - 1)
    assert tuple(hmm.best_path(toy, x, True, np.log(toy.start), -1)) == max(scores, key=scores.get)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    rows = []
    for s in range(3):
        state = 0
        for t in range(160):
            state = state if rng.random() < 0.95 else 1 - state
            rows.append((f"s{s}", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=t)).to_pydatetime(),
                         float(rng.normal([-1, 1][state], [1.0, 0.4][state])), float(rng.normal([0, 0.5][state], 0.5))))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, a double, b double").cache()


def test_chunks_do_not_change_results(panel):
    whole = hmm.HiddenMarkov(["a", "b"], states=2, n_iter=3).fit(panel)
    cut = hmm.HiddenMarkov(["a", "b"], states=2, n_iter=3, chunk_rows=23, bucket=F.date_trunc("month", F.col("ts"))).fit(panel)
    np.testing.assert_allclose(whole.history, cut.history, rtol=1e-9)
    np.testing.assert_allclose(whole.model.mean, cut.model.mean, atol=1e-8)
    key = ["series_id", "ts"]
    for method in ("predict", "predict_proba"):
        a = getattr(whole, method)(panel).toPandas().sort_values(key)
        b = getattr(cut, method)(panel).toPandas().sort_values(key)
        column = a.columns[-1]
        np.testing.assert_allclose(np.vstack(a[column].to_numpy()).astype(float), np.vstack(b[column].to_numpy()).astype(float), atol=1e-6)
    x = whole.score(panel).toPandas().set_index("series_id")["log_likelihood"]
    y = cut.score(panel).toPandas().set_index("series_id")["log_likelihood"]
    np.testing.assert_allclose(x.sort_index(), y.sort_index(), rtol=1e-6)


@pytest.mark.parametrize("kind", hmm.COVARIANCES)
def test_fit_invariants(panel, kind):
    model = hmm.HiddenMarkov(["a", "b"], states=2, covariance=kind, n_iter=5).fit(panel)
    assert all(y >= x - 1e-6 for x, y in zip(model.history, model.history[1:]))
    np.testing.assert_allclose(model.model.trans.sum(1), 1)
    probs = np.vstack(model.predict_proba(panel).toPandas()["probs"].to_numpy())
    np.testing.assert_allclose(probs.sum(1), 1)
    assert set(model.predict(panel).toPandas()["regime"]) <= {0, 1}


def test_one_series_equals_the_plain_fit(panel):
    single = panel.where("series_id = 's0'")
    fitted = hmm.HiddenMarkov(["a"], states=2, n_iter=4, tol=0).fit(single)
    x = single.orderBy("ts").toPandas()[["a"]].to_numpy()
    start = hmm.HiddenMarkov(["a"], states=2).initial(single)
    model = start
    for _ in range(4):
        _, gamma, xi, _ = hmm.forward_backward(model, x, True, model.start, np.ones(2))
        model = hmm.update(hmm._sums(x, gamma, xi, True), 2, 1, "full", 1e-6)
    np.testing.assert_allclose(fitted.model.mean, model.mean, atol=1e-9)
    np.testing.assert_allclose(fitted.model.trans, model.trans, atol=1e-9)


def test_small_and_wrong_input_raise(spark, panel):
    with pytest.raises(ValueError):
        hmm.HiddenMarkov(["a"], covariance="tied")
    with pytest.raises(ValueError):
        hmm.HiddenMarkov(["a"]).predict(panel)
    with pytest.raises(ValueError):
        hmm.HiddenMarkov(["a", "b"], states=3).fit(panel.limit(2))
    with pytest.raises(ValueError):
        hmm.HiddenMarkov(["a", "b"], states=3).fit(panel.limit(0))


def test_rolling_windows(panel):
    fits = hmm.rolling_fit(panel, ["a"], states=2, window=60, step=20, smallest=40, n_iter=5)
    rows = fits.where("series_id = 's0'").orderBy("window").collect()
    assert [r["n"] for r in rows] == [60] * 6 + [40]
    pred = hmm.rolling_predictions(fits)
    assert pred.groupBy("series_id", "ts").count().where("count > 1").count() == 0
    assert hmm.parameter_evolution(fits).where("series_id = 's0'").count() == 14
