"""Queries M: regime labels and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import hmm, regime as rg, regime_ml as ml, series
from riskframe.queries.base import query

K = "series_id"


@query("transition_matrix", "M12", "series_id:s from_regime:i to_regime:i count:i probability", "reg", """
SELECT series_id, a AS from_regime, b AS to_regime, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY series_id, a) AS probability FROM (
  SELECT series_id, regime AS a, lead(regime) OVER (ORDER BY ts) AS b FROM reg) WHERE b IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return rg.transition_matrix(t.regimes, K)


RUNS = """c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (ORDER BY ts) THEN 1 ELSE 0 END AS n FROM reg),
  r AS (SELECT *, sum(n) OVER (ORDER BY ts) AS run FROM c), u AS (SELECT series_id, regime, run, count(*) AS d FROM r GROUP BY 1, 2, 3)"""


@query("regime_persistence", "M13 M8", "series_id:s regime:i mean_run median_run max_run:i min_run:i runs:i", "reg", f"""
WITH {RUNS} SELECT series_id, regime, avg(d) AS mean_run, quantile_cont(d, 0.5) AS median_run, max(d) AS max_run, min(d) AS min_run, count(*) AS runs FROM u GROUP BY 1, 2""")
def _(t):
    return rg.persistence(t.regimes, K)


@query("regime_feature_stats", "M11", "series_id:s regime:i feature:s n:i frequency mean std skewness kurtosis", "reg", """
WITH l AS (SELECT series_id, regime, 'ret' AS feature, ret AS v FROM reg UNION ALL SELECT series_id, regime, 'size', 100 * abs(ret) FROM reg)
SELECT series_id, regime, feature, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY series_id, feature) AS frequency, avg(v) AS mean, stddev_samp(v) AS std,
  skewness(v) AS skewness, kurtosis(v) AS kurtosis FROM l GROUP BY 1, 2, 3""")
def _(t):
    return rg.feature_statistics(t.regimes.withColumn("size", 100 * F.abs("ret")), K, ["ret", "size"])


@query("regime_names", "M7", "series_id:s regime:i mean_return regime_name:s", "reg", """
SELECT series_id, regime, m AS mean_return, CASE row_number() OVER (ORDER BY m, regime) WHEN 1 THEN 'Bear Market' WHEN 2 THEN 'Sideways Market' ELSE 'Bull Market' END AS regime_name
FROM (SELECT series_id, regime, avg(ret) AS m FROM reg GROUP BY 1, 2)""")
def _(t):
    return rg.name_regimes(t.regimes, K)


@query("regime_label_statistics", "M9", "series_id:s regime:i n:i share mean_run prob_low prob_high", "reg", f"""
WITH {RUNS}, p AS (SELECT series_id, k AS regime, CASE WHEN regime = k THEN 0.8 ELSE 0.1 END AS p FROM reg, range(0, 3) x(k)),
  q AS (SELECT series_id, regime, quantile_cont(p, 0.025) AS prob_low, quantile_cont(p, 0.975) AS prob_high FROM p GROUP BY 1, 2)
SELECT g.series_id, g.regime, n, n / sum(n) OVER () AS share, mean_run, prob_low, prob_high FROM (SELECT series_id, regime, count(*) AS n FROM reg GROUP BY 1, 2) g
JOIN (SELECT regime, avg(d) AS mean_run FROM u GROUP BY 1) USING (regime) JOIN q USING (series_id, regime)""")
def _(t):
    return rg.regime_statistics(series.regime_probabilities(t.regimes), K, probs="probs")


@query("regime_summary", "M10", "series_id:s ts:t regime:i regime_name:s confidence prob_bear prob_sideways prob_bull", "reg", """
SELECT series_id, ts, regime, CASE regime WHEN 0 THEN 'Bear' WHEN 1 THEN 'Sideways' ELSE 'Bull' END AS regime_name, 0.8 AS confidence,
  CASE regime WHEN 0 THEN 0.8 ELSE 0.1 END AS prob_bear, CASE regime WHEN 1 THEN 0.8 ELSE 0.1 END AS prob_sideways, CASE regime WHEN 2 THEN 0.8 ELSE 0.1 END AS prob_bull FROM reg""")
def _(t):
    return rg.regime_summary(series.regime_probabilities(t.regimes), ["Bear", "Sideways", "Bull"])


VOTES = """vt AS (SELECT ts, 'vol' AS model, regime FROM reg UNION ALL SELECT ts, 'sign', CASE WHEN ret > 0.001 THEN 0 WHEN ret < -0.001 THEN 2 ELSE 1 END FROM reg
  UNION ALL SELECT ts, 'size', CASE WHEN abs(ret) < 0.0005 THEN 0 WHEN abs(ret) < 0.002 THEN 1 ELSE 2 END FROM reg)"""


def votes(t):
    r = F.col("ret")
    sign = F.when(r > 0.001, 0).when(r < -0.001, 2).otherwise(1)
    size = F.when(F.abs(r) < 0.0005, 0).when(F.abs(r) < 0.002, 1).otherwise(2)
    cells = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("v")) for n, c in (("vol", F.col("regime")), ("sign", sign), ("size", size))])
    return t.regimes.select(K, "ts", F.explode(cells).alias("_v")).select(K, "ts", F.col("_v.model").alias("model"), F.col("_v.v").alias("regime"))


@query("model_consensus", "M21", "ts:t consensus:i strength disagreement", "reg", f"""
WITH {VOTES}, n AS (SELECT ts, regime, count(*) AS n FROM vt GROUP BY 1, 2)
SELECT ts, first(regime ORDER BY n DESC, regime) AS consensus, max(n) / sum(n) AS strength, (count(*) - 1) / sum(n) AS disagreement FROM n GROUP BY 1""")
def _(t):
    return rg.consensus(votes(t), K)


@query("ensemble_regimes", "M19", "ts:t regime:i confidence", "reg", f"""
WITH {VOTES}, p AS (SELECT ts, s AS state, sum(CASE model WHEN 'vol' THEN 0.5 WHEN 'sign' THEN 0.2 ELSE 0.3 END * CASE WHEN s = regime THEN 0.8 ELSE 0.1 END) AS p FROM vt, range(0, 3) x(s) GROUP BY 1, 2)
SELECT ts, first(state ORDER BY p DESC, state) AS regime, max(p) AS confidence FROM p GROUP BY 1""")
def _(t):
    outputs = series.regime_probabilities(votes(t)).select(K, "ts", "model", F.posexplode("probs").alias("state", "prob"))
    return rg.ensemble_probabilities(outputs, {"vol": 0.5, "sign": 0.2, "size": 0.3}, K)


@query("softmax_weights", "M20", "model:s weight", "reg", f"""
WITH {VOTES}, s AS (SELECT model, avg((vt.regime = reg.regime)::INT) AS s FROM vt JOIN reg USING (ts) GROUP BY 1)
SELECT model, exp(s - max(s) OVER ()) / sum(exp(s)) OVER () * exp(max(s) OVER ()) AS weight FROM s""")
def _(t):
    truth = t.regimes.select("ts", F.col("regime").alias("truth"))
    scores = votes(t).join(truth, "ts").groupBy("model").agg(F.avg((F.col("regime") == F.col("truth")).cast("int")).alias("score"))
    return rg.softmax_weights(scores)


@query("drift_trigger", "M24", "model:s ts:t accuracy accuracy_drop retrain:b", "reg", f"""
WITH {VOTES}, a AS (SELECT model, date_trunc('month', ts)::TIMESTAMP AS ts, avg((vt.regime = reg.regime)::INT) AS accuracy FROM vt JOIN reg USING (ts) GROUP BY 1, 2),
  d AS (SELECT *, CASE WHEN count(*) OVER o = 5 THEN avg(accuracy) OVER o - avg(accuracy) OVER r END AS accuracy_drop FROM a
    WINDOW r AS (PARTITION BY model ORDER BY ts ROWS 4 PRECEDING), o AS (PARTITION BY model ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING))
SELECT *, coalesce(accuracy_drop > 0.1 + 1e-9, false) AS retrain FROM d""")
def _(t):
    truth = t.regimes.select("ts", F.col("regime").alias("truth"))
    monthly = votes(t).join(truth, "ts").groupBy("model", F.date_trunc("month", "ts").alias("m")).agg(
        F.avg((F.col("regime") == F.col("truth")).cast("int")).alias("accuracy"))
    return rg.drift_trigger(monthly.withColumnRenamed("m", "ts"), "model", drop=0.1 + 1e-9)


@query("uncertainty_flags", "M24", "series_id:s ts:t uncertain:b", "reg", """
SELECT series_id, ts, count(*) OVER w = 10 AND avg((greatest(0.5 + 100 * ret, 0.5 - 100 * ret) < 0.8)::INT) OVER w > 0.7 + 1e-9 AS uncertain FROM reg
WINDOW w AS (ORDER BY ts ROWS 9 PRECEDING)""")
def _(t):
    probs = F.array(0.5 + 100 * F.col("ret"), 0.5 - 100 * F.col("ret"))
    return rg.uncertainty_flag(t.regimes.withColumn("probs", probs), K, share=0.7 + 1e-9)


@query("label_confidence", "M26 C14", "series_id:s ts:t true_probability confidence p0 p1 p2", "reg", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, lag(regime) OVER (ORDER BY ts) AS p, lead(regime) OVER (ORDER BY ts) AS nx FROM reg),
  d AS (SELECT r.*, (SELECT min(abs(r.rn - x.rn)) FROM r x WHERE x.regime <> x.p) AS d FROM r),
  m AS (SELECT regime AS a, nx AS b, count(*)::DOUBLE AS n FROM r WHERE nx IS NOT NULL AND nx <> regime GROUP BY 1, 2),
  q AS (SELECT *, CASE WHEN d <= 5 THEN 0.9 * (0.5 + 0.1 * d) ELSE 0.9 END AS tp,
    greatest(0.1, least(1, CASE WHEN d <= 10 THEN 0.3 + 0.07 * d WHEN d <= 20 THEN 0.8 + 0.01 * (d - 10) ELSE 1 END)) AS confidence FROM d)
SELECT series_id, ts, tp AS true_probability, confidence, """ + ", ".join(
    f"CASE WHEN regime = {k} THEN tp ELSE (1 - tp) * coalesce((SELECT n FROM m WHERE a = regime AND b = {k}), 0) / (SELECT sum(n) FROM m WHERE a = regime) END AS p{k}" for k in range(3)) + " FROM q")
def _(t):
    labelled = rg.label_confidence(t.regimes, K)
    out = rg.spread_probability(labelled, rg.transition_matrix(t.regimes, K), K, 3)
    return out.withColumns({f"p{k}": F.get("probs", F.lit(k)) for k in range(3)})


@query("regime_characteristics", "M27", "table_name:s rows:i")
def _(t):
    tables = rg.characteristics(t.regimes, K, ["ret"])
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# Models.  Features: the weekly return and its size in percent.

def features(t):
    return t.returns.select("symbol", "ts", (100 * F.col("ret")).alias("r"), F.log(1e-3 + 100 * F.abs("ret")).alias("size"))


def detector(t, **kwargs):
    options = {"states": 3, "n_iter": 8} | kwargs
    return hmm.HiddenMarkov(["r", "size"], "symbol", **options).fit(features(t))


@query("hmm_parameters", "M1 M3 M4 M8", "regime:i start_prob persistence expected_duration mean_r mean_size std_r std_size")
def _(t):
    return detector(t).parameters(t.returns)


@query("hmm_decoded", "M5", "symbol:s ts:t regime:i")
def _(t):
    return detector(t).predict(features(t))


@query("hmm_probabilities", "M6 M10", "symbol:s ts:t p0 p1 p2")
def _(t):
    out = detector(t).predict_proba(features(t))
    return out.withColumns({f"p{k}": F.get("probs", F.lit(k)) for k in range(3)})


@query("hmm_score", "M6", "symbol:s log_likelihood")
def _(t):
    return detector(t, covariance="diag").score(features(t))


@query("emission_densities", "M2", "symbol:s ts:t low high", "rets", """
SELECT symbol, ts, -0.5 * (ln(2 * pi() * 0.04) + (100 * ret + 0.1) ** 2 / 0.04) AS low, -0.5 * (ln(2 * pi() * 0.09) + (100 * ret - 0.1) ** 2 / 0.09) AS high FROM rets""")
def _(t):
    cols = hmm.log_density_columns(["r"], [[-0.1], [0.1]], [[0.04], [0.09]])
    return features(t).withColumns({"low": cols[0], "high": cols[1]})


@query("regime_switching", "M15", "symbol:s ts:t p0 p1")
def _(t):
    model = hmm.HiddenMarkov(["r"], "symbol", states=2, n_iter=8, filtered=True).fit(features(t))
    out = model.filter_proba(features(t))
    return out.withColumns({f"p{k}": F.get("probs", F.lit(k)) for k in range(2)})


@query("rolling_hmm", "M16", "symbol:s ts:t window:i regime:i confidence")
def _(t):
    return hmm.rolling_predictions(hmm.rolling_fit(features(t), ["r", "size"], "symbol", n_iter=10), "symbol")


@query("parameter_evolution", "M17", "symbol:s window:i start_date:t end_date:t regime:i mean persistence")
def _(t):
    return hmm.parameter_evolution(hmm.rolling_fit(features(t), ["r", "size"], "symbol", n_iter=10), "symbol")


@query("volatility_regimes", "M18", "regime:i mean volatility n:i frequency")
def _(t):
    return hmm.volatility_regimes(features(t), "symbol", "r", n_iter=8)[1]


F4 = ["ret", "size", "momentum_10", "std_20"]


def labelled(t):
    base = series.momentum(series.rolling_moments(t.regimes, "ret", keys=K), "ret", (10,), keys=K)
    return base.withColumn("size", F.abs("ret")).na.drop(subset=F4).select(K, "ts", "regime", *F4)


@query("classified_regimes", "M22", "series_id:s ts:t regime:i predicted:i")
def _(t):
    data = labelled(t)
    return ml.classify(ml.fit_classifier(data, F4, trees=10, depth=4), data)


@query("feature_importances", "M22 F5", "feature:s importance")
def _(t):
    data = labelled(t)
    from riskframe.operators.topk import top_rows
    return top_rows(ml.importances(ml.fit_classifier(data, F4, trees=10, depth=4), data, F4), 3, None, "importance", ["feature"])


@query("boosted_regimes", "M22", "series_id:s ts:t regime:i predicted:i")
def _(t):
    data = labelled(t)
    return ml.classify(ml.fit_classifier(data, F4, method="gradient_boosting", trees=3, depth=3), data)


@query("selected_features", "M23", "feature:s method:s")
def _(t):
    data = labelled(t)
    chosen = [(f, "univariate") for f in ml.select_univariate(data, F4, 2)] + [(f, "eliminated") for f in ml.eliminate(data, F4, 2, trees=5)]
    return t.spark.createDataFrame(chosen, "feature string, method string")


@query("hybrid_regimes", "M25", "symbol:s ts:t regime:i")
def _(t):
    model = detector(t, n_iter=5)
    data = features(t)
    forest = ml.hybrid_fit(data, model, ["r", "size"], trees=10, depth=4)
    return ml.hybrid_probabilities(data, model, forest, ["symbol"])
