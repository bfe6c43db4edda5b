"""Queries J: weighting rules, candidates, blends, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import align, prep, weights as wt
from riskframe.queries.base import query
from riskframe.session import cut_lineage

LOOK = """pts AS (SELECT max(ts) AS as_of FROM rets GROUP BY date_trunc('quarter', ts)),
  lb AS (SELECT as_of, symbol, ts, ret FROM pts JOIN rets ON ts >= as_of - INTERVAL 180 DAY AND ts < as_of)"""
REB = LOOK + """, iv AS (SELECT as_of, symbol, 1 / stddev_samp(ret) AS iv FROM lb GROUP BY 1, 2),
  reb AS (SELECT 'rp' AS portfolio_id, as_of AS ts, symbol, iv / sum(iv) OVER (PARTITION BY as_of) AS weight FROM iv
    WHERE as_of IN (SELECT as_of FROM lb GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM rets) AND count(*) > 60)),
  mv AS (SELECT as_of, symbol, row_number() OVER (PARTITION BY as_of ORDER BY avg(ret) DESC, symbol) AS k FROM lb GROUP BY 1, 2)"""
MOM = """reb2 AS (SELECT * FROM reb UNION ALL SELECT 'mo', as_of, symbol, CASE WHEN k <= 2 THEN 0.5 ELSE 0 END FROM mv WHERE as_of IN (SELECT ts FROM reb))"""


def lookback(t):
    points = prep.rebalance_dates(t.returns, "quarterly").withColumnRenamed("ts", "as_of")
    return align.lookback_join(points, t.returns, 180)


def rebalances(t):
    """Inverse-volatility and momentum portfolios at quarterly rebalances with enough history of all assets."""
    rows = lookback(t)
    assets = t.returns.agg(F.countDistinct("symbol")).scalar()
    ready = rows.groupBy("as_of").agg(F.countDistinct("symbol").alias("s"), F.count("*").alias("n")).where((F.col("s") == assets) & (F.col("n") > 60))
    kept = rows.join(ready.select("as_of"), "as_of")
    rp = wt.inverse_volatility(kept, "as_of").withColumn("portfolio_id", F.lit("rp"))
    mo = wt.momentum_weights(kept, 2, "as_of").withColumn("portfolio_id", F.lit("mo"))
    return cut_lineage(rp.unionByName(mo).select("portfolio_id", F.col("as_of").alias("ts"), "symbol", "weight"))


@query("lookback_estimates", "J1 C10", "as_of:t i:s j:s mu cov", "rets", f"""
WITH {LOOK}, m AS (SELECT as_of, symbol, avg(ret) * 252 AS mu FROM lb GROUP BY 1, 2)
SELECT a.as_of, a.symbol AS i, b.symbol AS j, max(mu) AS mu, covar_samp(a.ret, b.ret) * 252 AS cov FROM lb a JOIN lb b ON a.as_of = b.as_of AND a.ts = b.ts
JOIN m ON m.as_of = a.as_of AND m.symbol = a.symbol GROUP BY 1, 2, 3""")
def _(t):
    rows = lookback(t)
    mu = wt.annual_means(rows, "as_of").withColumnRenamed("symbol", "i")
    return wt.annual_covariances(rows, "as_of").join(mu, ["as_of", "i"])


@query("equal_weights", "J2", "as_of:t symbol:s weight", "rets", f"WITH {LOOK}, s AS (SELECT DISTINCT as_of, symbol FROM lb) SELECT *, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM s")
def _(t):
    return wt.equal_weight(lookback(t), "as_of")


@query("inverse_volatility_weights", "J3", "as_of:t symbol:s weight", "rets", f"WITH {REB} SELECT as_of, symbol, iv / sum(iv) OVER (PARTITION BY as_of) AS weight FROM iv")
def _(t):
    return wt.inverse_volatility(lookback(t), "as_of")


@query("momentum_weights", "J4", "as_of:t symbol:s weight", "rets", f"WITH {REB} SELECT as_of, symbol, (k <= 2)::INT / sum((k <= 2)::INT) OVER (PARTITION BY as_of) AS weight FROM mv")
def _(t):
    return wt.momentum_weights(lookback(t), 2, "as_of")


@query("bounded_weights", "J5", "portfolio_id:s ts:t symbol:s weight", "wts", """
SELECT portfolio_id, ts, symbol, c / sum(c) OVER (PARTITION BY portfolio_id, ts) AS weight FROM (SELECT *, greatest(0.1, least(0.3, weight)) AS c FROM wts)""")
def _(t):
    return wt.bound_weights(t.weights, 0.1, 0.3, ["portfolio_id", "ts"])


COV = "cov AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) * 252 AS cov FROM rets a JOIN rets b USING (ts) GROUP BY 1, 2)"
MU = "mu AS (SELECT symbol, avg(ret) * 252 AS mu FROM rets GROUP BY 1)"
CAND = """cd AS (SELECT dense_rank() OVER (ORDER BY ts) AS cand_id, symbol, w / sum(w) OVER (PARTITION BY ts) AS weight FROM (
    SELECT date_trunc('quarter', o_orderdate) AS ts, o_orderpriority AS symbol, count(*)::DOUBLE AS w FROM orders GROUP BY 1, 2))"""


def candidates(t):
    from pyspark.sql import Window
    counts = t.read("orders").groupBy(F.date_trunc("quarter", "o_orderdate").alias("ts"), F.col("o_orderpriority").alias("symbol")).count()
    return counts.select(F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("ts")).alias("cand_id"), "symbol",
                         (F.col("count") / F.sum("count").over(Window.partitionBy("ts"))).alias("weight"))


@query("implied_returns", "J6", "symbol:s implied_return", "rets", f"""
WITH {COV}, m AS (SELECT o_orderpriority AS symbol, count(*) / sum(count(*)) OVER () AS weight FROM orders GROUP BY 1)
SELECT i AS symbol, 3 * sum(cov * weight) AS implied_return FROM cov JOIN m ON m.symbol = j GROUP BY 1""")
def _(t):
    counts = t.read("orders").groupBy(F.col("o_orderpriority").alias("symbol")).count()
    from riskframe.plans.windows import whole
    market = counts.withColumn("_k", F.lit(1)).select("symbol", (F.col("count") / F.sum("count").over(whole("_k"))).alias("weight"))
    return wt.implied_returns(wt.annual_covariances(t.returns), market)


@query("mean_variance_scores", "J7", "cand_id:i expected_return variance turnover objective feasible:b", "rets lw", f"""
WITH {COV}, {MU}, {CAND}, h AS (SELECT symbol, weight AS held FROM lw WHERE portfolio_id = 'O'),
  v AS (SELECT a.cand_id, sum(a.weight * b.weight * cov) AS variance FROM cd a JOIN cd b USING (cand_id) JOIN cov ON i = a.symbol AND j = b.symbol GROUP BY 1),
  r AS (SELECT cand_id, sum(weight * mu) AS expected_return, sum(abs(weight - coalesce(held, 0))) AS turnover,
    abs(sum(weight) - 1) < 1e-6 AND min(weight) >= -1e-9 AND max(weight) <= 0.22 + 1e-9 AS feasible FROM cd JOIN mu USING (symbol) LEFT JOIN h USING (symbol) GROUP BY 1)
SELECT *, expected_return - 2.5 * variance - 0.001 * turnover AS objective FROM r JOIN v USING (cand_id)""")
def _(t):
    current = t.latest_weights.where("portfolio_id = 'O'").select("symbol", "weight")
    return wt.score_mean_variance(candidates(t), wt.annual_means(t.returns), wt.annual_covariances(t.returns), risk_aversion=5.0,
                                  current=current, turnover_cost=0.001, high=0.22)


@query("risk_parity_best", "J8", "cand_id:i objective:p", "rets", f"""
WITH {COV}, {CAND}, c AS (SELECT a.cand_id, a.symbol, sum(a.weight * b.weight * cov) AS c FROM cd a JOIN cd b USING (cand_id) JOIN cov ON i = a.symbol AND j = b.symbol GROUP BY 1, 2),
  g AS (SELECT cand_id, c - 0.2 * sum(c) OVER (PARTITION BY cand_id) AS g FROM c)
SELECT cand_id, -sum(g * g) AS objective FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t):
    return wt.best_candidate(wt.score_risk_parity(candidates(t), wt.annual_covariances(t.returns)))


PROBS = """pb AS (SELECT portfolio_id, regime, count(*) / sum(count(*)) OVER (PARTITION BY portfolio_id) AS prob FROM preg GROUP BY 1, 2),
  rwt AS (SELECT regime, symbol, (1 / stddev_samp(r.ret)) / sum(1 / stddev_samp(r.ret)) OVER (PARTITION BY regime) AS weight FROM rets r JOIN reg USING (ts) GROUP BY 1, 2)"""


def regime_inputs(t):
    from riskframe.plans.windows import whole
    counts = t.portfolio_regimes.groupBy("portfolio_id", "regime").count()
    probs = counts.select("portfolio_id", "regime", (F.col("count") / F.sum("count").over(whole("portfolio_id"))).alias("prob"))
    labelled = t.returns.join(t.regimes.select("ts", "regime"), "ts")
    return labelled, wt.inverse_volatility(labelled, "regime"), probs


@query("regime_blend", "J9", "portfolio_id:s symbol:s weight", "rets preg", f"""
WITH {PROBS} SELECT portfolio_id, symbol, sum(prob * weight) AS weight FROM pb JOIN rwt USING (regime) GROUP BY 1, 2""")
def _(t):
    _, weights, probs = regime_inputs(t)
    return wt.blend_regimes(weights, probs)


@query("regime_blend_figures", "J9", "portfolio_id:s expected_return volatility sharpe_ratio", "rets preg", f"""
WITH {PROBS}, {MU}, w AS (SELECT portfolio_id, symbol, sum(prob * weight) AS weight FROM pb JOIN rwt USING (regime) GROUP BY 1, 2),
  cr AS (SELECT regime, a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) * 252 AS cov FROM rets a JOIN rets b USING (ts) JOIN reg USING (ts) GROUP BY 1, 2, 3),
  cb AS (SELECT portfolio_id, i, j, sum(prob * cov) AS cov FROM cr JOIN pb USING (regime) GROUP BY 1, 2, 3),
  v AS (SELECT a.portfolio_id, sqrt(sum(a.weight * b.weight * cov)) AS volatility FROM w a JOIN w b USING (portfolio_id) JOIN cb ON cb.portfolio_id = a.portfolio_id AND i = a.symbol AND j = b.symbol GROUP BY 1),
  r AS (SELECT portfolio_id, sum(weight * mu) AS expected_return FROM w JOIN mu USING (symbol) GROUP BY 1)
SELECT *, (expected_return - 0.02) / volatility AS sharpe_ratio FROM r JOIN v USING (portfolio_id)""")
def _(t):
    labelled, weights, probs = regime_inputs(t)
    cov = wt.blend_covariances(wt.annual_covariances(labelled, "regime"), probs)
    return wt.portfolio_figures(wt.blend_regimes(weights, probs), wt.annual_means(t.returns), cov, "portfolio_id")


@query("regime_propagation", "J10", "series_id:s regime:i h1_0 h1_1 h1_2 h5_0 h5_1 h5_2 vol_5", "reg", """
WITH n AS (SELECT regime AS a, lead(regime) OVER (ORDER BY ts) AS b FROM reg),
  m AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM n WHERE b IS NOT NULL GROUP BY 1, 2),
  v AS (SELECT regime AS b, stddev_pop(ret) AS v FROM reg GROUP BY 1),
  s2 AS (SELECT x.a, y.b, sum(x.p * y.p) AS p FROM m x JOIN m y ON x.b = y.a GROUP BY 1, 2), s4 AS (SELECT x.a, y.b, sum(x.p * y.p) AS p FROM s2 x JOIN s2 y ON x.b = y.a GROUP BY 1, 2),
  s5 AS (SELECT x.a, y.b, sum(x.p * y.p) AS p FROM s4 x JOIN m y ON x.b = y.a GROUP BY 1, 2), c AS (SELECT DISTINCT a FROM m)
SELECT 'all' AS series_id, a AS regime, """ + ", ".join(f"coalesce((SELECT p FROM {s} x WHERE x.a = c.a AND x.b = {k}), 0) AS {h}_{k}" for s, h in (("m", "h1"), ("s5", "h5")) for k in range(3)) +
       ", (SELECT sum(p * v) FROM s5 x JOIN v USING (b) WHERE x.a = c.a) AS vol_5 FROM c")
def _(t):
    from riskframe.operators.regime import transition_matrix, transition_arrays
    arrays = transition_arrays(transition_matrix(t.regimes, "series_id"), "series_id", 3)
    vols = t.regimes.groupBy("series_id", "regime").agg(F.stddev_pop("ret").alias("v"))
    vol = vols.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("regime", "v"))), lambda x: x["v"]).alias("vols"))
    starts = t.regimes.select("series_id", "regime").distinct().join(arrays, "series_id").join(vol, "series_id")
    p0 = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == F.col("regime"), 1.0).otherwise(0.0))
    out = starts.withColumns({"p1": wt.propagate(p0, "matrix", 1), "p5": wt.propagate(p0, "matrix", 5)})
    cells = {f"h{h}_{k}": F.get(f"p{h}", F.lit(k)) for h in (1, 5) for k in range(3)}
    return out.withColumns(cells).withColumn("vol_5", wt.expected_volatility(F.col("p5"), F.col("vols")))


@query("method_comparison", "J11 U3", "method:s expected_return volatility sharpe_ratio max_weight min_weight concentration", "rets", f"""
WITH lr AS (SELECT symbol, ts, ln(1 + ret) AS ret FROM rets), {COV.replace("rets", "lr")}, {MU.replace("rets", "lr")},
  s AS (SELECT symbol, 1 / stddev_samp(ret) AS iv, row_number() OVER (ORDER BY avg(ret) DESC, symbol) AS k FROM lr GROUP BY 1), w AS (SELECT 'equal_weight' AS method, symbol, 1.0 / count(*) OVER () AS weight FROM s UNION ALL SELECT 'risk_parity', symbol, iv / sum(iv) OVER () FROM s
    UNION ALL SELECT 'momentum', symbol, (k <= 3)::INT / 3.0 FROM s),
  v AS (SELECT a.method, sqrt(sum(a.weight * b.weight * cov)) AS volatility FROM w a JOIN w b USING (method) JOIN cov ON i = a.symbol AND j = b.symbol GROUP BY 1),
  r AS (SELECT method, sum(weight * mu) AS expected_return, max(weight) AS max_weight, min(weight) AS min_weight, sum(weight ** 2) AS concentration FROM w JOIN mu USING (symbol) GROUP BY 1)
SELECT *, (expected_return - 0.02) / volatility AS sharpe_ratio FROM r JOIN v USING (method)""")
def _(t):
    logs = t.returns.withColumn("ret", F.log1p("ret"))
    weights = wt.WeightingMethods().all(logs)
    return wt.compare_methods(weights, wt.annual_means(logs), wt.annual_covariances(logs))


@query("weight_timeline", "J13", "portfolio_id:s ts:t rebalance_date:t symbol:s weight", "rets", f"""
WITH {REB}, {MOM}, d AS (SELECT DISTINCT ts FROM rets), p AS (SELECT portfolio_id, ts AS st, coalesce(lead(ts) OVER (PARTITION BY portfolio_id ORDER BY ts), TIMESTAMP '2100-01-01') AS en FROM (SELECT DISTINCT portfolio_id, ts FROM reb2))
SELECT p.portfolio_id, d.ts, st AS rebalance_date, symbol, weight FROM p JOIN d ON d.ts >= st AND d.ts < en JOIN reb2 ON reb2.portfolio_id = p.portfolio_id AND reb2.ts = st""")
def _(t):
    return wt.weight_timeline(t.returns.select("ts"), rebalances(t))


@query("strategy_parameters", "J14", "strategy:s trades:i max_weight min_weight turnover_target lookback_period:i top_n", "", """
SELECT s.*, trades FROM (VALUES ('mean_variance', 0.25, 0.01, 0.5, 252, NULL), ('risk_parity', 0.20, 0.02, 0.3, 252, NULL), ('momentum', 0.15, 0.0, 1.2, 126, 20),
  ('equal_weight', NULL, NULL, 0.1, 252, NULL)) s(strategy, max_weight, min_weight, turnover_target, lookback_period, top_n)
JOIN (SELECT CASE WHEN o_orderstatus = 'F' THEN 'momentum' WHEN o_orderstatus = 'O' THEN 'risk_parity' WHEN o_totalprice > 200000 THEN 'mean_variance' ELSE 'equal_weight' END AS strategy,
  count(*) AS trades FROM orders GROUP BY 1) USING (strategy)""")
def _(t):
    s = F.col("o_orderstatus")
    kind = F.when(s == "F", "momentum").when(s == "O", "risk_parity").when(F.col("o_totalprice") > 200000, "mean_variance").otherwise("equal_weight")
    used = t.read("orders").groupBy(kind.alias("strategy")).agg(F.count("*").alias("trades"))
    return used.join(wt.strategy_parameters(t.spark), "strategy").withColumn("top_n", F.try_element_at("constraints", F.lit("top_n_assets")))
