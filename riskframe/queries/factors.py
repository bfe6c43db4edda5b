"""Queries L1 to L18 and L28: factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import factors as fa
from riskframe.queries.base import query

MKT = "mk AS (SELECT ts, sum(cap * ret) / sum(cap) AS mkt FROM panel GROUP BY 1)"


def buckets(c: str, name: str, enough: int) -> str:
    cells = ", ".join(f"coalesce(sum(CASE WHEN b = '{b}' THEN cap * ret END) / sum(CASE WHEN b = '{b}' THEN cap END), 0) AS {b}" for b in fa.SIX_BUCKETS)
    return f"""{name} AS (SELECT ts, {cells} FROM (SELECT p.*, (CASE WHEN cap <= m THEN 'S' ELSE 'B' END) ||
    (CASE WHEN {c} <= q1 THEN 'L' WHEN {c} > q2 THEN 'H' ELSE 'M' END) AS b FROM panel p JOIN (SELECT ts, quantile_cont(cap, 0.5) AS m,
    quantile_cont({c}, 0.3) AS q1, quantile_cont({c}, 0.7) AS q2 FROM panel GROUP BY 1 HAVING count(*) > {enough}) USING (ts)) GROUP BY 1)"""


FT = f"""{MKT}, {buckets('bm', 'bb', 6)}, {buckets('prof', 'pb', 4)}, ft AS (SELECT ts, mkt, (SL + SM + SH) / 3 - (BL + BM + BH) / 3 AS smb,
  (SH + BH) / 2 - (SL + BL) / 2 AS hml FROM mk JOIN bb USING (ts)), fr AS (SELECT ts, (SH + BH) / 2 - (SL + BL) / 2 AS rmw FROM pb)"""


@query("market_factor", "L1", "ts:t MKT", "panel", f"WITH {MKT} SELECT ts, mkt AS MKT FROM mk")
def _(t):
    return fa.market_factor(t.panel)


@query("size_value_factors", "L2", "ts:t SMB HML", "panel", f"WITH {FT} SELECT ts, smb AS SMB, hml AS HML FROM ft")
def _(t):
    return fa.size_value_factors(t.panel)


@query("sorted_factors", "L3", "ts:t RMW CMA", "panel", f"""WITH {buckets('prof', 'pb', 4)}, {buckets('inv', 'ib', 4)}
SELECT ts, (pb.SH + pb.BH) / 2 - (pb.SL + pb.BL) / 2 AS RMW, (ib.SL + ib.BL) / 2 - (ib.SH + ib.BH) / 2 AS CMA FROM pb JOIN ib USING (ts)""")
def _(t):
    return fa.sort_factor(t.panel, "prof", "RMW").join(fa.sort_factor(t.panel, "inv", "CMA", "low"), "ts")


@query("factor_table", "L4", "ts:t MKT SMB HML RMW", "panel", f"WITH {FT} SELECT ts, mkt AS MKT, smb AS SMB, hml AS HML, rmw AS RMW FROM ft JOIN fr USING (ts)")
def _(t):
    return fa.factor_table(t.panel, profitability="prof")


@query("single_factor_fit", "L5 L6", "symbol:s n:i alpha beta_MKT r_squared residual_std t_alpha t_MKT", "panel", f"""
WITH {MKT}, j AS (SELECT symbol, ret AS y, mkt AS x FROM panel JOIN mk USING (ts)),
  s AS (SELECT symbol, count(*) AS n, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta_MKT, regr_r2(y, x) AS r_squared,
    regr_sxx(y, x) AS sxx, regr_syy(y, x) * (1 - regr_r2(y, x)) AS sse, avg(x) AS mx FROM j GROUP BY 1)
SELECT *, sqrt(sse / n) AS residual_std, beta_MKT / sqrt(sse / (n - 2) / sxx) AS t_MKT,
  alpha / sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)) AS t_alpha FROM s""")
def _(t):
    data = t.panel.select("symbol", "ts", "ret").join(fa.market_factor(t.panel), "ts")
    return fa.fit_ols(data, "symbol", "ret", ["MKT"])


def fit(t, **kwargs):
    data = t.panel.select("symbol", "ts", "ret").join(fa.factor_table(t.panel), "ts")
    return fa.fit_ols(data, "symbol", "ret", ["MKT", "SMB", "HML"], **kwargs)


@query("multi_factor_fit", "L5", "symbol:s n:i alpha beta_MKT beta_SMB beta_HML r_squared residual_std t_alpha t_MKT t_SMB t_HML")
def _(t):
    return fit(t)


def two_factor(ridge: float) -> str:
    return f"""WITH macro2 AS (SELECT ts, t10, t02 FROM macrow), j AS (SELECT symbol, 100 * ret AS y, t10 AS a, t02 AS b FROM panel JOIN macro2 USING (ts)),
  s AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) + {ridge} AS aa, covar_pop(b, b) * count(*) + {ridge} AS bb,
    covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy FROM j GROUP BY 1),
  c AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS beta_a, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS beta_b FROM s)
SELECT symbol, n, beta_a AS beta_t10, beta_b AS beta_t02, my - beta_a * ma - beta_b * mb AS alpha FROM c"""


def macro_fit(t, **kwargs):
    from riskframe.sources.readers import macro_wide
    data = t.panel.select("symbol", "ts", (100 * F.col("ret")).alias("ret")).join(macro_wide(t.macro, {"T10": "t10", "T02": "t02"}), "ts")
    return fa.fit_ols(data, "symbol", "ret", ["t10", "t02"], **kwargs)


@query("macro_ridge_fit", "L7", "symbol:s n:i alpha beta_t10 beta_t02", "panel macrow", two_factor(0.1))
def _(t):
    return macro_fit(t, ridge=0.1, enough=20)


@query("macro_fit", "L9", "symbol:s n:i alpha beta_t10 beta_t02", "panel macrow", two_factor(0.0))
def _(t):
    return macro_fit(t)


@query("principal_factors", "L10", "symbol:s factor:s loading")
def _(t):
    return fa.pca_factors(t.panel, 3)[0]


@query("principal_scores", "L10", "ts:t factor:s score")
def _(t):
    return fa.pca_factors(t.panel, 3, standardise=True)[1]


@query("specific_risk", "L11", "symbol:s specific_risk", "panel", f"""
WITH {MKT}, v AS (SELECT symbol, var_samp(ret) AS v, regr_slope(ret, mkt) * (SELECT stddev_samp(mkt) FROM mk) AS l FROM panel JOIN mk USING (ts) GROUP BY 1)
SELECT symbol, sqrt(greatest(v - l * l, 0)) AS specific_risk FROM v""")
def _(t):
    mk = fa.market_factor(t.panel)
    data = t.panel.select("symbol", "ts", "ret").join(mk, "ts")
    sd = mk.agg(F.stddev_samp("MKT").alias("_sd"))
    loads = data.groupBy("symbol").agg(F.regr_slope("ret", "MKT").alias("_b")).withColumn("_k", F.lit(1)).join(
        sd.withColumn("_k", F.lit(1)), "_k").select("symbol", F.lit("MKT").alias("factor"), (F.col("_b") * F.col("_sd")).alias("loading"))
    return fa.specific_risk(t.panel.groupBy("symbol").agg(F.var_samp("ret").alias("variance")), loads)


@query("custom_factors", "L12 U2", "ts:t momentum low_volatility", "rets", """
SELECT ts, avg(m) AS momentum, avg(v) AS low_volatility FROM (SELECT ts, CASE WHEN count(*) OVER a = 52 THEN sum(ret) OVER a END AS m,
  CASE WHEN count(*) OVER b = 60 THEN -stddev_samp(ret) OVER b END AS v FROM rets
  WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS 51 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)) GROUP BY 1""")
def _(t):
    return fa.custom_factor(t.returns, "momentum", n=52).join(fa.custom_factor(t.returns, "low_volatility"), "ts")


@query("custom_factor_fit", "L13", "symbol:s n:i alpha beta_reach r_squared", "rets bench", """
WITH j AS (SELECT symbol, rets.ret AS y, 100 * abs(bench.ret) AS x FROM rets JOIN bench USING (ts))
SELECT symbol, count(*) AS n, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta_reach, regr_r2(y, x) AS r_squared FROM j GROUP BY 1""")
def _(t):
    from riskframe.operators.align import with_benchmark
    from riskframe.operators.prep import FeatureRegistry
    registry = FeatureRegistry()
    registry.register("reach", lambda df: 100 * F.abs(df["bench"]))
    return fa.fit_ols(registry.add_to(with_benchmark(t.returns, t.benchmark)), "symbol", "ret", ["reach"])


@query("model_comparison", "L14", "symbol:s model:s alpha r_squared residual_std factors:i significant_factors:i")
def _(t):
    data = t.panel.select("symbol", "ts", "ret").join(fa.factor_table(t.panel), "ts")
    models = {"capm": ["MKT"], "three": ["MKT", "SMB", "HML"]}
    return fa.compare_models({name: (fa.fit_ols(data, "symbol", "ret", x), x) for name, x in models.items()})


@query("combined_loadings", "L15", "symbol:s factor:s loading", "panel macrow", f"""
WITH {MKT}, a AS (SELECT symbol, regr_slope(ret, mkt) AS b FROM panel JOIN mk USING (ts) GROUP BY 1),
  c AS (SELECT symbol, regr_slope(ret, t10) AS b FROM panel JOIN macrow USING (ts) GROUP BY 1)
SELECT symbol, 'capm_MKT' AS factor, 0.75 * b AS loading FROM a UNION ALL SELECT symbol, 'macro_t10', 0.25 * b FROM c""")
def _(t):
    from riskframe.sources.readers import macro_wide
    base = t.panel.select("symbol", "ts", "ret")
    capm = fa.betas_long(fa.fit_ols(base.join(fa.market_factor(t.panel), "ts"), "symbol", "ret", ["MKT"]), "symbol", ["MKT"])
    macro = fa.betas_long(fa.fit_ols(base.join(macro_wide(t.macro, {"T10": "t10"}), "ts"), "symbol", "ret", ["t10"]), "symbol", ["t10"])
    both = capm.withColumn("model", F.lit("capm")).unionByName(macro.withColumn("model", F.lit("macro")))
    return fa.combine_loadings(both, {"capm": 3.0, "macro": 1.0})


@query("factor_contributions", "L16", "symbol:s factor:s contribution", "panel", f"""
WITH {MKT}, a AS (SELECT symbol, count(*) AS n, regr_slope(ret, mkt) AS b, regr_intercept(ret, mkt) AS a FROM panel JOIN mk USING (ts) GROUP BY 1)
SELECT symbol, 'MKT' AS factor, b * (SELECT avg(mkt) FROM mk) * n AS contribution FROM a UNION ALL SELECT symbol, 'alpha', a * n FROM a""")
def _(t):
    mk = fa.market_factor(t.panel)
    fitted = fa.fit_ols(t.panel.select("symbol", "ts", "ret").join(mk, "ts"), "symbol", "ret", ["MKT"])
    return fa.factor_attribution(fitted, ["MKT"], mk)


@query("explained_variance", "L17", "series_id:s factor_total alpha_total explained_variance", "panel", f"""
WITH {MKT}, b AS (SELECT sum(b) AS b FROM (SELECT regr_slope(ret, mkt) AS b FROM panel JOIN mk USING (ts) GROUP BY symbol)),
  p AS (SELECT ts, sum(pw * ret) AS ret FROM panel GROUP BY 1), j AS (SELECT ret, mkt * b AS f FROM p JOIN mk USING (ts), b)
SELECT 'all' AS series_id, sum(f) AS factor_total, sum(ret - f) AS alpha_total, corr(ret, f) ** 2 AS explained_variance FROM j""")
def _(t):
    mk = fa.market_factor(t.panel)
    fitted = fa.fit_ols(t.panel.select("symbol", "ts", "ret").join(mk, "ts"), "symbol", "ret", ["MKT"])
    portfolio = t.panel.groupBy(F.lit("all").alias("series_id"), "ts").agg(F.sum(F.col("pw") * F.col("ret")).alias("ret"))
    daily = fa.daily_factor_contributions(portfolio, fa.betas_long(fitted, "symbol", ["MKT"]), mk)
    return fa.explained_variance(daily, "series_id")


@query("factor_significance", "L18", "symbol:s factor:s beta factor_return contribution t p_value significance:s")
def _(t):
    return fa.significance(fit(t, plain_t=True, enough=49), ["MKT", "SMB", "HML"], fa.factor_table(t.panel), "symbol")


BEHAVIOUR = """WITH j AS (SELECT symbol, bret AS y, prof AS s, ln(cap + 1) AS v FROM panel)
SELECT symbol, count(*) AS n, regr_intercept(y, s) AS sentiment_alpha, regr_slope(y, s) AS sentiment_beta, regr_r2(y, s) AS sentiment_r2,
  regr_intercept(abs(y), v) AS herding_alpha, regr_slope(abs(y), v) AS herding_beta, regr_r2(abs(y), v) AS herding_r2,
  regr_intercept(y, s) + regr_slope(y, s) * 0.5 AS sentiment_impact, regr_intercept(abs(y), v) + regr_slope(abs(y), v) * ln(1e6 + 1) AS herding_impact
FROM j GROUP BY 1 HAVING count(*) > 30"""


@query("behavioural_fit", "L28", "symbol:s n:i sentiment_alpha sentiment_beta sentiment_r2 herding_alpha herding_beta herding_r2 sentiment_impact herding_impact",
       "panel", BEHAVIOUR)
def _(t):
    fitted = fa.behavioural_fit(t.panel, "symbol", "bret", "prof", "cap")
    return fa.behavioural_impact(fitted, F.lit(0.5), F.lit(1e6))
