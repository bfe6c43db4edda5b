"""Queries D: return, risk and ratio measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import measures as m
from riskframe.operators import risk
from riskframe.plans.pairs import covariances, pair_moments
from riskframe.queries.base import query

Z05, Z01 = -1.6448536269514729, -2.3263478740408408
P = "portfolio_id"
RY = "sqrt(252.0)"

PROFILE = f"""
SELECT portfolio_id, periods, total_return, annualized_return, volatility, annualized_volatility,
  sharpe_ratio, sortino_ratio, var_95, skewness, kurtosis, omega_ratio, tail_ratio, win_rate, average_win,
  average_loss, abs(average_win / nullif(average_loss, 0)) AS win_loss_ratio, max_drawdown, cvar_95,
  CASE WHEN max_drawdown <> 0 THEN mean * 252 / abs(max_drawdown) WHEN mean <= 0 THEN 0 END AS calmar_ratio
FROM (SELECT portfolio_id, count(*) AS periods, product(1 + ret) - 1 AS total_return,
  product(1 + ret) ** (252.0 / count(*)) - 1 AS annualized_return, stddev_samp(ret) AS volatility,
  stddev_samp(ret) * {RY} AS annualized_volatility, avg(ret) AS mean,
  (avg(ret) - 0.02 / 252) / stddev_samp(ret) * {RY} AS sharpe_ratio,
  (avg(ret) - 0.02 / 252) * {RY} / sqrt(avg((ret - 0.02 / 252) ** 2) FILTER (ret - 0.02 / 252 < 0)) AS sortino_ratio,
  quantile_cont(ret, 0.05) AS var_95, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis,
  sum(greatest(ret, 0)) / abs(sum(least(ret, 0))) AS omega_ratio,
  abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)) AS tail_ratio,
  avg((ret > 0)::INT) AS win_rate, avg(ret) FILTER (ret > 0) AS average_win,
  avg(ret) FILTER (ret < 0) AS average_loss, min(dd_add) AS max_drawdown FROM dd GROUP BY 1) a
JOIN (SELECT d.portfolio_id, avg(d.ret) AS cvar_95 FROM dd d JOIN (SELECT portfolio_id, quantile_cont(ret, 0.05) AS v
  FROM dd GROUP BY 1) q USING (portfolio_id) WHERE d.ret <= q.v GROUP BY 1) t USING (portfolio_id)"""


@query("portfolio_profile", "C4 D22", "portfolio_id:s periods:i total_return annualized_return volatility "
       "annualized_volatility sharpe_ratio sortino_ratio var_95 skewness kurtosis omega_ratio tail_ratio win_rate "
       "average_win average_loss win_loss_ratio max_drawdown cvar_95 calmar_ratio", "dd", PROFILE)
def _(t):
    return risk.performance_profile(t.portfolio_returns, P)


@query("value_at_risk_methods", "D1 D2 D3", "portfolio_id:s historical parametric cornish_fisher", "prets", f"""
SELECT portfolio_id, quantile_cont(ret, 0.05) AS historical, avg(ret) + {Z05} * stddev_pop(ret) AS parametric,
  avg(ret) + ({Z05} + ({Z05} ** 2 - 1) * s / 6 + ({Z05} ** 3 - 3 * {Z05}) * k / 24
    - (2 * {Z05} ** 3 - 5 * {Z05}) * s * s / 36) * stddev_pop(ret) AS cornish_fisher
FROM (SELECT p.*, avg(z ** 3) OVER w AS s, avg(z ** 4) OVER w - 3 AS k FROM (
  SELECT *, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z FROM prets WINDOW w AS (PARTITION BY portfolio_id)) p
  WINDOW w AS (PARTITION BY portfolio_id)) GROUP BY portfolio_id, s, k""")
def _(t):
    return t.portfolio_returns.groupBy(P).agg(
        m.var_historical("ret").alias("historical"), m.var_parametric("ret").alias("parametric"),
        m.var_cornish_fisher("ret").alias("cornish_fisher"))


@query("expected_shortfall", "D4", "portfolio_id:s p var cvar", "prets", """
SELECT q.portfolio_id, q.p, q.v AS var, avg(r.ret) AS cvar FROM prets r JOIN (
  SELECT portfolio_id, unnest([0.01, 0.05, 0.10]) AS p, unnest(quantile_cont(ret, [0.01, 0.05, 0.10])) AS v
  FROM prets GROUP BY 1) q ON q.portfolio_id = r.portfolio_id AND r.ret <= q.v GROUP BY 1, 2, 3""")
def _(t):
    return risk.tail_table(t.portfolio_returns, P, probs=(0.01, 0.05, 0.10))


@query("max_drawdown_dates", "D5", "portfolio_id:s max_drawdown start_date:t end_date:t", "dd", """
SELECT e.portfolio_id, e.dd_add AS max_drawdown, e.ts AS end_date,
  (SELECT arg_max(d.ts, d.w) FROM dd d WHERE d.portfolio_id = e.portfolio_id AND d.ts <= e.ts) AS start_date
FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY dd_add, ts) AS k FROM dd) e WHERE k = 1""")
def _(t):
    return risk.max_drawdown_dates(t.portfolio_returns, P)


@query("drawdown_ratios", "D6 D7 D13 D14", "portfolio_id:s max_drawdown max_drawdown_relative calmar_ratio pain_index "
       "ulcer_index burke_ratio", "dd", f"""
SELECT portfolio_id, min(dd_add) AS max_drawdown, min(dd_rel) AS max_drawdown_relative,
  avg(ret) * 252 / abs(min(dd_add)) AS calmar_ratio, avg(abs(dd_rel)) AS pain_index,
  sqrt(avg(dd_rel ** 2)) AS ulcer_index, avg(ret) * {RY} / sqrt(avg(dd_rel ** 2)) AS burke_ratio
FROM dd GROUP BY 1""")
def _(t):
    return risk.drawdown_table(t.portfolio_returns, P)


@query("ratio_measures", "D8 D9 D10 D11 D12", "portfolio_id:s sortino omega tail_ratio semi_variance semi_deviation "
       "upside_deviation gain_loss_ratio win_rate average_win average_loss win_loss_ratio", "prets", f"""
SELECT portfolio_id, avg(ret) * {RY} / sqrt(avg(ret ** 2) FILTER (ret < 0)) AS sortino,
  sum(greatest(ret, 0)) / -sum(least(ret, 0)) AS omega,
  abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)) AS tail_ratio,
  1e6 * avg(ret ** 2) FILTER (ret < 0) AS semi_variance, sqrt(avg(ret ** 2) FILTER (ret < 0)) AS semi_deviation,
  sqrt(avg(ret ** 2) FILTER (ret > 0)) AS upside_deviation,
  avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) AS gain_loss_ratio, avg((ret > 0)::INT) AS win_rate,
  avg(ret) FILTER (ret > 0) AS average_win, avg(ret) FILTER (ret < 0) AS average_loss,
  avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) AS win_loss_ratio FROM prets GROUP BY 1""")
def _(t):
    return t.portfolio_returns.groupBy(P).agg(
        m.sortino("ret").alias("sortino"), m.omega("ret").alias("omega"), m.tail_ratio("ret").alias("tail_ratio"),
        (1e6 * m.semi_variance("ret")).alias("semi_variance"), m.semi_deviation("ret").alias("semi_deviation"),
        m.upside_deviation("ret").alias("upside_deviation"), m.gain_loss_ratio("ret").alias("gain_loss_ratio"),
        m.win_rate("ret").alias("win_rate"), m.average_win("ret").alias("average_win"),
        m.average_loss("ret").alias("average_loss"), m.win_loss_ratio("ret").alias("win_loss_ratio"))


@query("risk_rollup", "D8 D9 rollup", "portfolio_id:s year:i n:i sharpe omega", "prets", f"""
SELECT portfolio_id, year(ts) AS year, count(*) AS n,
  coalesce((avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0), 0) * {RY} AS sharpe,
  sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0) AS omega FROM prets GROUP BY ROLLUP (portfolio_id, year(ts))""")
def _(t):
    return (t.portfolio_returns.withColumn("year", F.year("ts")).rollup(P, "year")
            .agg(F.count("*").alias("n"), m.sharpe("ret").alias("sharpe"), m.omega("ret").alias("omega")))


@query("conditional_drawdown", "D15", "portfolio_id:s cdar", "dd", """
SELECT portfolio_id, avg(-dd_rel) FILTER (-dd_rel >= c) AS cdar FROM dd JOIN (
  SELECT portfolio_id, quantile_cont(-dd_rel, 0.95) AS c FROM dd GROUP BY 1) USING (portfolio_id) GROUP BY 1""")
def _(t):
    return risk.conditional_drawdown(t.portfolio_returns, P)


COV = """cov AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) * 252 AS cov,
  corr(a.ret, b.ret) AS corr, count(*) AS n FROM rets a JOIN rets b USING (ts) GROUP BY 1, 2)"""


def with_cov(body: str) -> str:
    return f"WITH {COV} {body}"


def cov_of(t):
    return covariances(pair_moments(t.returns), scale=252.0)


@query("diversification", "D16", "portfolio_id:s portfolio_volatility diversification_ratio", "rets lw", with_cov("""
SELECT a.portfolio_id, sqrt(sum(a.weight * b.weight * cov)) AS portfolio_volatility,
  sum(CASE WHEN i = j THEN a.weight * sqrt(cov) END) / sqrt(sum(a.weight * b.weight * cov)) AS diversification_ratio
FROM cov JOIN lw a ON a.symbol = i JOIN lw b ON b.symbol = j AND a.portfolio_id = b.portfolio_id GROUP BY 1"""))
def _(t):
    return risk.diversification_ratio(t.latest_weights, cov_of(t))


@query("effective_assets", "D17", "portfolio_id:s ts:t herfindahl effective_assets", "wts", """
SELECT portfolio_id, ts, sum(weight ** 2) AS herfindahl, 1 / sum(weight ** 2) AS effective_assets FROM wts GROUP BY 1, 2""")
def _(t):
    return risk.concentration(t.weights, [P, "ts"])


@query("regime_var", "D18 C16", "portfolio_id:s regime:i n:i var", "preg", """
SELECT portfolio_id, regime, count(*) AS n, CASE WHEN count(*) > 10 THEN quantile_cont(ret, 0.05) END AS var
FROM preg GROUP BY 1, 2""")
def _(t):
    return risk.conditional_var(t.portfolio_regimes, [P, "regime"])


@query("portfolio_risk_metrics", "D19", "portfolio_id:s annualized_volatility information_ratio var_1_parametric "
       "var_5_parametric var_1 var_5 var_10 cvar_1 cvar_5 cvar_10 maximum_drawdown calmar_ratio omega_ratio "
       "semi_deviation skewness kurtosis", "dd", f"""
SELECT portfolio_id, stddev_samp(ret) * {RY} AS annualized_volatility, avg(ret) / stddev_pop(ret) AS information_ratio,
  avg(ret) + {Z01} * stddev_pop(ret) AS var_1_parametric, avg(ret) + {Z05} * stddev_pop(ret) AS var_5_parametric,
  max(v1) AS var_1, max(v5) AS var_5, max(v10) AS var_10, avg(ret) FILTER (ret <= v1) AS cvar_1,
  avg(ret) FILTER (ret <= v5) AS cvar_5, avg(ret) FILTER (ret <= v10) AS cvar_10, min(dd_add) AS maximum_drawdown,
  avg(ret) * 252 / abs(min(dd_add)) AS calmar_ratio, sum(greatest(ret, 0)) / -sum(least(ret, 0)) AS omega_ratio,
  sqrt(avg(ret ** 2) FILTER (ret < 0)) AS semi_deviation, avg(z ** 3) AS skewness, kurtosis_pop(ret) AS kurtosis
FROM (SELECT *, quantile_cont(ret, 0.01) OVER w AS v1, quantile_cont(ret, 0.05) OVER w AS v5,
  quantile_cont(ret, 0.1) OVER w AS v10, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z
  FROM dd WINDOW w AS (PARTITION BY portfolio_id)) GROUP BY 1""")
def _(t):
    return risk.portfolio_risk_metrics(t.portfolio_returns)


@query("risk_contributions", "D20", "portfolio_id:s symbol:s weight marginal component percentage", "rets lw", with_cov("""
SELECT portfolio_id, symbol, weight, marginal, weight * marginal AS component,
  weight * marginal / sum(weight * marginal) OVER (PARTITION BY portfolio_id) AS percentage FROM (
  SELECT a.portfolio_id, a.symbol, max(a.weight) AS weight, sum(cov * b.weight) AS marginal FROM cov
  JOIN lw a ON a.symbol = i JOIN lw b ON b.symbol = j AND a.portfolio_id = b.portfolio_id GROUP BY 1, 2)"""))
def _(t):
    return risk.component_contributions(t.latest_weights, cov_of(t))


@query("contributions_from_returns", "D20 C4", "portfolio_id:s symbol:s percentage", "rets lw", """
WITH j AS (SELECT lw.portfolio_id, symbol, ts, weight, ret,
    sum(weight * ret) OVER (PARTITION BY lw.portfolio_id, ts) AS rp FROM lw JOIN rets USING (symbol)),
  c AS (SELECT portfolio_id, symbol, max(weight) * covar_samp(ret, rp) AS part FROM j GROUP BY 1, 2)
SELECT portfolio_id, symbol, part / sum(part) OVER (PARTITION BY portfolio_id) AS percentage FROM c""")
def _(t):
    return risk.contributions_from_returns(t.latest_weights, t.returns)


@query("risk_decomposition", "D21 F4", "portfolio_id:s total_risk herfindahl_index effective_bets max_contribution "
       "top_3_concentration", "rets lw", with_cov("""
SELECT portfolio_id, sqrt(sum(part)) AS total_risk, sum(pc ** 2) AS herfindahl_index, 1 / sum(pc ** 2) AS effective_bets,
  max(pc) AS max_contribution, sum(pc) FILTER (k <= 3) AS top_3_concentration FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY pc DESC, symbol) AS k FROM (
  SELECT *, part / sum(part) OVER (PARTITION BY portfolio_id) AS pc FROM (
  SELECT a.portfolio_id, a.symbol, sum(a.weight * cov * b.weight) AS part FROM cov JOIN lw a ON a.symbol = i
  JOIN lw b ON b.symbol = j AND a.portfolio_id = b.portfolio_id GROUP BY 1, 2))) GROUP BY 1"""))
def _(t):
    return risk.bets_summary(risk.risk_decomposition(t.latest_weights, cov_of(t)))


@query("benchmark_metrics", "C2 D23 D24", "portfolio_id:s alpha information_ratio tracking_error beta correlation "
       "up_capture down_capture", "al", f"""
SELECT portfolio_id, product(1 + ret) ** (252.0 / count(*)) - product(1 + bench) ** (252.0 / count(*)) AS alpha,
  avg(ret - bench) / stddev_samp(ret - bench) * {RY} AS information_ratio,
  stddev_samp(ret - bench) * {RY} AS tracking_error, covar_samp(ret, bench) / var_pop(bench) AS beta,
  corr(ret, bench) AS correlation,
  (product(1 + ret) FILTER (bench > 0) - 1) / (product(1 + bench) FILTER (bench > 0) - 1) AS up_capture,
  (product(1 + ret) FILTER (bench < 0) - 1) / (product(1 + bench) FILTER (bench < 0) - 1) AS down_capture
FROM al GROUP BY 1""")
def _(t):
    return t.aligned.groupBy(P).agg(*m.benchmark_set())


@query("benchmark_comparison", "D25 D26", "portfolio_id:s alpha_capm beta correlation tracking_error_daily up_capture "
       "down_capture", "al", """
SELECT portfolio_id, (avg(ret) - 0.02 / 252 - covar_samp(ret, bench) / var_pop(bench) * (avg(bench) - 0.02 / 252)) * 252
  AS alpha_capm, covar_samp(ret, bench) / var_pop(bench) AS beta, corr(ret, bench) AS correlation,
  stddev_pop(ret - bench) AS tracking_error_daily, avg(ret) FILTER (bench > 0) / avg(bench) FILTER (bench > 0) AS up_capture,
  avg(ret) FILTER (bench < 0) / avg(bench) FILTER (bench < 0) AS down_capture FROM al GROUP BY 1""")
def _(t):
    return risk.benchmark_comparison(t.aligned)


@query("dashboard_metrics", "D27", "portfolio_id:s daily_volatility var_1 var_5 cvar_1 cvar_5 var_5_parametric "
       "var_5_cornish_fisher maximum_drawdown pain_index ulcer_index cdar diversification_ratio herfindahl "
       "effective_assets", "dd rets lw", with_cov(f"""
SELECT *, avg_ret + ({Z05} + ({Z05} ** 2 - 1) * s / 6 + ({Z05} ** 3 - 3 * {Z05}) * k / 24
    - (2 * {Z05} ** 3 - 5 * {Z05}) * s * s / 36) * daily_volatility AS var_5_cornish_fisher FROM (
  SELECT portfolio_id, stddev_pop(ret) AS daily_volatility, max(v1) AS var_1, max(v5) AS var_5, avg(ret) AS avg_ret,
    avg(ret) FILTER (ret <= v1) AS cvar_1, avg(ret) FILTER (ret <= v5) AS cvar_5,
    avg(ret) + {Z05} * stddev_pop(ret) AS var_5_parametric, min(dd_add) AS maximum_drawdown,
    avg(abs(dd_rel)) AS pain_index, sqrt(avg(dd_rel ** 2)) AS ulcer_index, avg(-dd_rel) FILTER (-dd_rel >= c) AS cdar,
    avg(z ** 3) AS s, kurtosis_pop(ret) AS k
  FROM (SELECT *, quantile_cont(ret, 0.01) OVER w AS v1, quantile_cont(ret, 0.05) OVER w AS v5,
    quantile_cont(-dd_rel, 0.95) OVER w AS c, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z
    FROM dd WINDOW w AS (PARTITION BY portfolio_id)) GROUP BY 1)
JOIN (SELECT a.portfolio_id, sum(CASE WHEN i = j THEN a.weight * sqrt(cov) END)
    / sqrt(sum(a.weight * b.weight * cov)) AS diversification_ratio FROM cov JOIN lw a ON a.symbol = i
    JOIN lw b ON b.symbol = j AND a.portfolio_id = b.portfolio_id GROUP BY 1) USING (portfolio_id)
JOIN (SELECT portfolio_id, sum(weight ** 2) AS herfindahl, 1 / sum(weight ** 2) AS effective_assets
    FROM lw GROUP BY 1) USING (portfolio_id)"""))
def _(t):
    return risk.dashboard_metrics(t.portfolio_returns, t.latest_weights, cov_of(t))


@query("metric_history", "D28", "portfolio_id:s ts:t volatility", "prets", """
SELECT portfolio_id, ts, volatility FROM (SELECT portfolio_id, date_trunc('month', ts)::TIMESTAMP AS ts,
  stddev_samp(ret) AS volatility FROM prets GROUP BY 1, 2)
WHERE ts > (SELECT date_trunc('month', max(ts)) FROM prets) - INTERVAL 30 DAY""")
def _(t):
    monthly = t.portfolio_returns.groupBy(P, F.date_trunc("month", "ts").alias("_m")).agg(
        F.stddev_samp("ret").alias("volatility")).withColumnRenamed("_m", "ts")
    latest = monthly.groupBy(P).agg(F.max_by("volatility", "ts").alias("volatility"), F.max("ts").alias("ts"))
    known = monthly.join(latest.select(P, "ts"), [P, "ts"], "left_anti")
    now = t.benchmark.agg(F.date_trunc("month", F.max("ts"))).scalar()
    return risk.metric_history(known, latest.select(P, "ts", "volatility").withColumnsRenamed({}), now)


STYLE_SQL = """SELECT portfolio_id, style, tr AS total_return, CASE style WHEN 'simple' THEN (1 + mean) ** 252 - 1 ELSE ann END
    AS annualized_return, CASE style WHEN 'analyzer' THEN (ann - 0.02) / vol WHEN 'engine' THEN ann / vol
    ELSE ((1 + mean) ** 252 - 1) / vol END AS sharpe_ratio,
  CASE style WHEN 'analyzer' THEN (ann - 0.02) / down_rf WHEN 'engine' THEN ann / down_0 END AS sortino_ratio,
  mdd AS max_drawdown FROM (SELECT portfolio_id, product(1 + ret) - 1 AS tr, avg(ret) AS mean,
    product(1 + ret) ** (252.0 / count(*)) - 1 AS ann, stddev_samp(ret) * sqrt(252.0) AS vol,
    stddev_samp(ret) FILTER (ret < 0.02 / 252) * sqrt(252.0) AS down_rf,
    stddev_samp(ret) FILTER (ret < 0) * sqrt(252.0) AS down_0, min(dd_rel) AS mdd FROM dd GROUP BY 1)
  CROSS JOIN (VALUES ('analyzer'), ('engine'), ('simple')) s(style)"""


@query("metric_styles", "D29 D30 D44", "portfolio_id:s style:s total_return annualized_return sharpe_ratio sortino_ratio "
       "max_drawdown", "dd", STYLE_SQL)
def _(t):
    path = risk.drawdown_path(t.portfolio_returns, P)
    out = None
    for style in ("analyzer", "engine", "simple"):
        part = path.groupBy(P).agg(*m.styled_set("ret", style, dd="dd_rel")).withColumn("style", F.lit(style))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@query("confidence_tails", "D29 D30", "portfolio_id:s var_10 var_5 var_1 cvar_10 cvar_5 cvar_1", "prets", """
SELECT portfolio_id, max(a) AS var_10, max(b) AS var_5, max(c) AS var_1, avg(ret) FILTER (ret <= a) AS cvar_10,
  avg(ret) FILTER (ret <= b) AS cvar_5, avg(ret) FILTER (ret <= c) AS cvar_1 FROM (
  SELECT *, quantile_cont(ret, 0.1) OVER w AS a, quantile_cont(ret, 0.05) OVER w AS b, quantile_cont(ret, 0.01) OVER w AS c
  FROM prets WINDOW w AS (PARTITION BY portfolio_id)) GROUP BY 1""")
def _(t):
    return risk.tail_columns(t.portfolio_returns, P, probs=(0.10, 0.05, 0.01))


@query("excess_summary", "D31", "portfolio_id:s total_excess_return avg_excess_return excess_volatility information_ratio "
       "outperformance_rate best_excess worst_excess", "al", f"""
SELECT portfolio_id, sum(ret - bench) AS total_excess_return, avg(ret - bench) AS avg_excess_return,
  stddev_samp(ret - bench) * {RY} AS excess_volatility, avg(ret - bench) / stddev_samp(ret - bench) * {RY} AS information_ratio,
  avg((ret > bench)::INT) AS outperformance_rate, max(ret - bench) AS best_excess, min(ret - bench) AS worst_excess
FROM al GROUP BY 1""")
def _(t):
    return risk.excess_summary(t.aligned)


SHOCKS = {"drop": {"1-URGENT": -0.3, "2-HIGH": -0.2}, "rise": {"5-LOW": 0.1}, "calm": {}}


@query("stress_tests", "D32", "portfolio_id:s scenario:s portfolio_return portfolio_var_5 portfolio_volatility max_drawdown",
       "rets lw", """
WITH s(scenario, symbol, shock) AS (VALUES ('drop', '1-URGENT', -0.3), ('drop', '2-HIGH', -0.2), ('rise', '5-LOW', 0.1)),
  x AS (SELECT portfolio_id, scenario, ts, sum(weight * (ret + coalesce((SELECT max(shock) FROM s
    WHERE s.scenario = n.scenario AND s.symbol = rets.symbol), 0))) AS ret
    FROM lw JOIN rets USING (symbol) CROSS JOIN (VALUES ('drop'), ('rise'), ('calm')) n(scenario) GROUP BY 1, 2, 3),
  c AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id, scenario ORDER BY ts) AS w FROM x),
  d AS (SELECT *, w - max(w) OVER (PARTITION BY portfolio_id, scenario ORDER BY ts) AS dd FROM c)
SELECT portfolio_id, scenario, arg_max(ret, ts) AS portfolio_return, quantile_cont(ret, 0.05) AS portfolio_var_5,
  stddev_pop(ret) AS portfolio_volatility, min(dd) AS max_drawdown FROM d GROUP BY 1, 2""")
def _(t):
    return risk.stress_tests(t.latest_weights, t.returns, SHOCKS)


@query("uniform_stress", "D33", "portfolio_id:s scenario:s stressed_return", "rets lw", """
SELECT portfolio_id, scenario, sum(weight * (r + shock)) AS stressed_return FROM lw
JOIN (SELECT symbol, avg(ret) AS r FROM rets GROUP BY 1) USING (symbol)
CROSS JOIN (VALUES ('crash', -0.2), ('correction', -0.1), ('rally', 0.05)) s(scenario, shock) GROUP BY 1, 2""")
def _(t):
    means = t.returns.groupBy("symbol").agg(F.avg("ret").alias("ret"))
    return risk.uniform_stress(t.latest_weights, means, {"crash": -0.2, "correction": -0.1, "rally": 0.05})


@query("risk_return_points", "D34", "symbol:s annual_return annual_volatility", "rets", f"""
SELECT symbol, avg(ret) * 252 AS annual_return, stddev_samp(ret) * {RY} AS annual_volatility FROM rets GROUP BY 1""")
def _(t):
    return risk.risk_return_points(t.returns, "symbol")


@query("volatility_patterns", "D35", "symbol:s avg_volatility volatility_std max_volatility min_volatility "
       "vol_autocorrelation high_vol_periods:i low_vol_periods:i vol_regime_persistence", "rets", f"""
WITH v AS (SELECT *, CASE WHEN count(ret) OVER n = 20 THEN stddev_samp(ret) OVER n * {RY} END AS v, ret ** 2 AS q,
    lag(ret ** 2) OVER (PARTITION BY symbol ORDER BY ts) AS q1 FROM rets
    WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
  c AS (SELECT symbol, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.75) AS hi
    FROM v GROUP BY 1),
  h AS (SELECT *, coalesce(v > mid, false)::INT AS high FROM v JOIN c USING (symbol)),
  g AS (SELECT *, coalesce((high = lag(high) OVER (PARTITION BY symbol ORDER BY ts))::INT, 1) AS same FROM h)
SELECT symbol, avg(v) AS avg_volatility, stddev_samp(v) AS volatility_std, max(v) AS max_volatility,
  min(v) AS min_volatility, corr(q, q1) AS vol_autocorrelation, count(*) FILTER (v > hi) AS high_vol_periods,
  count(*) FILTER (v < lo) AS low_vol_periods, avg(same) AS vol_regime_persistence FROM g GROUP BY 1""")
def _(t):
    return risk.volatility_patterns(t.returns, "symbol")


@query("correlation_summary", "D36", "portfolio_id:s static_correlation avg_rolling_correlation correlation_volatility "
       "max_correlation min_correlation", "al", """
SELECT portfolio_id, corr(ret, bench) AS static_correlation, avg(c) AS avg_rolling_correlation,
  stddev_samp(c) AS correlation_volatility, max(c) AS max_correlation, min(c) AS min_correlation FROM (
  SELECT *, CASE WHEN count(*) OVER w = 60 THEN corr(ret, bench) OVER w END AS c FROM al
  WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts ROWS 59 PRECEDING)) GROUP BY 1""")
def _(t):
    return risk.correlation_summary(t.aligned, P)


@query("trade_statistics", "D37", "portfolio_id:s total_trades:i total_volume:m avg_trade_size:m trade_size_volatility:m "
       "median_trade_size:m total_commission:m total_market_impact:m buy_trades:i sell_trades:i buy_volume:m "
       "sell_volume:m cost_ratio trades_per_rebalance", "tx", """
SELECT portfolio_id, count(*) AS total_trades, sum(value) AS total_volume, avg(value) AS avg_trade_size,
  stddev_samp(value) AS trade_size_volatility, quantile_cont(value, 0.5) AS median_trade_size,
  sum(commission) AS total_commission, sum(impact) AS total_market_impact, count(*) FILTER (side = 'Buy') AS buy_trades,
  count(*) FILTER (side = 'Sell') AS sell_trades, sum(value) FILTER (side = 'Buy') AS buy_volume,
  sum(value) FILTER (side = 'Sell') AS sell_volume, sum(commission + impact) / sum(value) AS cost_ratio,
  count(*) / count(DISTINCT ts) AS trades_per_rebalance FROM tx GROUP BY 1""")
def _(t):
    return risk.trade_statistics(t.transactions)


@query("compliance_checks", "D38", "portfolio_id:s rule:s value limit_value compliant:b", "lw", """
SELECT portfolio_id, 'max_position_size' AS rule, max(weight) AS value, 0.2 AS limit_value, max(weight) <= 0.2 + 1e-12 AS compliant
FROM lw GROUP BY 1 UNION ALL
SELECT portfolio_id, 'leverage', sum(abs(weight)), 1.0, sum(abs(weight)) <= 1.0 + 1e-12 FROM lw GROUP BY 1""")
def _(t):
    return risk.compliance_checks(t.latest_weights, max_position=0.2)


@query("limit_breaches", "D39", "portfolio_id:s metric:s value severity:s", "dd", """
SELECT *, CASE WHEN value > 1.5 * lim THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (
  SELECT portfolio_id, 'var' AS metric, abs(quantile_cont(ret, 0.05)) AS value, 0.001 AS lim FROM dd GROUP BY 1 UNION ALL
  SELECT portfolio_id, 'volatility', stddev_samp(ret), 0.0012 FROM dd GROUP BY 1 UNION ALL
  SELECT portfolio_id, 'drawdown', abs(min(dd_rel)), 0.005 FROM dd GROUP BY 1) WHERE value > lim""")
def _(t):
    table = risk.drawdown_path(t.portfolio_returns, P).groupBy(P).agg(
        m.var_historical("ret").alias("var"), F.stddev_samp("ret").alias("volatility"), F.min("dd_rel").alias("drawdown"))
    return risk.limit_breaches(table, {"var": 0.001, "volatility": 0.0012, "drawdown": 0.005})


@query("portfolio_gauges", "D40", "portfolio_id:s last_return annualized_volatility sharpe_ratio max_drawdown var_95 var_99 "
       "expected_shortfall", "dd", f"""
SELECT portfolio_id, arg_max(ret, ts) AS last_return, stddev_samp(ret) * {RY} AS annualized_volatility,
  (avg(ret) - 0.02 / 252) / stddev_samp(ret) * {RY} AS sharpe_ratio, min(dd_rel) AS max_drawdown, max(a) AS var_95,
  max(b) AS var_99, avg(ret) FILTER (ret <= a) AS expected_shortfall FROM (
  SELECT *, quantile_cont(ret, 0.05) OVER w AS a, quantile_cont(ret, 0.01) OVER w AS b FROM dd
  WINDOW w AS (PARTITION BY portfolio_id)) GROUP BY 1""")
def _(t):
    return risk.gauges(t.portfolio_returns)


@query("hedge_effectiveness", "D41", "portfolio_id:s volatility_reduction var_reduction drawdown_reduction return_impact "
       "risk_adjusted_improvement hedge_cost_ratio net_benefit", "al", f"""
WITH h AS (SELECT *, ret - 0.5 * bench AS hedged FROM al),
  c AS (SELECT *, product(1 + ret) OVER w AS wu, product(1 + hedged) OVER w AS wh FROM h
    WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts)),
  d AS (SELECT *, wu - max(wu) OVER w AS du, wh - max(wh) OVER w AS dh FROM c
    WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts)),
  s AS (SELECT portfolio_id, stddev_samp(ret) * {RY} AS vu, stddev_samp(hedged) * {RY} AS vh,
    abs(quantile_cont(ret, 0.05)) AS qu, abs(quantile_cont(hedged, 0.05)) AS qh, abs(min(du)) AS du, abs(min(dh)) AS dh,
    avg(ret) AS mu, avg(hedged) AS mh, 0.0001 / abs(sum(ret)) AS share FROM d GROUP BY 1)
SELECT portfolio_id, (vu - vh) / vu AS volatility_reduction, (qu - qh) / qu AS var_reduction,
  (du - dh) / du AS drawdown_reduction, mh - mu AS return_impact, mh / vh - mu / vu AS risk_adjusted_improvement,
  share AS hedge_cost_ratio, (vu - vh) / vu - share AS net_benefit FROM s""")
def _(t):
    hedged = t.aligned.withColumn("hedged", F.col("ret") - 0.5 * F.col("bench"))
    return risk.hedge_effectiveness(hedged, P, cost=0.0001)


@query("simulation_summary", "D42", "metric:s mean std min max p5 p25 p50 p75 p95", "prets", """
SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM (
  SELECT portfolio_id, year(ts) AS sim, 'total_return' AS metric, product(1 + ret) - 1 AS value FROM prets GROUP BY 1, 2
  UNION ALL SELECT portfolio_id, year(ts), 'volatility', stddev_samp(ret) FROM prets GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    per = t.portfolio_returns.groupBy(P, F.year("ts").alias("sim")).agg(
        m.total_return("ret").alias("total_return"), F.stddev_samp("ret").alias("volatility"))
    return risk.simulation_summary(per.unpivot([P, "sim"], ["total_return", "volatility"], "metric", "value"))


@query("path_statistics", "D43", "portfolio_id:s paths:i mean std min max probability_of_loss expected_loss "
       "expected_profit ci_low median ci_high", "prets", """
WITH f AS (SELECT portfolio_id, year(ts) * 12 + month(ts) AS sim, product(1 + ret) AS f FROM prets GROUP BY 1, 2)
SELECT portfolio_id, count(*) AS paths, avg(f) AS mean, stddev_pop(f) AS std, min(f) AS min, max(f) AS max,
  avg((f < 1)::INT) AS probability_of_loss, avg(f - 1) FILTER (f < 1) AS expected_loss,
  avg(f - 1) FILTER (f > 1) AS expected_profit, quantile_cont(f, 0.025) AS ci_low, quantile_cont(f, 0.5) AS median,
  quantile_cont(f, 0.975) AS ci_high FROM f GROUP BY 1""")
def _(t):
    from riskframe.plans.windows import running
    paths = t.portfolio_returns.withColumn("sim_id", F.year("ts") * 12 + F.month("ts"))
    paths = paths.withColumn("value", F.product(1 + F.col("ret")).over(running([P, "sim_id"])))
    return risk.path_statistics(paths, P, step="ts")
