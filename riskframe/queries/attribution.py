"""Queries L19 to L30: attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import attribution as at
from riskframe.queries.base import query

P = "portfolio_id"
RY = "sqrt(252.0)"
EFFECTS = "allocation_effect selection_effect interaction_effect"
BRINSON = """sum((pw - bw) * bret) AS allocation_effect, sum(bw * (ret - bret)) AS selection_effect,
  sum((pw - bw) * (ret - bret)) AS interaction_effect, sum(pw * ret - bw * bret) AS total_contribution"""
SECTOR = """sp AS (SELECT ts, sector, sum(pw) AS pw, sum(bw) AS bw, coalesce(sum(pw * ret) / nullif(sum(pw), 0), 0) AS ret,
  coalesce(sum(bw * bret) / nullif(sum(bw), 0), 0) AS bret FROM panel GROUP BY 1, 2)"""


@query("brinson_assets", "L19", f"symbol:s {EFFECTS} total_contribution", "panel", f"SELECT symbol, {BRINSON} FROM panel GROUP BY ROLLUP (symbol)")
def _(t):
    return at.brinson(t.panel)


@query("brinson_sectors", "L20 C6", f"sector:s {EFFECTS} total_contribution", "panel",
       f"WITH {SECTOR} SELECT sector, {BRINSON} FROM sp GROUP BY ROLLUP (sector)")
def _(t):
    return at.sector_brinson(t.panel)


DAILY = f"""WITH {SECTOR}, o AS (SELECT *, sum(bw * bret) OVER d AS rb, avg(bret) OVER d AS mean FROM sp WINDOW d AS (PARTITION BY ts)),
  e AS (SELECT ts, sum((pw - bw) * (bret - rb)) AS allocation_effect, sum(bw * (bret - mean)) AS selection_effect,
    sum((pw - bw) * (bret - mean)) AS interaction_effect FROM o GROUP BY 1)"""


@query("brinson_daily", "L21", f"ts:t {EFFECTS} total_effect", "panel", DAILY + """
SELECT *, allocation_effect + selection_effect + interaction_effect AS total_effect FROM e""")
def _(t):
    return at.daily_brinson(at.to_groups(t.panel))


@query("brinson_cumulative", "L21 L27", f"ts:t {EFFECTS}", "panel", DAILY + """
SELECT ts, sum(allocation_effect) OVER w AS allocation_effect, sum(selection_effect) OVER w AS selection_effect,
  sum(interaction_effect) OVER w AS interaction_effect FROM e WINDOW w AS (ORDER BY ts)""")
def _(t):
    return at.full_attribution(t.panel, t.portfolio_regimes, P)["cumulative"]


@query("regime_contributions", "L22", "portfolio_id:s regime:i contribution avg_active_return periods:i frequency portfolio_return "
       "benchmark_return volatility allocation_effect selection_effect", "preg", """
SELECT *, frequency * benchmark_return * periods AS allocation_effect, contribution - frequency * benchmark_return * periods AS selection_effect
FROM (SELECT portfolio_id, regime, sum(ret - bench) AS contribution, avg(ret - bench) AS avg_active_return, count(*) AS periods,
  count(*) / sum(count(*)) OVER (PARTITION BY portfolio_id) AS frequency, avg(ret) AS portfolio_return, avg(bench) AS benchmark_return,
  stddev_samp(ret - bench) AS volatility FROM preg GROUP BY 1, 2)""")
def _(t):
    return at.regime_contributions(t.portfolio_regimes, P)


REGDD = """rw AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id, regime ORDER BY ts) AS w FROM preg),
  rd AS (SELECT *, w - max(w) OVER p AS dd_add, w / max(w) OVER p - 1 AS dd_rel FROM rw
    WINDOW p AS (PARTITION BY portfolio_id, regime ORDER BY ts))"""


@query("regime_performance", "L23 M14", "portfolio_id:s regime:i total_return annualized_return volatility sharpe_ratio max_drawdown frequency "
       "avg_excess_return excess_volatility win_rate periods:i contribution contribution_percentage", "preg", f"""
WITH {REGDD} SELECT portfolio_id, regime, product(1 + ret) - 1 AS total_return, product(1 + ret) ** (252.0 / count(*)) - 1 AS annualized_return,
  stddev_samp(ret) * {RY} AS volatility, avg(ret) / stddev_samp(ret) * {RY} AS sharpe_ratio, min(dd_rel) AS max_drawdown,
  count(*) / sum(count(*)) OVER p AS frequency, avg(ret - bench) AS avg_excess_return, stddev_samp(ret - bench) * {RY} AS excess_volatility,
  avg((ret > 0)::INT) AS win_rate, count(*) AS periods, sum(ret) AS contribution, sum(ret) / sum(sum(ret)) OVER p AS contribution_percentage
FROM rd GROUP BY 1, 2 WINDOW p AS (PARTITION BY portfolio_id)""")
def _(t):
    return at.regime_performance(t.portfolio_regimes, P)


@query("regime_statistics", "L24 M14", "portfolio_id:s regime:i periods:i frequency mean_return std_return total_return annualized_return var_95 "
       "cvar_95 max_drawdown win_rate skewness kurtosis sharpe_ratio alpha beta correlation tracking_error information_ratio", "preg", f"""
WITH {REGDD}, q AS (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY portfolio_id, regime) AS v FROM rd)
SELECT portfolio_id, regime, count(*) AS periods, count(*) / sum(count(*)) OVER (PARTITION BY portfolio_id) AS frequency, avg(ret) AS mean_return,
  stddev_samp(ret) AS std_return, product(1 + ret) - 1 AS total_return, (1 + avg(ret)) ** 252 - 1 AS annualized_return, max(v) AS var_95,
  avg(ret) FILTER (ret <= v) AS cvar_95, min(dd_add) AS max_drawdown, avg((ret > 0)::INT) AS win_rate, skewness(ret) AS skewness,
  kurtosis(ret) AS kurtosis, avg(ret) / stddev_samp(ret) * {RY} AS sharpe_ratio, avg(ret) - avg(bench) AS alpha,
  covar_samp(ret, bench) / var_pop(bench) AS beta, corr(ret, bench) AS correlation, stddev_samp(ret - bench) AS tracking_error,
  (avg(ret) - avg(bench)) / stddev_samp(ret - bench) AS information_ratio FROM q GROUP BY 1, 2""")
def _(t):
    return at.regime_statistics(t.portfolio_regimes, P, bench="bench")


@query("regime_comparison", "L25", "portfolio_id:s metric:s best_regime:i worst_regime:i range coefficient_of_variation", "preg", f"""
WITH {REGDD}, s AS (SELECT portfolio_id, regime, avg(ret) AS mean_return, stddev_samp(ret) AS std_return,
    avg(ret) / stddev_samp(ret) * {RY} AS sharpe_ratio, min(dd_add) AS max_drawdown, avg((ret > 0)::INT) AS win_rate FROM rd GROUP BY 1, 2),
  u AS (UNPIVOT s ON mean_return, std_return, sharpe_ratio, max_drawdown, win_rate INTO NAME metric VALUE v),
  k AS (SELECT *, CASE WHEN metric = 'max_drawdown' THEN -abs(v) ELSE v END AS sc FROM u)
SELECT portfolio_id, metric, first(regime ORDER BY sc DESC, regime) AS best_regime, first(regime ORDER BY sc, regime) AS worst_regime,
  max(v) - min(v) AS range, stddev_pop(v) / avg(v) AS coefficient_of_variation FROM k GROUP BY 1, 2""")
def _(t):
    return at.compare_regimes(at.regime_statistics(t.portfolio_regimes, P), P)


@query("regime_diversity", "L25", "portfolio_id:s most_frequent:i least_frequent:i entropy", "preg", """
WITH f AS (SELECT portfolio_id, regime, count(*) / sum(count(*)) OVER (PARTITION BY portfolio_id) AS f FROM preg GROUP BY 1, 2)
SELECT portfolio_id, first(regime ORDER BY f DESC, regime) AS most_frequent, first(regime ORDER BY f, regime) AS least_frequent,
  -sum(f * ln(f)) AS entropy FROM f GROUP BY 1""")
def _(t):
    return at.regime_diversity(at.regime_statistics(t.portfolio_regimes, P), P)


@query("multi_level_attribution", "L26", f"level:s bucket:s {EFFECTS} total_contribution", "panel", f"""
WITH {SECTOR}, cp AS (SELECT ts, symbol, pw, bw, CASE WHEN pw = 0 THEN 0 ELSE ret END AS ret, CASE WHEN bw = 0 THEN 0 ELSE bret END AS bret FROM panel)
SELECT 'sector' AS level, sector AS bucket, {BRINSON} FROM sp GROUP BY 2 UNION ALL SELECT 'country', symbol, {BRINSON} FROM cp GROUP BY 2""")
def _(t):
    return at.multi_level(t.panel, {"sector": "sector", "country": "symbol"})


@query("strategy_comparison", "L29", "strategy:s total_return annualized_return annualized_volatility sharpe_ratio sortino_ratio win_rate "
       "max_drawdown calmar_ratio skewness var_95 cvar_95", "dd", f"""
WITH q AS (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY portfolio_id) AS v FROM dd)
SELECT *, (ann - 0.02) / annualized_volatility AS sharpe_ratio, (ann - 0.02) / down AS sortino_ratio, ann / abs(max_drawdown) AS calmar_ratio,
  ann AS annualized_return FROM (
  SELECT portfolio_id AS strategy, product(1 + ret) - 1 AS total_return, product(1 + ret) ** (252.0 / count(*)) - 1 AS ann,
    stddev_samp(ret) * {RY} AS annualized_volatility, stddev_samp(ret) FILTER (ret < 0.02 / 252) * {RY} AS down,
    avg((ret > 0)::INT) AS win_rate, min(dd_rel) AS max_drawdown, skewness(ret) AS skewness, max(v) AS var_95,
    avg(ret) FILTER (ret <= v) AS cvar_95 FROM q GROUP BY 1)""")
def _(t):
    return at.strategy_table(t.portfolio_returns.withColumnRenamed(P, "strategy"))


@query("attribution_waterfall", "L30", "sector:s value running_total bar_start", "panel", f"""
WITH {SECTOR}, s AS (SELECT sector, sum(pw * ret - bw * bret) AS value FROM sp GROUP BY 1)
SELECT sector, value, sum(value) OVER (ORDER BY sector) AS running_total, sum(value) OVER (ORDER BY sector) - value AS bar_start FROM s""")
def _(t):
    parts = at.sector_brinson(t.panel, totals=False).select("sector", F.col("total_contribution").alias("value"))
    return at.waterfall(parts, order="sector")
