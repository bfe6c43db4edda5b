"""Queries N8 to N14: hedging."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import hedge
from riskframe.queries.base import query

K = ["portfolio_id", "instrument"]
AH = """h AS (SELECT p.portfolio_id, r.symbol AS instrument, p.ts, p.ret, r.ret AS hedge FROM prets p JOIN rets r USING (ts))"""
MINVAR = """mv AS (SELECT portfolio_id, instrument, CASE WHEN count(*) >= 60 AND var_pop(hedge) <> 0 THEN -covar_samp(ret, hedge) / var_pop(hedge) ELSE 0 END AS hedge_ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, instrument ORDER BY ts DESC) AS k FROM h) WHERE k <= 60 GROUP BY 1, 2)"""
DELTA = "dn AS (SELECT portfolio_id, instrument, -covar_samp(ret, hedge) / var_pop(hedge) AS hedge_ratio FROM h GROUP BY 1, 2)"
TAIL = """tr AS (SELECT portfolio_id, instrument, CASE WHEN count(*) > 1 AND var_pop(hedge) <> 0 THEN
    greatest(-2, least(0, -abs(covar_samp(ret, hedge) / var_pop(hedge) * 0.5))) ELSE 0 END AS hedge_ratio
  FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY portfolio_id, instrument) AS v FROM h) WHERE ret <= v GROUP BY 1, 2)"""
SPEC = "portfolio_id:s instrument:s hedge_ratio"


def aligned(t):
    return t.portfolio_returns.join(
        t.returns.select("ts", F.col("symbol").alias("instrument"), F.col("ret").alias("hedge")), "ts")


@query("hedge_minimum_variance", "N8", SPEC, "prets", f"WITH {AH}, {MINVAR} SELECT * FROM mv")
def _(t):
    return hedge.minimum_variance(aligned(t), K)


@query("hedge_delta_neutral", "N9", SPEC, "prets", f"WITH {AH}, {DELTA} SELECT * FROM dn")
def _(t):
    return hedge.delta_neutral(aligned(t), K)


@query("hedge_delta_exposure", "N9", "portfolio_id:s portfolio_delta hedge_ratio", "lw rets", """
SELECT portfolio_id, sum(weight * d) AS portfolio_delta, -sum(weight * d) AS hedge_ratio FROM lw
JOIN (SELECT symbol, 1 + 100 * avg(ret) + 10 * stddev_samp(ret) AS d FROM rets GROUP BY 1) USING (symbol) GROUP BY 1""")
def _(t):
    deltas = t.returns.groupBy("symbol").agg((1 + 100 * F.avg("ret") + 10 * F.stddev_samp("ret")).alias("delta"))
    return hedge.delta_exposure(t.latest_weights, deltas)


@query("hedge_var_target", "N10", SPEC, "prets", f"""
WITH {AH}, g AS (SELECT portfolio_id, instrument, k, (abs(quantile_cont(ret - k * 0.1 * hedge, 0.05)) - 0.0005) ** 2 AS gap FROM h, range(0, 21) r(k) GROUP BY 1, 2, 3)
SELECT portfolio_id, instrument, -0.1 * first(k ORDER BY gap, k) AS hedge_ratio FROM g GROUP BY 1, 2""")
def _(t):
    return hedge.var_target(aligned(t), K, target=0.0005, step=0.1)


@query("hedge_tail_risk", "N11", SPEC, "prets", f"WITH {AH}, {TAIL} SELECT * FROM tr")
def _(t):
    return hedge.tail_risk(aligned(t), K)


STATE = "st AS (SELECT portfolio_id, arg_max(regime, ts) AS regime, 0.8 AS probability FROM preg GROUP BY 1)"
ADJ = f"""{STATE}, rr AS (SELECT portfolio_id, instrument, regime, CASE regime WHEN 0 THEN tr.hedge_ratio WHEN 2 THEN dn.hedge_ratio ELSE mv.hedge_ratio END AS hedge_ratio,
    CASE regime WHEN 0 THEN 'tail_risk' WHEN 2 THEN 'delta_neutral' ELSE 'minimum_variance' END AS strategy
  FROM mv JOIN dn USING (portfolio_id, instrument) JOIN tr USING (portfolio_id, instrument) JOIN st USING (portfolio_id))"""


def state(t):
    return t.portfolio_regimes.groupBy("portfolio_id").agg(F.max_by("regime", "ts").alias("regime")).withColumn("probability", F.lit(0.8))


@query("hedge_by_regime", "N12 U7", SPEC + " strategy:s regime:i confidence_adjusted_ratio", "prets preg", f"""
WITH {AH}, {MINVAR}, {DELTA}, {TAIL}, {ADJ} SELECT *, hedge_ratio * 0.8 AS confidence_adjusted_ratio FROM rr""")
def _(t):
    return hedge.regime_ratio(aligned(t), K, state(t))


PLAN = f"""WITH RECURSIVE {AH}, {MINVAR}, i AS (SELECT portfolio_id, instrument, abs(hedge_ratio) * 1000000 * 0.01 AS cost,
    row_number() OVER (PARTITION BY portfolio_id ORDER BY instrument) AS k FROM mv),
  f AS (SELECT portfolio_id, instrument, k, CASE WHEN cost <= 6000 THEN cost ELSE 0 END AS spent, cost <= 6000 AS selected, cost FROM i WHERE k = 1
    UNION ALL SELECT i.portfolio_id, i.instrument, i.k, CASE WHEN f.spent + i.cost <= 6000 THEN f.spent + i.cost ELSE f.spent END,
      f.spent + i.cost <= 6000, i.cost FROM f JOIN i ON i.portfolio_id = f.portfolio_id AND i.k = f.k + 1)"""


def plan(t):
    ratios = hedge.minimum_variance(aligned(t), K).withColumn("nav", F.lit(1e6))
    return hedge.hedge_plan(hedge.hedge_positions(ratios), budget=0.006)


@query("hedge_plan", "N13", "portfolio_id:s instrument:s hedge_cost selected:b total_hedge_cost number_of_hedges:i", "prets", PLAN + """
SELECT portfolio_id, instrument, cost AS hedge_cost, selected, max(spent) OVER p AS total_hedge_cost, sum(selected::INT) OVER p AS number_of_hedges
FROM f WINDOW p AS (PARTITION BY portfolio_id)""")
def _(t):
    return plan(t)


@query("hedge_history", "N14", "total_hedge_sessions:i recent_average_hedge_cost:m recent_average_num_hedges hedging_frequency:i", "", """
WITH s AS (SELECT date_trunc('day', ts) AS ts, sum(value) AS c, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS total_hedge_sessions, avg(c) AS recent_average_hedge_cost, avg(n) AS recent_average_num_hedges,
  count(*) FILTER (n > 0) AS hedging_frequency FROM (SELECT * FROM s ORDER BY ts DESC LIMIT 10)""")
def _(t):
    sessions = t.read("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.sum("value").alias("total_hedge_cost"), F.sum((F.col("event_type") == "error").cast("int")).alias("number_of_hedges"))
    return hedge.hedge_history(sessions.withColumnRenamed("day", "ts"))
