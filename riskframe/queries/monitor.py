"""Queries N1 to N7 and I10: limit monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import monitor as mo
from riskframe.queries.base import query

SPEC = "portfolio_id:s alert_type:s level:s metric_name:s current_value threshold_value"
LIMITS = mo.RiskLimits(max_portfolio_volatility=0.012, max_individual_weight=0.18, max_drawdown=0.0005, max_leverage=0.85,
                       max_var_95=0.0005, max_cvar_95=0.0008, min_diversification_ratio=0.6, max_concentration_index=0.15)

POSITION = """SELECT portfolio_id, 'position_limit' AS alert_type, CASE WHEN v > 1.2 * 0.18 THEN 'HIGH' ELSE 'MEDIUM' END AS level,
  'max_individual_weight' AS metric_name, v AS current_value, 0.18 AS threshold_value FROM (SELECT portfolio_id, max(weight) AS v FROM lw GROUP BY 1) WHERE v > 0.18
UNION ALL SELECT portfolio_id, 'leverage_limit', CASE WHEN v > 1.1 * 0.85 THEN 'CRITICAL' ELSE 'HIGH' END, 'total_leverage', v, 0.85
  FROM (SELECT portfolio_id, sum(abs(weight)) AS v FROM lw GROUP BY 1) WHERE v > 0.85
UNION ALL SELECT portfolio_id, 'concentration_risk', 'MEDIUM', 'concentration_index', v, 0.15
  FROM (SELECT portfolio_id, sum(weight ** 2) AS v FROM lw GROUP BY 1) WHERE v > 0.15
UNION ALL SELECT portfolio_id, 'diversification_risk', 'LOW', 'diversification_ratio', v, 0.6
  FROM (SELECT portfolio_id, 1 / sqrt(count(*) FILTER (abs(weight) > 0.01)) AS v FROM lw GROUP BY 1) WHERE v < 0.6"""
RETURN = """SELECT portfolio_id, 'volatility_limit' AS alert_type, CASE WHEN vol > 1.2 * 0.012 THEN 'HIGH' ELSE 'MEDIUM' END AS level,
  'portfolio_volatility' AS metric_name, vol AS current_value, 0.012 AS threshold_value FROM rs WHERE vol > 0.012
UNION ALL SELECT portfolio_id, 'var_limit', 'HIGH', 'var_95', abs(v), 0.0005 FROM rs WHERE abs(v) > 0.0005
UNION ALL SELECT portfolio_id, 'cvar_limit', 'HIGH', 'cvar_95', abs(c), 0.0008 FROM rs WHERE abs(c) > 0.0008"""
RS = """pr AS (SELECT portfolio_id, ts, sum(weight * ret) AS ret FROM lw JOIN rets USING (symbol) GROUP BY 1, 2),
  rs AS (SELECT portfolio_id, stddev_samp(ret) * sqrt(252.0) AS vol, max(v) AS v, avg(ret) FILTER (ret <= v) AS c FROM (
    SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY portfolio_id) AS v FROM pr) GROUP BY 1 HAVING count(*) > 30)"""
SECTOR = """SELECT portfolio_id, 'sector_concentration' AS alert_type, CASE WHEN v < 1.2 * 0.25 THEN 'MEDIUM' ELSE 'HIGH' END AS level,
  'max_sector_weight' AS metric_name, v AS current_value, 0.25 AS threshold_value FROM (SELECT portfolio_id, max(w) AS v FROM (
    SELECT portfolio_id, CASE WHEN symbol < '3' THEN 'urgent' WHEN symbol < '5' THEN 'normal' ELSE 'Unknown' END AS sector, sum(weight) AS w
    FROM lw GROUP BY 1, 2) GROUP BY 1) WHERE v > 0.25"""
LIQ = """SELECT portfolio_id, 'liquidity_risk' AS alert_type, CASE WHEN v > 0.9 * 0.95 THEN 'MEDIUM' ELSE 'HIGH' END AS level,
  'liquidity_ratio' AS metric_name, v AS current_value, 0.95 AS threshold_value FROM (SELECT portfolio_id, sum(weight * l) AS v FROM lw
    JOIN (SELECT symbol, 1 - 0.1 * (row_number() OVER (ORDER BY symbol) - 1) AS l FROM (SELECT DISTINCT symbol FROM lw)) USING (symbol) GROUP BY 1) WHERE v < 0.95"""
DRAW = """SELECT portfolio_id, 'drawdown_limit' AS alert_type, CASE WHEN v > 1.2 * 0.0005 THEN 'CRITICAL' ELSE 'HIGH' END AS level,
  'current_drawdown' AS metric_name, v AS current_value, 0.0005 AS threshold_value FROM (SELECT portfolio_id, abs(arg_max(dd, ts)) AS v FROM (
    SELECT portfolio_id, ts, c - max(c) OVER (PARTITION BY portfolio_id ORDER BY ts) AS dd FROM (
    SELECT portfolio_id, ts, p / first(p) OVER (PARTITION BY portfolio_id ORDER BY ts) - 1 AS c FROM (
    SELECT portfolio_id, ts, sum(weight * v) AS p FROM lw JOIN wk USING (symbol) GROUP BY 1, 2))) GROUP BY 1) WHERE v > 0.0005"""


def limits(t):
    return mo.limits_table(t.latest_weights, LIMITS)


def sectors(t):
    s = F.col("symbol")
    names = t.latest_weights.select("symbol").distinct()
    return names.where(s < "5").withColumn("sector", F.when(s < "3", "urgent").otherwise("normal"))


def liquidity(t):
    return t.latest_weights.select("symbol").distinct().withColumn(
        "liquidity", 1 - 0.1 * (F.substring("symbol", 1, 1).cast("int") - 1))


@query("weight_alerts", "N1 N6", SPEC, "lw", POSITION)
def _(t):
    return mo.weight_alerts(t.latest_weights, limits(t))


@query("return_alerts", "N2", SPEC, "lw rets", f"WITH {RS} {RETURN}")
def _(t):
    return mo.return_alerts(t.latest_weights, t.returns, limits(t))


@query("sector_alerts", "N3", SPEC, "lw", SECTOR)
def _(t):
    return mo.sector_alerts(t.latest_weights, sectors(t), limits(t))


@query("liquidity_alerts", "N4", SPEC, "lw", LIQ)
def _(t):
    return mo.liquidity_alerts(t.latest_weights, liquidity(t), limits(t))


@query("drawdown_alerts", "N5", SPEC, "lw wk", DRAW)
def _(t):
    prices = t.weekly("symbol").withColumnRenamed("v", "close")
    return mo.drawdown_alerts(t.latest_weights, prices, limits(t))


@query("portfolio_monitor", "N7", SPEC, "lw wk rets",
       f"WITH {RS} " + " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (POSITION, RETURN, SECTOR, LIQ, DRAW)))
def _(t):
    return mo.monitor(t.latest_weights, limits(t), t.returns, t.weekly("symbol").withColumnRenamed("v", "close"),
                      sectors(t), liquidity(t))


@query("alert_dashboard", "I10 F6", "level:s alert_type:s alerts:i system_status:s", "", """
SELECT *, CASE WHEN max((level = 'CRITICAL')::INT) OVER () = 1 THEN 'AT_RISK' ELSE 'HEALTHY' END AS system_status FROM (
  SELECT CASE WHEN value > 150 THEN 'CRITICAL' WHEN value > 80 THEN 'HIGH' ELSE 'MEDIUM' END AS level, event_type AS alert_type, count(*) AS alerts
  FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND value > 40 GROUP BY 1, 2)""")
def _(t):
    v = F.col("value")
    alerts = t.read("events").where("value > 40").select(
        F.when(v > 150, "CRITICAL").when(v > 80, "HIGH").otherwise("MEDIUM").alias("level"), F.col("event_type").alias("alert_type"), "ts")
    return mo.alert_dashboard(alerts, F.lit("2024-01-20").cast("timestamp"))
