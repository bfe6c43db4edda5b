"""Queries F and G: ranked selections and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import align, prep, series, topk
from riskframe.queries.base import query

S, P = "symbol", "portfolio_id"


@query("top_holdings", "F1", "portfolio_id:s symbol:s rank:i weight value:m", "lw", """
SELECT *, weight * nav AS value FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, symbol) AS rank FROM lw)
JOIN (SELECT o_orderstatus AS portfolio_id, sum(o_totalprice) AS nav FROM orders GROUP BY 1) USING (portfolio_id) WHERE rank <= 3""")
def _(t):
    nav = t.read("orders").groupBy(F.col("o_orderstatus").alias(P)).agg(F.sum("o_totalprice").alias("nav"))
    return topk.top_holdings(t.latest_weights, nav, 3)


@query("top_assets_or_others", "F2", "portfolio_id:s ts:t symbol:s weight", "wts", """
WITH r AS (SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY avg(weight) DESC, symbol) AS k FROM wts GROUP BY 1, 2)
SELECT portfolio_id, ts, CASE WHEN k <= 2 THEN symbol ELSE 'Others' END AS symbol, sum(weight) AS weight FROM wts JOIN r USING (portfolio_id, symbol)
GROUP BY 1, 2, 3""")
def _(t):
    return topk.top_or_others(t.weights, 2)


@query("common_transitions", "F3", "from_regime:i to_regime:i count:i", "reg", """
SELECT f AS from_regime, regime AS to_regime, count(*) AS count FROM (SELECT *, lag(regime) OVER (ORDER BY ts) AS f FROM reg)
WHERE f <> regime GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 4""")
def _(t):
    return topk.common_transitions(series.regime_changes(t.regimes, "series_id"), 4)


@query("deepest_drawdowns", "F6", "portfolio_id:s rank:i ts:t dd_rel", "dd", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY dd_rel, ts) AS rank FROM dd) WHERE rank <= 5""")
def _(t):
    from riskframe.operators import risk
    return topk.top_rows(risk.drawdown_path(t.portfolio_returns, P), 5, P, "dd_rel", ["ts"], descending=False)


@query("last_rows", "F7 B22", "symbol:s ts:t close", "bars", """
SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 7""")
def _(t):
    return prep.last_rows(t.bars, 7, S)


@query("momentum_assets", "F8", "year:i symbol:s rank:i score", "rets", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, symbol) AS rank FROM (
  SELECT year(ts) AS year, symbol, avg(ret) AS score FROM rets GROUP BY 1, 2)) WHERE rank <= 2""")
def _(t):
    return topk.momentum_assets(t.returns.withColumn("year", F.year("ts")), 2, "year")


@query("common_dates", "G1", "ts:t", "rets bars", """
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts FROM orders INTERSECT SELECT date_trunc('month', l_shipdate)::TIMESTAMP FROM lineitem""")
def _(t):
    months = [t.read(name).select(F.date_trunc("month", c).alias("ts")) for name, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return topk.common_values(*months, ["ts"])


@query("all_instruments", "G2 G5", "symbol:s", "", "SELECT DISTINCT s_nationkey AS symbol FROM supplier UNION SELECT c_nationkey FROM customer")
def _(t):
    return topk.all_values(t.read("supplier").select(F.col("s_nationkey").alias(S)),
                           t.read("customer").select(F.col("c_nationkey").alias(S)), [S])


@query("stacked_frames", "G3", "source:s symbol:s n:i value:m", "", """
SELECT 'supplier' AS source, CAST(s_nationkey AS VARCHAR) AS symbol, count(*) AS n, sum(s_acctbal) AS value FROM supplier GROUP BY 2 UNION ALL
SELECT 'customer', c_mktsegment, count(*), NULL FROM customer GROUP BY 2""")
def _(t):
    a = t.read("supplier").groupBy(F.col("s_nationkey").cast("string").alias(S)).agg(
        F.count("*").alias("n"), F.sum("s_acctbal").alias("value")).withColumn("source", F.lit("supplier"))
    b = t.read("customer").groupBy(F.col("c_mktsegment").alias(S)).agg(F.count("*").alias("n")).withColumn("source", F.lit("customer"))
    return topk.stack(a, b)


def clients(t):
    """Subscriptions derived from the events: a client follows the types it sent and its own symbol."""
    events = t.read("events").withColumn("client_id", F.concat(F.lit("C"), F.col("user_id") % 40))
    return events.groupBy("client_id").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("U"), "user_id"))).alias("symbols"),
        F.array_sort(F.collect_set(F.when(F.col("event_id") % 7 == 0, F.col("event_type")))).alias("event_types"))


CLIENTS = """c AS (SELECT 'C' || (user_id % 40) AS client_id, list_sort(list_distinct(list('U' || user_id))) AS symbols,
    list_sort(list_distinct(list(event_type) FILTER (event_id % 7 = 0))) AS event_types FROM events GROUP BY 1)"""


@query("subscriptions", "G4", "client_id:s added:s removed:s", "", f"""
WITH {CLIENTS} SELECT client_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(event_types, []), ['alert']))), ',') AS added,
  array_to_string(list_filter(coalesce(event_types, []), lambda x: x <> 'click'), ',') AS removed FROM c""")
def _(t):
    return clients(t).select(
        "client_id", F.concat_ws(",", F.array_sort(topk.subscribe("event_types", F.array(F.lit("alert"))))).alias("added"),
        F.concat_ws(",", topk.unsubscribe("event_types", F.array(F.lit("click")))).alias("removed"))


@query("event_fan_out", "C13 I4", "client_id:s event_id:i event_type:s", "", f"""
WITH {CLIENTS}, e AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'U' || user_id END AS symbol FROM events),
  s AS (SELECT client_id, symbols, unnest(event_types) AS event_type FROM c)
SELECT client_id, event_id, e.event_type FROM e JOIN s USING (event_type) WHERE symbol IS NULL OR list_contains(symbols, symbol)""")
def _(t):
    events = t.read("events").select("event_id", "event_type", F.when(
        F.col("event_id") % 5 != 0, F.concat(F.lit("U"), "user_id")).alias("symbol"))
    return align.interested(events, clients(t))
