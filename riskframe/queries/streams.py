"""Queries I: the streaming operators over the events and orders tables, drained once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators import monitor as mo
from riskframe.queries.base import query
from riskframe.session import scratch_folder
from riskframe.streaming import events as ev, regime_log, run


def source(t, name: str):
    """A table as a file stream."""
    return run.tick_stream(t.spark, f"{t.folder}/{name}.parquet", t.read(name).schema)


def ticks(t, symbol="event_type"):
    key = F.col(symbol) if symbol == "event_type" else F.concat(F.lit("U"), F.col(symbol))
    return source(t, "events").select(key.alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"),
                                      F.get_json_object("props", "$.k").cast("bigint").alias("size"), F.lit("feed").alias("source"))


LATE = "(SELECT max(ts) FROM events) - INTERVAL {delay}"


@query("stream_price_events", "I1", "symbol:s ts:t event_type:s price:s source:s", "", """
SELECT event_type AS symbol, ts, 'price_update' AS event_type, 'feed' AS source, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS price FROM events""")
def _(t):
    out = run.drain(ev.price_events(ticks(t)))
    cents = F.round(F.element_at("data", "price").cast("double") * 100).cast("bigint").cast("string")
    return out.select("symbol", "ts", "event_type", cents.alias("price"), F.element_at("metadata", "source").alias("source"))


@query("stream_last_values", "I2", "symbol:s ts:t price size:i", "", """
SELECT event_type AS symbol, arg_max(ts, (ts, event_id)) AS ts, arg_max(value, (ts, event_id)) AS price,
  arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS size FROM events GROUP BY 1""")
def _(t):
    return run.newest(run.drain(ev.last_values(ticks(t), "event_id"), "update"), ["symbol"])


@query("stream_routed_ticks", "I3 U4", "consumer:s event_id:i price", "", """
SELECT c.consumer, event_id, value AS price FROM events JOIN (VALUES ('click', 'alpha'), ('click', 'beta'), ('view', 'beta')) c(symbol, consumer) ON event_type = c.symbol""")
def _(t):
    routes = t.spark.createDataFrame([("click", "alpha"), ("click", "beta"), ("view", "beta")], "symbol string, consumer string")
    return run.drain(ev.routed(ticks(t), routes))


@query("stream_deduplicated", "I1 late data", "event_id:i symbol:s", "", "SELECT event_id, event_type AS symbol FROM events")
def _(t):
    twice = ticks(t).withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2))))
    return run.drain(ev.dedup(twice, "1 hour", ("symbol", "ts", "event_id")))


@query("stream_regime_changes", "I5 I12", "series_id:s ts:t from_regime:i to_regime:i switches:i kept:i", "", """
WITH l AS (SELECT event_type AS series_id, ts, event_id, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS r FROM events),
  c AS (SELECT *, lag(r) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS p FROM l)
SELECT series_id, ts, p AS from_regime, r AS to_regime, row_number() OVER w AS switches, least(100, row_number() OVER w) AS kept FROM c WHERE p <> r
WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)""")
def _(t):
    price = F.col("price")
    labels = ticks(t).select(F.col("symbol").alias("series_id"), "ts", F.col("event_id").alias("tie"),
                             F.when(price < 20, 0).when(price < 60, 1).otherwise(2).alias("regime"), F.lit(0.8).alias("confidence"))
    return regime_log.drain_regime_changes(labels).withColumn("kept", F.size("recent"))


@query("stream_client_sessions", "I7", "client_id:s connected_at:t dropped_at:t heartbeats:i", "", f"""
WITH h AS (SELECT 'C' || (user_id % 40) AS client_id, ts, event_id FROM events),
  g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM h WINDOW w AS (PARTITION BY client_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(n) OVER (PARTITION BY client_id ORDER BY ts, event_id) AS s FROM g)
SELECT client_id, min(ts) AS connected_at, max(ts) + INTERVAL 30 MINUTE AS dropped_at, count(*) AS heartbeats FROM s GROUP BY client_id, s
HAVING max(ts) + INTERVAL 30 MINUTE <= {LATE.format(delay='10 MINUTE')}""")
def _(t):
    beats = source(t, "events").select(F.concat(F.lit("C"), F.col("user_id") % 40).alias("client_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run.drain(ev.client_sessions(beats, "30 minutes"))


@query("stream_feed_status", "I8", "symbol:s events:i last_update:t missing_points:i", "", """
SELECT event_type AS symbol, count(*) AS events, max(ts) AS last_update, count(*) - count(json_extract_string(props, '$.k')) AS missing_points FROM events GROUP BY 1""")
def _(t):
    return run.newest(run.drain(ev.feed_status(ticks(t)), "complete"), ["symbol"])


@query("stream_alert_counts", "I10", "ts:t level:s alert_type:s alerts:i", "", f"""
WITH a AS (SELECT CASE WHEN value > 80 THEN 'HIGH' ELSE 'MEDIUM' END AS level, event_type AS alert_type, ts FROM events WHERE value > 40),
  w AS (SELECT level, alert_type, date_trunc('hour', ts)::TIMESTAMP + to_hours(1 + k::INT) AS e FROM a, range(0, 24) x(k))
SELECT e AS ts, level, alert_type, count(*) AS alerts FROM w WHERE e <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR GROUP BY 1, 2, 3""")
def _(t):
    alerts = ticks(t).where("price > 40").select(F.when(F.col("price") > 80, "HIGH").otherwise("MEDIUM").alias("level"),
                                                 F.col("symbol").alias("alert_type"), "ts")
    return run.drain(ev.alert_counts(alerts))


@query("stream_counters", "I12", "alert_type:s fired:i active:i last_event:t", "", """
SELECT event_type AS alert_type, count(*) FILTER (value > 80) AS fired, greatest(0, count(*) FILTER (value > 80) - count(*) FILTER (value < 5)) AS active, max(ts) AS last_event
FROM events GROUP BY 1""")
def _(t):
    events = ticks(t).withColumnRenamed("symbol", "alert_type")
    return run.newest(run.drain(ev.counters(events, F.col("price") > 80, F.col("price") < 5), "complete"), ["alert_type"])


@query("stream_bars", "I13", "symbol:s ts:t open high low close volume:i", "", f"""
SELECT * FROM (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts))
WHERE ts + INTERVAL 1 HOUR <= {LATE.format(delay='10 MINUTE')}""")
def _(t):
    return run.drain(ev.stream_bars(ticks(t), "1 hour", tie="event_id"))


def weight_stream(t):
    """Orders as a stream of weight updates: the share an order takes of a fixed book."""
    return source(t, "orders").select(F.col("o_orderstatus").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol"),
                                      (F.col("o_totalprice") / 1e6).alias("weight"), F.struct(F.col("o_orderdate"), F.col("o_orderkey")).alias("ts"))


LATEST = """SELECT o_orderstatus AS portfolio_id, o_orderpriority AS symbol, arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 1e6 AS weight FROM orders GROUP BY 1, 2"""


@query("stream_weight_updates", "I9", "portfolio_id:s symbol:s weight", "", LATEST)
def _(t):
    folder = scratch_folder(t.spark, "weights")
    query_ = run.start(weight_stream(t), run.weight_upsert_handler(t.spark, f"{folder}/out"), f"{folder}/state")
    query_.awaitTermination()
    stored = t.spark.read.parquet(f"{folder}/out")
    return run.newest(stored.withColumnRenamed("version", "batch"), ["portfolio_id", "symbol"])


@query("stream_risk_alerts", "I6", "portfolio_id:s alert_type:s current_value", "", f"""
WITH w AS ({LATEST}) SELECT portfolio_id, 'position_limit' AS alert_type, max(weight) AS current_value FROM w GROUP BY 1 HAVING max(weight) > 0.15 UNION ALL
SELECT portfolio_id, 'leverage_limit', sum(weight) FROM w GROUP BY 1 HAVING sum(weight) > 1 UNION ALL
SELECT portfolio_id, 'concentration_risk', sum(weight ** 2) FROM w GROUP BY 1 HAVING sum(weight ** 2) > 0.4 UNION ALL
SELECT portfolio_id, 'diversification_risk', 1 / sqrt(count(*) FILTER (weight > 0.01)) FROM w GROUP BY 1 HAVING 1 / sqrt(count(*) FILTER (weight > 0.01)) < 0.3""")
def _(t):
    folder = scratch_folder(t.spark, "alerts")
    limits = mo.limits_table(t.latest_weights, mo.RiskLimits())
    query_ = run.start(weight_stream(t), run.risk_alert_handler(t.spark, limits, f"{folder}/out"), f"{folder}/state")
    query_.awaitTermination()
    alerts = t.spark.read.parquet(f"{folder}/out")
    return alerts.where(F.col("batch") == alerts.agg(F.max("batch")).scalar())  # what holds after the last update


def eighth_edges(t) -> list[int]:
    """The seven event_ids that end all eighths of the events but the last."""
    from riskframe.plans.quantiles import exact_quantiles
    ids = t.read("events").select(F.lit(1).alias("_k"), "event_id")
    return [math.floor(q) for q in exact_quantiles(ids, ["_k"], "event_id", [i / 8 for i in range(1, 8)]).first()["quantiles"]]


def landed(t, folder: str, edges: list[int], eighths: range) -> None:
    """Land the events of the ``eighths`` (from 0) that have any as one file each, in order of time."""
    at = F.col("event_id")
    for i in eighths:
        # Conditions on the plain column let the reader skip what lies outside.
        part = t.read("events").where((at > edges[i - 1] if i else F.lit(True)) & (at <= edges[i] if i < len(edges) else at.isNotNull()))
        if not part.isEmpty():
            part.repartition(1).write.mode("append").parquet(folder)


def refreshed(t, refit, after: int = 3) -> DataFrame:
    """The model after eight files, one for each trigger, refitted after each ``after`` of them, with a restart after the fifth;
    from the table of models."""
    folder = scratch_folder(t.spark, "refresh")
    edges = eighth_edges(t)
    for eighths in (range(5), range(5, 8)):
        landed(t, f"{folder}/in", edges, eighths)
        stream = t.spark.readStream.schema(t.read("events").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        run.start(stream, run.refresh_handler(f"{folder}/out", after, refit, after), f"{folder}/state").awaitTermination()
    return run.latest_model(t.spark, f"{folder}/out")


@query("stream_model_refresh", "I11", "regime:i persistence converged:b")
def _(t):
    from riskframe.operators.hmm import HiddenMarkov

    def refit(buffer):
        hourly = buffer.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(
            F.avg(F.log("value")).alias("x"))
        model = HiddenMarkov(["x"], "series_id", "h", states=2, n_iter=100, tol=0.05).fit(hourly)
        return model.parameters(t.benchmark).withColumn("converged", F.lit(bool(model.converged)))

    return refreshed(t, refit)


@query("stream_refreshed_transitions", "I11", "from_regime:i to_regime:i count:i probability version:i", "", """
WITH q AS (SELECT quantile_cont(event_id, 3 / 8.0) AS lo, quantile_cont(event_id, 6 / 8.0) AS hi FROM events),
  l AS (SELECT event_type, ts, event_id, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS r FROM events, q WHERE event_id > lo AND event_id <= hi),
  p AS (SELECT r AS from_regime, lead(r) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS to_regime FROM l),
  c AS (SELECT from_regime, to_regime, count(*) AS n FROM p WHERE to_regime IS NOT NULL GROUP BY ALL)
SELECT from_regime, to_regime, n AS count, n / sum(n) OVER (PARTITION BY from_regime) AS probability, 5 AS version FROM c""")
def _(t):
    from riskframe.operators.regime import transition_matrix

    def refit(buffer):
        value = F.col("value")
        labels = buffer.select("event_type", F.struct("ts", "event_id").alias("at"), F.when(value < 20, 0).when(value < 60, 1).otherwise(2).alias("regime"))
        counts = transition_matrix(labels, ["event_type"], ts="at").groupBy("from_regime", "to_regime").agg(F.sum("count").alias("count"))
        return counts.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from_regime")))

    return refreshed(t, refit)
