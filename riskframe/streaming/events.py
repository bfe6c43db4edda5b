"""Streaming forms of ticks, last values, bars, fan-out and alert counts.

All functions take and return DataFrames, so they run on a stream or on a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_TYPES = ("price_update", "regime_change", "risk_alert", "portfolio_update", "news", "system_status", "data_quality")


def dedup(ticks: DataFrame, delay: str = "10 minutes", keys: tuple[str, ...] = ("symbol", "ts", "source")) -> DataFrame:
    """Drop repeated ticks that arrive within the watermark; later ones than the watermark are dropped too."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def price_events(ticks: DataFrame, tie: str | None = None) -> DataFrame:
    """Price-update envelopes: id, type, time, symbol, data map, metadata map.

    The id is a hash of source, symbol, time and values (and of ``tie``, where ticks have an id of their own), so a
    repeated batch repeats its ids.
    """
    parts = ["source", "symbol", F.unix_micros("ts"), "price", "size", *([tie] if tie else [])]
    event_id = F.sha2(F.to_json(F.array(*(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit(None)).cast("string") for p in parts))), 256)
    data = F.create_map(F.lit("price"), F.col("price").cast("string"), F.lit("volume"), F.col("size").cast("string"))
    return ticks.select(event_id.alias("event_id"), F.lit("price_update").alias("event_type"), "ts", "symbol",
                        data.alias("data"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))


def last_values(ticks: DataFrame, tie: str | None = None) -> DataFrame:
    """Last price and volume per symbol; run in update or complete mode."""
    order = F.struct("ts", tie) if tie else F.col("ts")
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "size"), order).alias("_v")).select("symbol", "_v.*")


def stream_bars(ticks: DataFrame, width: str, delay: str | None = "10 minutes", slide: str | None = None, tie: str | None = None) -> DataFrame:
    """Tumbling or sliding bars; append mode emits a bar once the watermark passes its end.

    ``delay`` None keeps the watermark the input already has, for example from ``dedup``.
    """
    order = F.struct("ts", tie) if tie else F.col("ts")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = ticks.withWatermark("ts", delay) if delay else ticks
    bars = timed.groupBy("symbol", window.alias("_w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def routed(ticks: DataFrame, routes: DataFrame) -> DataFrame:
    """Ticks with the consumers registered for their symbol: stream-static join with routes(symbol, consumer)."""
    return ticks.join(routes, "symbol")


def alert_counts(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Alerts per level and type over the last 24 hours, every hour."""
    window = F.window("ts", "24 hours", "1 hour")
    counts = alerts.withWatermark("ts", delay).groupBy(window.alias("_w"), "level", "alert_type").agg(F.count("*").alias("alerts"))
    return counts.select(F.col("_w.end").alias("ts"), "level", "alert_type", "alerts")


def client_sessions(heartbeats: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a client: a gap without heartbeat ends one."""
    s = heartbeats.withWatermark("ts", delay).groupBy("client_id", F.session_window("ts", gap).alias("_w")).agg(F.count("*").alias("heartbeats"))
    return s.select("client_id", F.col("_w.start").alias("connected_at"), F.col("_w.end").alias("dropped_at"), "heartbeats")


def counters(events: DataFrame, fired: Column, resolved: Column, key: str = "alert_type") -> DataFrame:
    """Alerts fired and still active per type (never below 0), last event time; complete mode."""
    active = F.sum(F.when(fired, 1).when(resolved, -1).otherwise(0))
    return events.groupBy(key).agg(F.sum(fired.cast("int")).alias("fired"), F.greatest(active, F.lit(0)).alias("active"),
                                   F.max("ts").alias("last_event"))


def feed_status(ticks: DataFrame) -> DataFrame:
    """Events, last update and missing sizes per symbol: the data side of a status message; complete mode."""
    return ticks.groupBy("symbol").agg(F.count("*").alias("events"), F.max("ts").alias("last_update"),
                                       F.sum(F.col("size").isNull().cast("int")).alias("missing_points"))
