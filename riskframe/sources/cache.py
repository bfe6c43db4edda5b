"""Keyed price cache, source failover, validity and snapshots on plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.readers import latest_quotes


def first_source(df: DataFrame, keys: Sequence[str] = ("symbol", "ts"), priority: str = "priority") -> DataFrame:
    """Row of the most preferred source per key (the smallest priority); combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), priority).alias("_r")).select(*keys, "_r.*")


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Primary rows, and cached rows for keys the primary lacks."""
    both = primary.withColumn("priority", F.lit(0)).unionByName(
        fallback.withColumn("priority", F.lit(1)), allowMissingColumns=True)
    return first_source(both, keys).drop("priority")


def upsert(cache: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "ts", "kind"),
           written: str = "write_ts") -> DataFrame:
    """Last write per key of a cache and new rows."""
    both = cache.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), written).alias("_r")).select(*keys, "_r.*")


def write_cache(df: DataFrame, path: str, partitions: Sequence[str] = ("kind", "month")) -> None:
    """Store a cache by kind and month: range reads prune files, and a hot symbol is spread over months."""
    monthly = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    monthly.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def read_cache(spark: SparkSession, path: str, symbols: Sequence[str] | None, start: str, end: str, kind: str) -> DataFrame:
    """Range read; kind and month prune partitions, symbol and ts reach the scan."""
    df = spark.read.parquet(path).where(
        (F.col("kind") == kind) & F.col("month").between(start[:7], end[:7])
        & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return df if symbols is None else df.where(F.col("symbol").isin(*symbols))


def still_valid(df: DataFrame, minutes: int, now: Column | None = None, created: str = "created_at") -> DataFrame:
    """Rows not older than their time to live."""
    reference = F.current_timestamp() if now is None else now
    return df.where(F.col(created) > reference - F.expr(f"INTERVAL {minutes} MINUTES"))


def snapshot(ticks: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest value per symbol, ready to be written."""
    return latest_quotes(ticks, "symbol", "ts", tie)
