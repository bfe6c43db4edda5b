"""Window specifications for date-grain series.

A date-grain series holds one row per key and date, so a window partition is bounded by the calendar
(about 13 000 business days in fifty years) however much raw data was aggregated into it, and however
skewed the raw data was.  Series at tick grain have no such bound: they go through ``plans.chunked``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def as_list(keys: Keys | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def by(keys: Keys, ts: Keys = "ts") -> WindowSpec:
    """Ordered window of a series."""
    return Window.partitionBy(*as_list(keys)).orderBy(*as_list(ts))


def trailing(keys: Keys, n: int, ts: Keys = "ts") -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return by(keys, ts).rowsBetween(-(n - 1), 0)


def running(keys: Keys, ts: Keys = "ts") -> WindowSpec:
    return by(keys, ts).rowsBetween(Window.unboundedPreceding, 0)


def following(keys: Keys, ts: Keys = "ts") -> WindowSpec:
    return by(keys, ts).rowsBetween(0, Window.unboundedFollowing)


def whole(keys: Keys) -> WindowSpec:
    return Window.partitionBy(*as_list(keys))


def full(agg: Column, counted: Column | str, window: WindowSpec, n: int) -> Column:
    """``agg`` over ``window``, null until ``n`` non-null values are in the frame."""
    return F.when(F.count(counted).over(window) >= n, agg.over(window))


def constant_key(df: DataFrame, name: str = "series_id", value: str = "all") -> DataFrame:
    """Give a market-wide series, already one row per date, a key of its own."""
    return df.withColumn(name, F.lit(value))
