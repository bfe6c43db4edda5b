"""Ranked selections and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.plans.windows import Keys, as_list, whole


def top_rows(df: DataFrame, n: int, keys: Keys | None, by: str, ties: Sequence[str], descending: bool = True) -> DataFrame:
    """First ``n`` rows per key.  Spark cuts each task's input to n rows per key before the shuffle."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    if not as_list(keys):
        return df.orderBy(first, *ties).limit(n)
    order = Window.partitionBy(*as_list(keys)).orderBy(first, *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_holdings(weights: DataFrame, nav: DataFrame, n: int = 10, keys: Keys = "portfolio_id") -> DataFrame:
    """Largest weights with their value at the portfolio's NAV (portfolio, nav)."""
    ranked = top_rows(weights, n, keys, "weight", ["symbol"])
    return ranked.join(nav, as_list(keys)).withColumn("value", F.col("weight") * F.col("nav"))


def top_or_others(weights: DataFrame, n: int, keys: Keys = "portfolio_id", ts: str = "ts") -> DataFrame:
    """Per date weights of the top-n assets by mean weight, the rest added up as Others."""
    keys = as_list(keys)
    means = weights.groupBy(*keys, "symbol").agg(F.avg("weight").alias("_mean"))
    order = Window.partitionBy(*keys).orderBy(F.col("_mean").desc(), "symbol")
    ranks = means.withColumn("_rk", F.row_number().over(order)).drop("_mean")
    named = weights.join(ranks, [*keys, "symbol"]).withColumn(
        "symbol", F.when(F.col("_rk") <= n, F.col("symbol")).otherwise("Others"))
    return named.groupBy(*keys, ts, "symbol").agg(F.sum("weight").alias("weight"))


def common_transitions(changes: DataFrame, n: int = 10) -> DataFrame:
    counts = changes.groupBy("from_regime", "to_regime").agg(F.count("*").alias("count"))
    return top_rows(counts, n, None, "count", ["from_regime", "to_regime"])


def momentum_assets(returns: DataFrame, n: int, keys: Keys | None = None) -> DataFrame:
    """Assets with the highest mean return over the rows given."""
    means = returns.groupBy(*as_list(keys), "symbol").agg(F.avg("ret").alias("score"))
    return top_rows(means, n, keys, "score", ["symbol"])


def common_values(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return left.select(*columns).intersect(right.select(*columns))


def all_values(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return left.select(*columns).union(right.select(*columns)).distinct()


def stack(*frames: DataFrame) -> DataFrame:
    """Concatenate frames by column name, missing columns null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def subscribe(column: str, added: Column) -> Column:
    return F.array_union(F.col(column), added)


def unsubscribe(column: str, removed: Column) -> Column:
    return F.array_except(F.col(column), removed)


def share(column: str, keys: Keys) -> Column:
    return F.try_divide(F.col(column), F.sum(column).over(whole(keys)))
