"""Hedge ratios per portfolio and instrument, regime mapping and hedge plans.

Input is one aligned table: (portfolio, instrument, ts, ret, hedge) with the portfolio's and the
instrument's return side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import measures as m
from riskframe.plans.windows import Keys, as_list, constant_key, whole

R, H = "ret", "hedge"


def minimum_variance(df: DataFrame, keys: Keys, n: int = 60, ts: str = "ts") -> DataFrame:
    """-cov_samp / var_pop over the last ``n`` dates; 0 with fewer dates or a flat instrument."""
    keys = as_list(keys)
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    recent = df.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= n)
    ratio = -F.try_divide(F.covar_samp(R, H), F.var_pop(H))
    return recent.groupBy(*keys).agg(
        F.when((F.count("*") >= n) & (F.var_pop(H) != 0), ratio).otherwise(0.0).alias("hedge_ratio"))


def delta_neutral(df: DataFrame, keys: Keys, hedge_delta: float = 1.0) -> DataFrame:
    return df.groupBy(*as_list(keys)).agg((-m.beta(R, H) / hedge_delta).alias("hedge_ratio"))


def delta_exposure(weights: DataFrame, deltas: DataFrame, keys: Keys = "portfolio_id", hedge_delta: float = 1.0) -> DataFrame:
    """Delta of a portfolio from asset deltas (symbol, delta) and the ratio that cancels it."""
    total = F.sum(F.col("weight") * F.col("delta"))
    return weights.join(deltas, "symbol").groupBy(*as_list(keys)).agg(
        total.alias("portfolio_delta"), (-total / hedge_delta).alias("hedge_ratio"))


def var_target(df: DataFrame, keys: Keys, target: float = 0.02, p: float = 0.05, step: float = 0.05) -> DataFrame:
    """Ratio in [-2, 0] on a grid whose |VaR| is nearest to the target (the one nearest to 0 on ties).

    The grid is an array column: every ratio gets one percentile aggregate in the same pass, so no row is
    copied and nothing but one row per key leaves the aggregation.
    """
    keys = as_list(keys)
    grid = [round(-k * step, 10) for k in range(int(round(2.0 / step)) + 1)]
    gaps = [F.pow(F.abs(F.percentile(F.col(R) + g * F.col(H), F.lit(p))) - target, 2) for g in grid]
    wide = df.groupBy(*keys).agg(F.array(*gaps).alias("_g"))
    best = F.array_position("_g", F.array_min("_g"))
    return wide.select(*keys, F.element_at(F.array(*[F.lit(g) for g in grid]), best.cast("int")).alias("hedge_ratio"))


def tail_risk(df: DataFrame, keys: Keys, p: float = 0.05, premium: float = 0.01, max_cost: float = 0.02) -> DataFrame:
    """Beta within the worst rows, cost-adjusted, clamped to [-2, 0]."""
    keys = as_list(keys)
    tail = df.withColumn("_v", F.percentile(R, F.lit(p)).over(whole(keys))).where(F.col(R) <= F.col("_v"))
    ratio = -F.abs(F.try_divide(F.covar_samp(R, H), F.var_pop(H)) * (1 - premium / max_cost))
    clamped = F.greatest(F.lit(-2.0), F.least(F.lit(0.0), ratio))
    return tail.groupBy(*keys).agg(
        F.when((F.count("*") > 1) & (F.var_pop(H) != 0), clamped).otherwise(0.0).alias("hedge_ratio"))


#: Strategy of each regime (fixed values): bear, sideways, bull.
REGIME_STRATEGIES = {0: "tail_risk", 1: "minimum_variance", 2: "delta_neutral"}

Strategy = Callable[[DataFrame, Keys], DataFrame]


class HedgeStrategies:
    """Registry of strategies ``fn(aligned, keys) -> (keys, hedge_ratio)``."""

    def __init__(self) -> None:
        self._fns: dict[str, Strategy] = {"minimum_variance": minimum_variance, "delta_neutral": delta_neutral,
                                          "var_hedge": var_target, "tail_risk": tail_risk}

    def register(self, name: str, fn: Strategy) -> None:
        self._fns[name] = fn

    def ratios(self, df: DataFrame, keys: Keys, names: Sequence[str]) -> DataFrame:
        """Ratios of several strategies, long with a ``strategy`` column."""
        out = None
        for name in names:
            if name not in self._fns:
                raise KeyError(f"unknown hedge strategy {name!r}; registered: {sorted(self._fns)}")
            part = self._fns[name](df, keys).withColumn("strategy", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out


def regime_ratio(df: DataFrame, keys: Keys, state: DataFrame, strategies: HedgeStrategies | None = None,
                 mapping: Mapping[int, str] | None = None, on: Keys | None = None) -> DataFrame:
    """Ratio of the regime's strategy times the regime probability; ``state`` has (on, regime, probability)."""
    mapping = mapping or REGIME_STRATEGIES
    keys = as_list(keys)
    ratios = (strategies or HedgeStrategies()).ratios(df, keys, sorted(set(mapping.values()) | {"minimum_variance"}))
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    chosen = state.withColumn("strategy", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("regime")), F.lit("minimum_variance")))
    on = as_list(on) or [k for k in keys if k in state.columns]
    return (ratios.join(chosen, [*on, "strategy"])
            .withColumn("confidence_adjusted_ratio", F.col("hedge_ratio") * F.col("probability")))


def hedge_positions(ratios: DataFrame, value: str | Column = "nav", price: float = 1.0, cost_rate: float = 0.01,
                    ratio: str = "hedge_ratio") -> DataFrame:
    notional = F.col(ratio) * (F.col(value) if isinstance(value, str) else value)
    return ratios.withColumns({"hedge_notional": notional, "hedge_units": notional / price,
                               "effectiveness": F.abs(ratio) / (1 + F.abs(ratio)), "hedge_cost": F.abs(notional) * cost_rate})


def hedge_plan(positions: DataFrame, budget: float = 0.05, keys: Keys = "portfolio_id", order: str = "instrument",
               value: str = "nav", cost: str = "hedge_cost") -> DataFrame:
    """Take instruments in order while the budget lasts, skipping those that do not fit.

    The skip rule is an ordered fold, done inside one row per portfolio over the array of its few
    instruments.
    """
    keys = as_list(keys)
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).alias("c"))))
    folded = positions.groupBy(*keys).agg(F.max(value).alias("_nav"), items.alias("_i")).withColumn(
        "_taken", F.aggregate(
            "_i", F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<string>").alias("names")),
            lambda acc, x: F.when(acc["spent"] + x["c"] <= F.col("_nav") * budget, F.struct(
                (acc["spent"] + x["c"]).alias("spent"),
                F.concat(acc["names"], F.array(x["o"].cast("string"))).alias("names"))).otherwise(acc)))
    plan = folded.select(*keys, F.col("_taken.names").alias("_names"), F.col("_taken.spent").alias("total_hedge_cost"),
                         F.size("_taken.names").alias("number_of_hedges"),
                         F.try_divide(F.col("_taken.spent"), F.col("_nav") * budget).alias("budget_utilisation"))
    return (positions.join(plan, keys)
            .withColumn("selected", F.array_contains("_names", F.col(order).cast("string"))).drop("_names"))


def hedge_history(sessions: DataFrame, last: int = 10, ts: str = "ts") -> DataFrame:
    """Summary of the last sessions of a history (ts, total_hedge_cost, number_of_hedges)."""
    keyed = constant_key(sessions, "_k")
    order = Window.partitionBy("_k").orderBy(F.col(ts).desc())
    total = keyed.groupBy("_k").agg(F.count("*").alias("total_hedge_sessions"))
    recent = keyed.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= last)
    return (recent.groupBy("_k").agg(
        F.avg("total_hedge_cost").alias("recent_average_hedge_cost"),
        F.avg("number_of_hedges").alias("recent_average_num_hedges"),
        F.sum((F.col("number_of_hedges") > 0).cast("int")).alias("hedging_frequency"))
        .join(total, "_k").drop("_k"))


