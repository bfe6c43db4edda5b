"""Weighting rules, candidate scoring, regime blends and weight timelines."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.stats import TRADING_DAYS, safe_ratio
from riskframe.plans.pairs import covariances, pair_moments
from riskframe.plans.windows import Keys, as_list, by, running, whole


def annual_means(returns: DataFrame, keys: Keys | None = None) -> DataFrame:
    return returns.groupBy(*as_list(keys), "symbol").agg((F.avg("ret") * TRADING_DAYS).alias("mu"))


def annual_covariances(returns: DataFrame, keys: Keys | None = None, blocks: int = 1) -> DataFrame:
    """(keys, i, j, cov) from block moments, optionally per rebalance date."""
    keys = as_list(keys)
    return covariances(pair_moments(returns, keys=keys, blocks=blocks), keys, float(TRADING_DAYS)).select(*keys, "i", "j", "cov")


# Rules: DataFrame of lookback returns (keys, symbol, ts, ret) to (keys, symbol, weight).

def equal_weight(returns: DataFrame, keys: Keys | None = None) -> DataFrame:
    keys = as_list(keys)
    names = returns.select(*keys, "symbol").distinct()
    return names.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*(keys or [F.lit(1)]))))


def inverse_volatility(returns: DataFrame, keys: Keys | None = None) -> DataFrame:
    keys = as_list(keys)
    vols = returns.groupBy(*keys, "symbol").agg(F.try_divide(F.lit(1.0), F.stddev_samp("ret")).alias("_iv"))
    total = F.sum("_iv").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return vols.withColumn("weight", F.try_divide(F.col("_iv"), total)).drop("_iv")


def momentum_weights(returns: DataFrame, n: int, keys: Keys | None = None, last: int | None = None) -> DataFrame:
    """Equal weight in the ``n`` assets of highest mean return (over the last rows if given), 0 elsewhere."""
    keys = as_list(keys)
    if last is not None:
        order = Window.partitionBy(*keys, "symbol").orderBy(F.col("ts").desc())
        returns = returns.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= last)
    means = returns.groupBy(*keys, "symbol").agg(F.avg("ret").alias("_m"))
    group = keys or [F.lit(1)]
    order = Window.partitionBy(*group).orderBy(F.col("_m").desc(), "symbol")
    ranked = means.withColumn("_top", (F.row_number().over(order) <= n).cast("double"))
    return ranked.withColumn("weight", F.col("_top") / F.sum("_top").over(Window.partitionBy(*group))).drop("_m", "_top")


def bound_weights(weights: DataFrame, low: float, high: float, keys: Keys) -> DataFrame:
    """Clip to [low, high] and renormalise once."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("weight")))
    return weights.withColumn("weight", clipped).withColumn("weight", F.try_divide(F.col("weight"), F.sum("weight").over(whole(keys))))


WeightRule = Callable[..., DataFrame]


class WeightingMethods:
    """Weighting rules by name; a rule takes lookback returns and ``keys``."""

    def __init__(self) -> None:
        self._rules: dict[str, WeightRule] = {"equal_weight": equal_weight, "risk_parity": inverse_volatility,
                                              "momentum": lambda r, keys=None: momentum_weights(r, 3, keys)}

    def register(self, name: str, rule: WeightRule) -> None:
        self._rules[name] = rule

    def names(self) -> list[str]:
        return sorted(self._rules)

    def weights(self, name: str, returns: DataFrame, keys: Keys | None = None) -> DataFrame:
        if name not in self._rules:
            raise ValueError(f"unknown weighting method {name!r}; registered: {self.names()}")
        return self._rules[name](returns, keys=keys)

    def all(self, returns: DataFrame, keys: Keys | None = None) -> DataFrame:
        """Weights of every method, with a ``method`` column."""
        out = None
        for name in self.names():
            part = self.weights(name, returns, keys).withColumn("method", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out


def implied_returns(cov: DataFrame, market: DataFrame, risk_aversion: float = 3.0) -> DataFrame:
    """Equilibrium returns: risk aversion times covariance times market weights."""
    joined = cov.join(market.select(F.col("symbol").alias("j"), "weight"), "j")
    return joined.groupBy(F.col("i").alias("symbol")).agg((risk_aversion * F.sum(F.col("cov") * F.col("weight"))).alias("implied_return"))


# Candidate scoring.  candidates(keys, cand_id, symbol, weight); mu(keys, symbol, mu); cov(keys, i, j, cov).

def _score_parts(candidates: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """Marginal (C w)_i of every candidate and asset."""
    shared = [k for k in keys if k in cov.columns]
    other = candidates.select(*keys, "cand_id", F.col("symbol").alias("j"), F.col("weight").alias("_wj"))
    return (other.join(cov, [*shared, "j"]).groupBy(*keys, "cand_id", F.col("i").alias("symbol"))
            .agg(F.sum(F.col("cov") * F.col("_wj")).alias("_mc")))


def score_mean_variance(candidates: DataFrame, mu: DataFrame, cov: DataFrame, keys: Keys | None = None, risk_aversion: float = 1.0,
                        current: DataFrame | None = None, turnover_cost: float = 0.0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """mu'w - risk_aversion / 2 w'Cw - cost * turnover and feasibility (sum 1, bounds) per candidate."""
    keys = as_list(keys)
    parts = _score_parts(candidates, cov, keys)
    rows = candidates.join(parts, [*keys, "cand_id", "symbol"]).join(mu, [*[k for k in keys if k in mu.columns], "symbol"])
    if current is None:
        rows = rows.withColumn("_held", F.col("weight"))
    else:
        rows = rows.join(current.select("symbol", F.col("weight").alias("_held")), "symbol", "left").na.fill(0.0, ["_held"])
    w = F.col("weight")
    scored = rows.groupBy(*keys, "cand_id").agg(
        F.sum(w * F.col("mu")).alias("expected_return"), F.sum(w * F.col("_mc")).alias("variance"),
        F.sum(F.abs(w - F.col("_held"))).alias("turnover"),
        ((F.abs(F.sum(w) - 1) < 1e-6) & (F.min(w) >= low - 1e-9) & (F.max(w) <= high + 1e-9)).alias("feasible"))
    objective = F.col("expected_return") - risk_aversion / 2 * F.col("variance") - turnover_cost * F.col("turnover")
    return scored.withColumn("objective", objective)


def score_risk_parity(candidates: DataFrame, cov: DataFrame, keys: Keys | None = None, targets: DataFrame | None = None) -> DataFrame:
    """- sum (c_i - t_i sum c)^2 with c_i = w_i (C w)_i and equal targets by default; higher is better."""
    keys = as_list(keys)
    rows = candidates.join(_score_parts(candidates, cov, keys), [*keys, "cand_id", "symbol"])
    w = whole([*keys, "cand_id"])
    if targets is None:
        rows = rows.withColumn("target", 1 / F.count("*").over(w))
    else:
        rows = rows.join(targets, "symbol")
    part = F.col("weight") * F.col("_mc")
    gap = rows.withColumns({"_c": part, "_total": F.sum(part).over(w)})
    miss = F.col("_c") - F.col("target") * F.col("_total")
    return gap.groupBy(*keys, "cand_id").agg(
        (-F.sum(miss * miss)).alias("objective"),
        ((F.abs(F.sum("weight") - 1) < 1e-6) & (F.min("weight") >= -1e-9)).alias("feasible"))


def best_candidate(scores: DataFrame, keys: Keys | None = None) -> DataFrame:
    """Best feasible candidate per key, lowest id on ties."""
    keys = as_list(keys)
    order = F.struct("objective", -F.col("cand_id"))
    picked = scores.where("feasible").groupBy(*keys).agg(F.max_by(F.struct("cand_id", "objective"), order).alias("_b"))
    return picked.select(*keys, "_b.*")


# Regime blends.

def blend_regimes(weights: DataFrame, probs: DataFrame) -> DataFrame:
    """Sum over regimes of probability times weight: weights(regime, symbol, weight), probs(key, regime, prob)."""
    keys = [c for c in probs.columns if c not in ("regime", "prob")]
    return weights.join(probs, "regime").groupBy(*keys, "symbol").agg(F.sum(F.col("prob") * F.col("weight")).alias("weight"))


def blend_covariances(cov: DataFrame, probs: DataFrame) -> DataFrame:
    keys = [c for c in probs.columns if c not in ("regime", "prob")]
    return cov.join(probs, "regime").groupBy(*keys, "i", "j").agg(F.sum(F.col("prob") * F.col("cov")).alias("cov"))


def portfolio_figures(weights: DataFrame, mu: DataFrame, cov: DataFrame, keys: Keys, rf: float = 0.02) -> DataFrame:
    """Expected return, volatility, Sharpe and weight concentration per weight vector."""
    keys = as_list(keys)
    vectors = weights.withColumn("cand_id", F.lit(0))
    parts = _score_parts(vectors, cov, keys)
    rows = vectors.join(parts, [*keys, "cand_id", "symbol"]).join(mu, [*[k for k in keys if k in mu.columns], "symbol"])
    w = F.col("weight")
    wide = rows.groupBy(*keys).agg(
        F.sum(w * F.col("mu")).alias("expected_return"), F.sqrt(F.sum(w * F.col("_mc"))).alias("volatility"),
        F.max(w).alias("max_weight"), F.min(w).alias("min_weight"), F.sum(w * w).alias("concentration"))
    return wide.withColumn("sharpe_ratio", safe_ratio(F.col("expected_return") - rf, F.col("volatility")))


def compare_methods(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.02) -> DataFrame:
    return portfolio_figures(weights, mu, cov, "method", rf)


def propagate(probs: Column | str, matrix: Column | str, horizon: int) -> Column:
    """Regime probabilities after ``horizon`` steps: repeated row vector times matrix, per row of the table."""
    p = F.col(probs) if isinstance(probs, str) else probs
    m = F.col(matrix) if isinstance(matrix, str) else matrix

    def step(acc: Column, _: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(acc) - 1), lambda j: F.aggregate(
            F.sequence(F.lit(0), F.size(acc) - 1), F.lit(0.0),
            lambda s, i: s + F.get(acc, i) * F.get(F.get(m, i), j)))

    return p if horizon == 0 else F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), p, step)


def expected_volatility(probs: Column, volatilities: Column) -> Column:
    return F.aggregate(F.zip_with(probs, volatilities, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def resampled_summary(weights: DataFrame, keys: Keys = "symbol") -> DataFrame:
    """Mean and population std of an asset's weight over resampled inputs."""
    return weights.groupBy(*as_list(keys)).agg(F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("std_weight"))


def weight_timeline(dates: DataFrame, rebalances: DataFrame, ts: str = "ts", keys: Keys = ("portfolio_id",)) -> DataFrame:
    """Weights of each date: those of the last rebalance on or before it, per portfolio and asset.

    dates(ts) and rebalances(portfolio_id, ts, symbol, weight); built as half-open periods and an equi join.
    """
    from riskframe.operators.align import range_join
    keys = as_list(keys)
    periods = rebalance_periods(rebalances, dates, keys, ts)
    spread = range_join(periods, dates.select(ts).distinct(), "_start", "_end", None, ts)
    return (spread.join(rebalances.withColumnRenamed(ts, "_start"), [*keys, "_start"])
            .select(*keys, ts, F.col("_start").alias("rebalance_date"), "symbol", "weight"))


def rebalance_periods(rebalances: DataFrame, dates: DataFrame, keys: Keys = "portfolio_id", ts: str = "ts") -> DataFrame:
    """(keys, _k, _start, _end): half-open periods between rebalances, the last one past the last date."""
    keys = as_list(keys)
    starts = rebalances.select(*keys, F.col(ts).alias("_start")).distinct()
    last = dates.agg((F.max(ts) + F.expr("INTERVAL 1 DAY")).alias("_last")).withColumn("_one", F.lit(1))
    w = by(keys, "_start")
    numbered = starts.withColumns({"_k": F.row_number().over(w), "_next": F.lead("_start").over(w), "_one": F.lit(1)})
    return numbered.join(last, "_one").select(*keys, "_k", "_start", F.coalesce("_next", F.greatest("_last", "_start")).alias("_end"))


def strategy_parameters(spark: SparkSession) -> DataFrame:
    """Parameters of the four named strategies, one row each (fixed values)."""
    rows = [
        ("mean_variance", "Mean Variance Optimization", 0.25, 0.01, 0.5, "monthly", 252, {"sector_max": 0.40, "single_stock_max": 0.10, "cash_min": 0.02}),
        ("risk_parity", "Risk Parity", 0.20, 0.02, 0.3, "quarterly", 252, {"sector_max": 0.35, "leverage_max": 1.0}),
        ("momentum", "Momentum Strategy", 0.15, 0.0, 1.2, "monthly", 126, {"top_n_assets": 20.0, "momentum_threshold": 0.05}),
        ("equal_weight", "Equal Weight", None, None, 0.1, "quarterly", 252, {}),
    ]
    return spark.createDataFrame(rows, "strategy string, name string, max_weight double, min_weight double, turnover_target double, "
                                       "rebalance_frequency string, lookback_period int, constraints map<string,double>")


def turnover_steps(rebalances: DataFrame, keys: Keys = "portfolio_id", ts: str = "ts") -> DataFrame:
    """(keys, ts, symbol, change): weight changes at each rebalance, missing assets counting as 0.

    Each weight is added at its own rebalance and taken off at the next one; the sums are the changes.
    """
    keys = as_list(keys)
    w = by(keys, ts)
    order = rebalances.select(*keys, ts).distinct().withColumn("_next", F.lead(ts).over(w))
    moves = F.array(F.struct(F.col(ts).alias("t"), F.col("weight").alias("d")), F.struct(F.col("_next").alias("t"), (-F.col("weight")).alias("d")))
    spread = rebalances.join(order, [*keys, ts]).select(*keys, "symbol", F.explode(moves).alias("_m")).where("_m.t IS NOT NULL")
    return spread.groupBy(*keys, F.col("_m.t").alias(ts), "symbol").agg(F.sum("_m.d").alias("change"))


def mapping_column(values: Mapping[str, float], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key))


def cumulative_growth(ret: str, keys: Keys, ts: str = "ts") -> Column:
    return F.product(1 + F.col(ret)).over(running(keys, ts))
