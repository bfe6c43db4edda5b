"""Risk tables: tails, drawdowns, contributions, stress tests and report metric sets.

Returns are long and date grain: one row per key and date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import measures as m
from riskframe.functions.stats import ROOT_YEAR, TRADING_DAYS, safe_ratio
from riskframe.plans.windows import Keys, as_list, by, full, running, trailing, whole


def with_cuts(df: DataFrame, keys: Keys, ret: str, probs: Sequence[float], long_groups: bool = False) -> DataFrame:
    """Adds ``_cuts``, the quantiles of the row's group.

    A window keeps the partitioning the aggregation after it needs, so a series is shuffled once.
    ``long_groups`` is for groups that are not date grain: exact two-pass quantiles joined back.
    """
    if long_groups:
        from riskframe.plans.quantiles import exact_quantiles
        return df.join(exact_quantiles(df, as_list(keys), ret, probs, "_cuts"), as_list(keys))
    return df.withColumn("_cuts", F.percentile(ret, F.array(*[F.lit(p) for p in probs])).over(whole(keys)))


def tail_aggs(ret: str, probs: Sequence[float]) -> list[Column]:
    """var_* and cvar_* per tail probability, on rows that carry ``_cuts``."""
    out = []
    for i, p in enumerate(probs):
        label, cut = f"{p * 100:g}".replace(".", "_"), F.get("_cuts", F.lit(i))
        out += [F.first(cut).alias(f"var_{label}"), m.mean_at_or_below(ret, cut).alias(f"cvar_{label}")]
    return out


def tail_columns(df: DataFrame, keys: Keys, ret: str = "ret", probs: Sequence[float] = (0.05,),
                 long_groups: bool = False) -> DataFrame:
    """Historical VaR and expected shortfall, one column pair per tail probability: var_5, cvar_5, ..."""
    return with_cuts(df, keys, ret, probs, long_groups).groupBy(*as_list(keys)).agg(*tail_aggs(ret, probs))


def tail_table(df: DataFrame, keys: Keys, ret: str = "ret", probs: Sequence[float] = (0.05,),
               long_groups: bool = False) -> DataFrame:
    """The tail columns as rows (keys, p, var, cvar)."""
    keys = as_list(keys)
    wide = with_cuts(df, keys, ret, probs, long_groups).groupBy(*keys).agg(
        *[c for i in range(len(probs)) for c in (F.first(F.get("_cuts", F.lit(i))).alias(f"_v{i}"),
                                                 m.mean_at_or_below(ret, F.get("_cuts", F.lit(i))).alias(f"_c{i}"))])
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_v{i}").alias("var"), F.col(f"_c{i}").alias("cvar"))
                      for i, p in enumerate(probs)])
    return wide.select(*keys, F.explode(cells).alias("_s")).select(*keys, "_s.*")


def drawdown_path(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Adds wealth, dd_add (wealth minus its peak) and dd_rel (relative to the peak).

    The peak starts at the first observation, so a loss on day one does not show.
    """
    w = running(keys, ts)
    path = df.withColumn("wealth", F.product(1 + F.col(ret)).over(w))
    peak = F.max("wealth").over(w)
    return path.withColumns({"dd_add": F.col("wealth") - peak, "dd_rel": F.try_divide(F.col("wealth"), peak) - 1})


def max_drawdown_dates(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Deepest additive drawdown with the dates of its trough and of the peak before it, first on ties."""
    keys = as_list(keys)
    path = drawdown_path(df, keys, ret, ts)
    # The running peak's date travels with the rows: the latest row that set a new strict maximum.
    w = running(keys, ts)
    prior = F.max("wealth").over(by(keys, ts).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(prior.isNull() | (F.col("wealth") > prior), F.col(ts))
    path = path.withColumn("_peak", F.last(fresh, ignorenulls=True).over(w))
    first = F.struct("dd_add", ts)
    return path.groupBy(*keys).agg(F.min("dd_add").alias("max_drawdown"), F.min_by("_peak", first).alias("start_date"),
                                   F.min_by(ts, first).alias("end_date"))


def drawdown_table(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts", rf: float = 0.0) -> DataFrame:
    """Both drawdown forms and the ratios built on them."""
    path = drawdown_path(df, keys, ret, ts)
    return path.groupBy(*as_list(keys)).agg(
        m.max_drawdown("dd_add").alias("max_drawdown"), m.max_drawdown("dd_rel").alias("max_drawdown_relative"),
        m.calmar(ret, "dd_add").alias("calmar_ratio"), m.pain_index("dd_rel").alias("pain_index"),
        m.ulcer_index("dd_rel").alias("ulcer_index"), m.burke(ret, "dd_rel", rf).alias("burke_ratio"))


def conditional_drawdown(df: DataFrame, keys: Keys, p: float = 0.05, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Mean of the drawdowns at or beyond their (1 - p) quantile."""
    keys = as_list(keys)
    depth = drawdown_path(df, keys, ret, ts).withColumn("_d", -F.col("dd_rel"))
    return with_cuts(depth, keys, "_d", (1 - p,)).groupBy(*keys).agg(
        F.avg(F.when(F.col("_d") >= F.get("_cuts", F.lit(0)), F.col("_d"))).alias("cdar"))


def performance_profile(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts", rf: float = 0.02) -> DataFrame:
    """The comprehensive metric set: returns, ratios, tail and drawdown in one row per key."""
    path = with_cuts(drawdown_path(df, keys, ret, ts), keys, ret, (0.05,))
    return path.groupBy(*as_list(keys)).agg(
        *m.return_set(ret, rf), m.max_drawdown("dd_add").alias("max_drawdown"), m.calmar(ret, "dd_add").alias("calmar_ratio"),
        m.mean_at_or_below(ret, F.get("_cuts", F.lit(0))).alias("cvar_95"))


def conditional_var(df: DataFrame, keys: Keys, ret: str = "ret", p: float = 0.05, enough: int = 10) -> DataFrame:
    """VaR per group (for example per regime), null with too few rows."""
    return df.groupBy(*as_list(keys)).agg(
        F.count(ret).alias("n"), F.when(F.count(ret) > enough, m.var_historical(ret, p)).alias("var"))


# Weights and covariance.

def concentration(weights: DataFrame, keys: Keys = "portfolio_id") -> DataFrame:
    square = F.sum(F.col("weight") * F.col("weight"))
    return weights.groupBy(*as_list(keys)).agg(square.alias("herfindahl"),
                                               F.when(square > 0, 1 / square).otherwise(1.0).alias("effective_assets"))


def _cov_pairs(weights: DataFrame, cov: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covariance cells with both weights.  The table has one row per asset pair, so it is the size of the
    matrix the user asked about; equi joins on i, then on (keys, j)."""
    shared = [k for k in keys if k in cov.columns]
    wi = weights.select(*keys, F.col("symbol").alias("i"), F.col("weight").alias("wi"))
    wj = weights.select(*keys, F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    return cov.join(wi, [*shared, "i"]).join(wj, [*keys, "j"])


def diversification_ratio(weights: DataFrame, cov: DataFrame, keys: Keys = "portfolio_id") -> DataFrame:
    """Weighted mean volatility over portfolio volatility."""
    keys = as_list(keys)
    cells = _cov_pairs(weights, cov, keys)
    own = F.sum(F.when(F.col("i") == F.col("j"), F.col("wi") * F.sqrt("cov")))
    vol = F.sqrt(F.sum(F.col("wi") * F.col("wj") * F.col("cov")))
    return cells.groupBy(*keys).agg(vol.alias("portfolio_volatility"), F.when(vol > 0, own / vol).otherwise(1.0).alias("diversification_ratio"))


def component_contributions(weights: DataFrame, cov: DataFrame, keys: Keys = "portfolio_id",
                            form: str = "variance") -> DataFrame:
    """Marginal, component and percentage contribution per asset, in variance or volatility form."""
    keys = as_list(keys)
    marginal = (_cov_pairs(weights, cov, keys).groupBy(*keys, F.col("i").alias("symbol"))
                .agg(F.max("wi").alias("weight"), F.sum(F.col("cov") * F.col("wj")).alias("marginal")))
    variance = F.sum(F.col("weight") * F.col("marginal")).over(whole(keys))
    unit = {"variance": F.lit(1.0), "volatility": F.sqrt(variance)}[form]
    total = {"variance": variance, "volatility": F.sqrt(variance)}[form]
    return marginal.select(*keys, "symbol", "weight", F.try_divide(F.col("marginal"), unit).alias("marginal"),
                           F.try_divide(F.col("weight") * F.col("marginal"), unit).alias("component"),
                           F.try_divide(F.col("weight") * F.col("marginal"), unit * total).alias("percentage"))


def contributions_from_returns(weights: DataFrame, returns: DataFrame, portfolio: Keys = "portfolio_id",
                               ts: str = "ts") -> DataFrame:
    """Variance contributions without a covariance matrix: (C w)_i = cov(r_i, r_p).

    Linear in assets; equals ``component_contributions`` when every asset has every date.
    """
    portfolio = as_list(portfolio)
    joined = weights.join(returns, "symbol")
    total = joined.groupBy(*portfolio, ts).agg(F.sum(F.col("weight") * F.col("ret")).alias("_rp"))
    marginal = (joined.join(total, [*portfolio, ts]).groupBy(*portfolio, "symbol")
                .agg(F.max("weight").alias("weight"), F.covar_samp("ret", "_rp").alias("marginal")))
    part = F.col("weight") * F.col("marginal")
    return marginal.withColumns({"component": part, "percentage": F.try_divide(part, F.sum(part).over(whole(portfolio)))})


def risk_decomposition(weights: DataFrame, cov: DataFrame, keys: Keys = "portfolio_id") -> DataFrame:
    """Volatility-form contributions with budget utilisation against 1/N."""
    keys = as_list(keys)
    parts = component_contributions(weights, cov, keys, "volatility")
    return parts.withColumn("budget_utilisation", F.col("percentage") * F.count("*").over(whole(keys)))


def bets_summary(parts: DataFrame, keys: Keys = "portfolio_id", top: int = 3) -> DataFrame:
    """Herfindahl, effective bets, largest and top-3 share of the percentage contributions."""
    keys = as_list(keys)
    order = Window.partitionBy(*keys).orderBy(F.col("percentage").desc(), "symbol")
    ranked = parts.withColumn("_rk", F.row_number().over(order))
    square = F.sum(F.col("percentage") * F.col("percentage"))
    return ranked.groupBy(*keys).agg(
        F.sum("component").alias("total_risk"), square.alias("herfindahl_index"), F.try_divide(F.lit(1.0), square).alias("effective_bets"),
        F.max("percentage").alias("max_contribution"),
        F.sum(F.when(F.col("_rk") <= top, F.col("percentage"))).alias("top_3_concentration"))


# Metric sets of the reports.

def portfolio_risk_metrics(df: DataFrame, keys: Keys = "portfolio_id", ret: str = "ret", ts: str = "ts", rf: float = 0.02,
                           probs: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Volatility, VaR (historical, parametric), CVaR per level, drawdown, ratios, population moments."""
    keys = as_list(keys)
    path = with_cuts(drawdown_path(df, keys, ret, ts), keys, ret, probs)
    daily = rf / TRADING_DAYS
    return path.groupBy(*keys).agg(
        *tail_aggs(ret, probs),
        F.stddev_samp(ret).alias("portfolio_volatility"), m.annualised_volatility(ret).alias("annualized_volatility"),
        F.stddev_pop(ret).alias("tracking_error"),
        safe_ratio(F.avg(ret), F.stddev_pop(ret)).alias("information_ratio"),
        *[m.var_parametric(ret, p).alias(f"var_{p * 100:g}_parametric") for p in probs],
        m.max_drawdown("dd_add").alias("maximum_drawdown"), m.calmar(ret, "dd_add").alias("calmar_ratio"),
        m.sortino(ret, daily).alias("sortino_ratio"), m.omega(ret).alias("omega_ratio"),
        m.tail_ratio(ret).alias("tail_ratio"), m.semi_deviation(ret).alias("semi_deviation"),
        F.skewness(ret).alias("skewness"), F.kurtosis(ret).alias("kurtosis"))


def dashboard_metrics(df: DataFrame, weights: DataFrame, cov: DataFrame, keys: Keys = "portfolio_id", ret: str = "ret",
                      ts: str = "ts", probs: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """Basic dashboard set: volatilities, three VaR methods, drawdown indices, composition."""
    keys = as_list(keys)
    path = with_cuts(drawdown_path(df, keys, ret, ts), keys, ret, probs)
    base = path.groupBy(*keys).agg(
        *tail_aggs(ret, probs), F.stddev_pop(ret).alias("daily_volatility"), (F.stddev_pop(ret) * ROOT_YEAR).alias("annualized_volatility"),
        *[m.var_parametric(ret, p).alias(f"var_{p * 100:g}_parametric") for p in probs],
        *[m.var_cornish_fisher(ret, p).alias(f"var_{p * 100:g}_cornish_fisher") for p in probs],
        m.max_drawdown("dd_add").alias("maximum_drawdown"), m.pain_index("dd_rel").alias("pain_index"),
        m.ulcer_index("dd_rel").alias("ulcer_index"))
    return (base.join(conditional_drawdown(df, keys, 0.05, ret, ts), keys)
            .join(diversification_ratio(weights, cov, keys).drop("portfolio_volatility"), keys)
            .join(concentration(weights, keys), keys))


def metric_history(history: DataFrame, new: DataFrame, as_of: Column, days: int = 30, ts: str = "ts") -> DataFrame:
    """Append a metric snapshot and keep the last ``days``."""
    return history.unionByName(new).where(F.col(ts) > as_of - F.expr(f"INTERVAL {days} DAYS"))


def benchmark_comparison(df: DataFrame, keys: Keys = "portfolio_id", ret: str = "ret", bench: str = "bench",
                         rf: float = 0.02) -> DataFrame:
    """Alpha (CAPM), beta, correlation, population tracking error, mean-form captures."""
    return df.groupBy(*as_list(keys)).agg(
        m.alpha_capm(ret, bench, rf).alias("alpha_capm"), m.beta(ret, bench).alias("beta"),
        F.corr(ret, bench).alias("correlation"), F.stddev_pop(F.col(ret) - F.col(bench)).alias("tracking_error_daily"),
        m.capture(ret, bench, "up", "mean").alias("up_capture"),
        m.capture(ret, bench, "down", "mean").alias("down_capture"))


def excess_summary(df: DataFrame, keys: Keys = "portfolio_id", ret: str = "ret", bench: str = "bench") -> DataFrame:
    excess = F.col(ret) - F.col(bench)
    return df.groupBy(*as_list(keys)).agg(
        F.sum(excess).alias("total_excess_return"), F.avg(excess).alias("avg_excess_return"),
        (F.stddev_samp(excess) * ROOT_YEAR).alias("excess_volatility"),
        m.information_ratio(ret, bench).alias("information_ratio"),
        F.avg((excess > 0).cast("int")).alias("outperformance_rate"),
        F.max(excess).alias("best_excess"), F.min(excess).alias("worst_excess"))


# Stress tests.

#: Asset shocks of the five standard scenarios (fixed values).
STRESS_SCENARIOS: dict[str, dict[str, float]] = {
    "Market Crash": {"AAPL": -0.30, "GOOGL": -0.35, "MSFT": -0.25, "SPY": -0.40},
    "Tech Selloff": {"AAPL": -0.20, "GOOGL": -0.25, "MSFT": -0.22, "TSLA": -0.30},
    "Interest Rate Shock": {"TLT": -0.15, "JPM": 0.05, "V": -0.10},
    "Inflation Spike": {"GLD": 0.10, "TLT": -0.20, "SPY": -0.15},
    "Flight to Quality": {"SPY": -0.25, "QQQ": -0.30, "TLT": 0.15, "GLD": 0.08},
}


def _scenario_map(shocks: Mapping[str, float]) -> Column:
    if not shocks:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[F.lit(x) for pair in shocks.items() for x in pair])


def stress_tests(weights: DataFrame, returns: DataFrame, scenarios: Mapping[str, Mapping[str, float]] | None = None,
                 portfolio: Keys = "portfolio_id", ts: str = "ts") -> DataFrame:
    """Shock chosen assets' returns; last-date return, VaR5, volatility and drawdown per scenario.

    A shock adds weight * shock to every date an asset has, so the weighted returns are aggregated once with
    one extra sum per scenario instead of one copy of the returns per scenario.
    """
    portfolio = as_list(portfolio)
    scenarios = scenarios or STRESS_SCENARIOS
    held = weights.join(returns, "symbol")
    base = held.groupBy(*portfolio, ts).agg(
        F.sum(F.col("weight") * F.col("ret")).alias("_base"),
        *[F.sum(F.col("weight") * F.coalesce(F.try_element_at(_scenario_map(s), F.col("symbol")), F.lit(0.0))).alias(f"_s{k}")
          for k, s in enumerate(scenarios.values())])
    shifted = F.array(*[F.struct(F.lit(name).alias("scenario"), (F.col("_base") + F.col(f"_s{k}")).alias("ret"))
                        for k, name in enumerate(scenarios)])
    long = base.select(*portfolio, ts, F.explode(shifted).alias("_x")).select(*portfolio, ts, "_x.*")
    path = drawdown_path(long, [*portfolio, "scenario"], "ret", ts)
    return path.groupBy(*portfolio, "scenario").agg(
        F.max_by("ret", ts).alias("portfolio_return"), m.var_historical("ret").alias("portfolio_var_5"),
        F.stddev_pop("ret").alias("portfolio_volatility"), m.max_drawdown("dd_add").alias("max_drawdown"))


def uniform_stress(weights: DataFrame, asset_returns: DataFrame, shocks: Mapping[str, float],
                   portfolio: Keys = "portfolio_id") -> DataFrame:
    """Sum of weight * (return + shock) for one return per asset: linear, so two sums serve every scenario."""
    sums = weights.join(asset_returns, "symbol").groupBy(*as_list(portfolio)).agg(
        F.sum(F.col("weight") * F.col("ret")).alias("_r"), F.sum("weight").alias("_w"))
    cells = F.array(*[F.struct(F.lit(k).alias("scenario"), (F.col("_r") + F.col("_w") * v).alias("stressed_return"))
                      for k, v in shocks.items()])
    return sums.select(*as_list(portfolio), F.explode(cells).alias("_x")).select(*as_list(portfolio), "_x.*")


def risk_return_points(df: DataFrame, keys: Keys, ret: str = "ret") -> DataFrame:
    return df.groupBy(*as_list(keys)).agg((F.avg(ret) * TRADING_DAYS).alias("annual_return"),
                                          m.annualised_volatility(ret).alias("annual_volatility"))


# Volatility and correlation patterns.

def volatility_patterns(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts", n: int = 20) -> DataFrame:
    keys = as_list(keys)
    w = by(keys, ts)
    base = df.withColumns({"_v": full(F.stddev_samp(ret), ret, trailing(keys, n, ts), n) * ROOT_YEAR,
                           "_q": F.col(ret) * F.col(ret)}).withColumn("_q1", F.lag("_q").over(w))
    base = with_cuts(base, keys, "_v", (0.25, 0.5, 0.75)).withColumnRenamed("_cuts", "_c")
    flagged = base.withColumn("_high", F.coalesce(F.col("_v") > F.col("_c")[1], F.lit(False)).cast("int"))
    flagged = flagged.withColumn("_same", F.coalesce((F.col("_high") == F.lag("_high").over(w)).cast("int"), F.lit(1)))
    return flagged.groupBy(*keys).agg(
        F.avg("_v").alias("avg_volatility"), F.stddev_samp("_v").alias("volatility_std"),
        F.max("_v").alias("max_volatility"), F.min("_v").alias("min_volatility"),
        F.corr("_q", "_q1").alias("vol_autocorrelation"),
        F.sum((F.col("_v") > F.col("_c")[2]).cast("int")).alias("high_vol_periods"),
        F.sum((F.col("_v") < F.col("_c")[0]).cast("int")).alias("low_vol_periods"),
        F.avg("_same").alias("vol_regime_persistence"))


def correlation_summary(df: DataFrame, keys: Keys, a: str = "ret", b: str = "bench", ts: str = "ts", n: int = 60) -> DataFrame:
    """Static and rolling correlation; the window is given, callers use min(60, dates / 4)."""
    keys = as_list(keys)
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    rolled = df.withColumn("_c", full(F.corr(a, b), both, trailing(keys, n, ts), n))
    return rolled.groupBy(*keys).agg(
        F.corr(a, b).alias("static_correlation"), F.avg("_c").alias("avg_rolling_correlation"),
        F.stddev_samp("_c").alias("correlation_volatility"), F.max("_c").alias("max_correlation"),
        F.min("_c").alias("min_correlation"))


# Trades, limits, hedges, paths.

def trade_statistics(trades: DataFrame, keys: Keys = "portfolio_id", value: str = "value", side: str = "side",
                     commission: str = "commission", impact: str = "impact", date: str = "ts",
                     with_median: bool = True) -> DataFrame:
    """Counts, volumes, sizes and costs of trades.  The median is exact for groups of any size."""
    from riskframe.plans.quantiles import exact_quantiles
    keys = as_list(keys)
    buy = F.lower(side) == "buy"
    cost = F.sum(F.col(commission) + F.col(impact))
    stats = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.sum(value).alias("total_volume"), F.avg(value).alias("avg_trade_size"),
        F.stddev_samp(value).alias("trade_size_volatility"), F.sum(commission).alias("total_commission"),
        F.avg(commission).alias("avg_commission"), F.sum(impact).alias("total_market_impact"),
        F.sum(buy.cast("int")).alias("buy_trades"), F.sum((~buy).cast("int")).alias("sell_trades"),
        F.sum(F.when(buy, F.col(value)).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(~buy, F.col(value)).otherwise(0.0)).alias("sell_volume"),
        cost.alias("total_costs"), safe_ratio(cost, F.sum(value)).alias("cost_ratio"))
    dates = trades.select(*keys, date).distinct().groupBy(*keys).agg(F.count("*").alias("_dates"))
    stats = (stats.join(dates, keys).withColumn("trades_per_rebalance", F.col("total_trades") / F.col("_dates"))
             .drop("_dates"))
    if not with_median:
        return stats
    median = exact_quantiles(trades, keys, value, (0.5,), "_q")
    return stats.join(median.select(*keys, F.get("_q", F.lit(0)).alias("median_trade_size")), keys)


def compliance_checks(weights: DataFrame, keys: Keys = "portfolio_id", max_position: float = 0.10,
                      max_leverage: float = 1.0) -> DataFrame:
    """Largest position and gross leverage against their limits, long."""
    wide = weights.groupBy(*as_list(keys)).agg(F.max("weight").alias("p"), F.sum(F.abs("weight")).alias("l"))
    checks = F.array(
        F.struct(F.lit("max_position_size").alias("rule"), F.col("p").alias("value"), F.lit(max_position).alias("limit_value")),
        F.struct(F.lit("leverage").alias("rule"), F.col("l").alias("value"), F.lit(max_leverage).alias("limit_value")))
    return (wide.select(*as_list(keys), F.explode(checks).alias("_c")).select(*as_list(keys), "_c.*")
            .withColumn("compliant", F.col("value") <= F.col("limit_value") + 1e-12))


def limit_breaches(metrics: DataFrame, limits: Mapping[str, float], keys: Keys = "portfolio_id") -> DataFrame:
    """Metrics over their limits; HIGH from 1.5 times the limit on."""
    long = metrics.unpivot(as_list(keys), list(limits), "metric", "value")
    limit = F.element_at(_scenario_map(limits), F.col("metric"))
    return (long.withColumn("value", F.abs("value")).withColumn("limit", limit).where(F.col("value") > F.col("limit"))
            .withColumn("severity", F.when(F.col("value") > 1.5 * F.col("limit"), "HIGH").otherwise("MEDIUM")))


def gauges(df: DataFrame, keys: Keys = "portfolio_id", ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Last return, volatility and Sharpe (more than 20 rows), drawdown, VaR 95 / 99 and shortfall."""
    keys = as_list(keys)
    path = with_cuts(drawdown_path(df, keys, ret, ts), keys, ret, (0.05, 0.01))
    base = path.groupBy(*keys).agg(
        F.max_by(ret, ts).alias("last_return"), *m.styled_set(ret, "gauge", 0.02),
        m.max_drawdown("dd_rel").alias("max_drawdown"), *tail_aggs(ret, (0.05, 0.01)))
    return base.withColumnsRenamed(
        {"var_5": "var_95", "cvar_5": "expected_shortfall", "var_1": "var_99"}).drop("cvar_1")


def hedge_effectiveness(df: DataFrame, keys: Keys, unhedged: str = "ret", hedged: str = "hedged", ts: str = "ts",
                        cost: float = 0.0) -> DataFrame:
    keys = as_list(keys)
    w = running(keys, ts)
    path = df.withColumns({"_u": F.product(1 + F.col(unhedged)).over(w), "_h": F.product(1 + F.col(hedged)).over(w)})
    path = path.withColumns({"_du": F.col("_u") - F.max("_u").over(w), "_dh": F.col("_h") - F.max("_h").over(w)})

    def reduction(a: Column, b: Column) -> Column:
        return F.when(a > 0, (a - b) / a).otherwise(0.0)

    vu, vh = m.annualised_volatility(unhedged), m.annualised_volatility(hedged)
    share = safe_ratio(F.lit(cost), F.abs(F.sum(unhedged)))
    return path.groupBy(*keys).agg(
        reduction(vu, vh).alias("volatility_reduction"),
        reduction(F.abs(m.var_historical(unhedged)), F.abs(m.var_historical(hedged))).alias("var_reduction"),
        reduction(F.abs(F.min("_du")), F.abs(F.min("_dh"))).alias("drawdown_reduction"),
        (F.avg(hedged) - F.avg(unhedged)).alias("return_impact"),
        F.when((vh > 0) & (vu > 0), F.avg(hedged) / vh - F.avg(unhedged) / vu).otherwise(0.0).alias("risk_adjusted_improvement"),
        share.alias("hedge_cost_ratio"), (reduction(vu, vh) - share).alias("net_benefit"))


def simulation_summary(metrics: DataFrame, keys: Keys = "metric", value: str = "value") -> DataFrame:
    """Mean, std, range and the 5/25/50/75/95 quantiles of a metric over simulations."""
    probs, names = (0.05, 0.25, 0.5, 0.75, 0.95), ("p5", "p25", "p50", "p75", "p95")
    return metrics.groupBy(*as_list(keys)).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), *m.quantile_columns(value, probs, names))


def path_statistics(paths: DataFrame, keys: Keys, sim: str = "sim_id", step: str = "step", value: str = "value",
                    start: float = 1.0) -> DataFrame:
    """Distribution of final path values: moments, loss probability, expected profit and loss, 95% interval."""
    keys = as_list(keys)
    final = paths.groupBy(*keys, sim).agg(F.max_by(value, step).alias("_f"))
    gain = F.col("_f") - start
    return final.groupBy(*keys).agg(
        F.count("*").alias("paths"), F.avg("_f").alias("mean"), F.stddev_pop("_f").alias("std"),
        F.min("_f").alias("min"), F.max("_f").alias("max"),
        F.avg((gain < 0).cast("int")).alias("probability_of_loss"),
        F.avg(F.when(gain < 0, gain)).alias("expected_loss"), F.avg(F.when(gain > 0, gain)).alias("expected_profit"),
        *m.quantile_columns("_f", (0.025, 0.5, 0.975), ("ci_low", "median", "ci_high")))
