"""Return, risk and ratio measures as aggregate expressions.

Each function returns a Column to be used in ``groupBy(any keys).agg(...)`` (also under ``rollup`` and
``cube``).  All but the exact quantiles combine on the map side.  ``dd`` arguments take a drawdown column
made by ``operators.risk.drawdown_path``.  Where the formula has no value (no losses, flat series) the
result is null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.stats import (ROOT_YEAR, TRADING_DAYS, adjusted_kurtosis, adjusted_skewness,
                                       col, normal_quantile, safe_ratio)

R = Column | str


# Value at risk: a signed return at the tail probability ``p``.

def var_historical(r: R, p: float = 0.05) -> Column:
    return F.percentile(col(r), F.lit(p))


def var_approximate(r: R, p: float = 0.05, accuracy: int = 10_000) -> Column:
    """Opt-in for one huge group; the rank error is 1 / accuracy."""
    return F.percentile_approx(col(r), p, accuracy)


def var_parametric(r: R, p: float = 0.05) -> Column:
    return F.avg(col(r)) + normal_quantile(p) * F.stddev_pop(col(r))


def var_cornish_fisher(r: R, p: float = 0.05) -> Column:
    z, s, k = normal_quantile(p), F.skewness(col(r)), F.kurtosis(col(r))
    adjusted = z + (z * z - 1) * s / 6 + (z ** 3 - 3 * z) * k / 24 - (2 * z ** 3 - 5 * z) * s * s / 36
    return F.avg(col(r)) + adjusted * F.stddev_pop(col(r))


def mean_at_or_below(r: R, level: R) -> Column:
    return F.avg(F.when(col(r) <= col(level), col(r)))


# Totals and annualised figures.

def total_return(r: R) -> Column:
    return F.product(1 + col(r)) - 1


def annualised_return(r: R, periods: int = TRADING_DAYS) -> Column:
    return F.pow(F.product(1 + col(r)), F.try_divide(F.lit(float(periods)), F.count(col(r)))) - 1


def annualised_mean_return(r: R, periods: int = TRADING_DAYS) -> Column:
    """(1 + mean) ** periods - 1."""
    return F.pow(1 + F.avg(col(r)), periods) - 1


def annualised_volatility(r: R, periods: int = TRADING_DAYS) -> Column:
    return F.stddev_samp(col(r)) * periods ** 0.5


# Sharpe and Sortino come in several conventions; the caller names one.

SHARPE_STYLES = ("excess", "annual", "annual_no_rf", "mean")
SORTINO_STYLES = ("downside_rms", "analyzer", "engine")


def sharpe(r: R, rf: float = 0.02, style: str = "excess") -> Column:
    """``excess``: mean excess / std; ``annual``: (annualised - rf) / vol; ``annual_no_rf``; ``mean``: mean / std."""
    r = col(r)
    if style == "excess":
        return safe_ratio(F.avg(r) - rf / TRADING_DAYS, F.stddev_samp(r)) * ROOT_YEAR
    if style == "annual":
        return safe_ratio(annualised_return(r) - rf, annualised_volatility(r))
    if style == "annual_no_rf":
        return safe_ratio(annualised_return(r), annualised_volatility(r))
    if style == "mean":
        return safe_ratio(F.avg(r), F.stddev_samp(r)) * ROOT_YEAR
    raise ValueError(f"unknown Sharpe style {style!r}; one of {SHARPE_STYLES}")


def sortino(r: R, rf: float = 0.0, style: str = "downside_rms") -> Column:
    """``downside_rms``: rms of negative excess; ``analyzer``: std of r < rf/252; ``engine``: std of r < 0, no rf."""
    r = col(r)
    if style == "downside_rms":
        excess = r - rf / TRADING_DAYS
        below = F.sqrt(F.avg(F.when(excess < 0, excess * excess)))
        return safe_ratio(F.avg(excess) * ROOT_YEAR, below, None)
    if style == "analyzer":
        below = F.stddev_samp(F.when(r < rf / TRADING_DAYS, r)) * ROOT_YEAR
        return safe_ratio(annualised_return(r) - rf, below)
    if style == "engine":
        return safe_ratio(annualised_return(r), F.stddev_samp(F.when(r < 0, r)) * ROOT_YEAR)
    raise ValueError(f"unknown Sortino style {style!r}; one of {SORTINO_STYLES}")


def omega(r: R, threshold: float = 0.0) -> Column:
    x = col(r) - threshold
    return safe_ratio(F.sum(F.when(x > 0, x).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x))), None)


def tail_ratio(r: R) -> Column:
    q = F.percentile(col(r), F.array(F.lit(0.95), F.lit(0.05)))
    return F.abs(safe_ratio(q[0], q[1]))


def semi_variance(r: R, threshold: float = 0.0) -> Column:
    """Mean square below the threshold, over the rows below it only."""
    x = col(r) - threshold
    return F.coalesce(F.avg(F.when(x < 0, x * x)), F.lit(0.0))


def semi_deviation(r: R, threshold: float = 0.0) -> Column:
    return F.sqrt(semi_variance(r, threshold))


def upside_deviation(r: R, threshold: float = 0.0) -> Column:
    x = col(r) - threshold
    return F.coalesce(F.sqrt(F.avg(F.when(x > 0, x * x))), F.lit(0.0))


def average_win(r: R, threshold: float = 0.0) -> Column:
    return F.coalesce(F.avg(F.when(col(r) > threshold, col(r))), F.lit(0.0))


def average_loss(r: R, threshold: float = 0.0) -> Column:
    return F.coalesce(F.avg(F.when(col(r) < threshold, col(r))), F.lit(0.0))


def gain_loss_ratio(r: R, threshold: float = 0.0) -> Column:
    return safe_ratio(average_win(r, threshold), F.avg(F.when(col(r) < threshold, F.abs(col(r)))), None)


def win_loss_ratio(r: R) -> Column:
    return F.abs(safe_ratio(average_win(r), average_loss(r), None))


def win_rate(r: R, threshold: float = 0.0) -> Column:
    """Share strictly above the threshold."""
    return F.avg((col(r) > threshold).cast("int"))


# Measures on a drawdown column.

def max_drawdown(dd: R) -> Column:
    return F.min(col(dd))


def calmar(r: R, dd: R, periods: int = TRADING_DAYS) -> Column:
    """Mean return a year over the depth of the additive drawdown; 0 or null when there is none."""
    year = F.avg(col(r)) * periods
    return F.when(F.min(col(dd)) != 0, year / F.abs(F.min(col(dd)))).when(year <= 0, 0.0)


def pain_index(dd: R) -> Column:
    return F.avg(F.abs(col(dd)))


def ulcer_index(dd: R) -> Column:
    return F.sqrt(F.avg(col(dd) * col(dd)))


def burke(r: R, dd: R, rf: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    return safe_ratio((F.avg(col(r)) - rf / periods) * periods ** 0.5, ulcer_index(dd), None)


# Benchmark-relative measures on two aligned return columns.

def beta(r: R, b: R) -> Column:
    """Sample covariance over population variance."""
    return safe_ratio(F.covar_samp(col(r), col(b)), F.var_pop(col(b)))


def tracking_error(r: R, b: R) -> Column:
    return F.stddev_samp(col(r) - col(b)) * ROOT_YEAR


def information_ratio(r: R, b: R) -> Column:
    excess = col(r) - col(b)
    return safe_ratio(F.avg(excess), F.stddev_samp(excess)) * ROOT_YEAR


def alpha_annualised(r: R, b: R) -> Column:
    """Difference of the annualised returns."""
    return annualised_return(r) - annualised_return(b)


def alpha_capm(r: R, b: R, rf: float = 0.02) -> Column:
    daily = rf / TRADING_DAYS
    return (F.avg(col(r)) - daily - beta(r, b) * (F.avg(col(b)) - daily)) * TRADING_DAYS


def capture(r: R, b: R, side: str, style: str = "compounded") -> Column:
    """Up or down capture; ``compounded`` products or ``mean`` ratio."""
    if side not in ("up", "down") or style not in ("compounded", "mean"):
        raise ValueError("side is up or down, style compounded or mean")
    chosen = col(b) > 0 if side == "up" else col(b) < 0
    if style == "mean":
        return safe_ratio(F.avg(F.when(chosen, col(r))), F.avg(F.when(chosen, col(b))))
    return F.coalesce(safe_ratio(F.product(F.when(chosen, 1 + col(r))) - 1,
                                 F.product(F.when(chosen, 1 + col(b))) - 1), F.lit(0.0))


# Measure sets.

def return_set(r: R = "ret", rf: float = 0.02) -> list[Column]:
    """Total, annualised, volatility, Sharpe, Sortino and moments in the comprehensive convention."""
    return [
        F.count(col(r)).alias("periods"), total_return(r).alias("total_return"),
        annualised_return(r).alias("annualized_return"), F.stddev_samp(col(r)).alias("volatility"),
        annualised_volatility(r).alias("annualized_volatility"),
        sharpe(r, rf, "excess").alias("sharpe_ratio"), sortino(r, rf).alias("sortino_ratio"),
        var_historical(r, 0.05).alias("var_95"), adjusted_skewness(r).alias("skewness"),
        adjusted_kurtosis(r).alias("kurtosis"), omega(r).alias("omega_ratio"),
        tail_ratio(r).alias("tail_ratio"), win_rate(r).alias("win_rate"),
        average_win(r).alias("average_win"), average_loss(r).alias("average_loss"),
        win_loss_ratio(r).alias("win_loss_ratio"),
    ]


def benchmark_set(r: R = "ret", b: R = "bench") -> list[Column]:
    return [
        alpha_annualised(r, b).alias("alpha"), information_ratio(r, b).alias("information_ratio"),
        tracking_error(r, b).alias("tracking_error"), beta(r, b).alias("beta"),
        F.corr(col(r), col(b)).alias("correlation"),
        capture(r, b, "up").alias("up_capture"), capture(r, b, "down").alias("down_capture"),
    ]


def styled_set(r: R, style: str, rf: float = 0.02, dd: R | None = None) -> list[Column]:
    """Metric set in one of the named conventions: analyzer, engine, framework, simple, gauge."""
    base = [total_return(r).alias("total_return")]
    if style == "simple":
        base += [annualised_mean_return(r).alias("annualized_return"),
                 annualised_volatility(r).alias("annualized_volatility"),
                 safe_ratio(annualised_mean_return(r), annualised_volatility(r)).alias("sharpe_ratio")]
    elif style == "gauge":
        n = F.count(col(r))
        base = [F.when(n > 20, annualised_volatility(r)).alias("annualized_volatility"),
                F.when(n > 20, sharpe(r, rf, "excess")).alias("sharpe_ratio")]
    elif style in ("analyzer", "framework", "engine"):
        no_rf = style == "engine"
        base += [annualised_return(r).alias("annualized_return"),
                 annualised_volatility(r).alias("annualized_volatility"),
                 sharpe(r, rf, "annual_no_rf" if no_rf else "annual").alias("sharpe_ratio"),
                 sortino(r, rf, "engine" if no_rf else "analyzer").alias("sortino_ratio"),
                 win_rate(r).alias("win_rate"), average_win(r).alias("average_win"),
                 average_loss(r).alias("average_loss")]
    else:
        raise ValueError(f"unknown metric style {style!r}")
    if dd is not None:
        base.append(max_drawdown(dd).alias("max_drawdown"))
        if style in ("analyzer", "framework", "engine"):
            base.append(safe_ratio(annualised_return(r), F.abs(max_drawdown(dd))).alias("calmar_ratio"))
    return base


def quantile_columns(r: R, probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Several quantiles of one column from one ``percentile`` call per name (shared by the optimiser)."""
    q = F.percentile(col(r), F.array(*[F.lit(p) for p in probs]))
    return [q[i].alias(name) for i, name in enumerate(names)]
