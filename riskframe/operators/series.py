"""Rolling indicators, drawdown periods, streaks, regime intervals and other ordered operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.stats import ROOT_YEAR, TRADING_DAYS, adjusted_kurtosis, adjusted_skewness, ieee_ratio
from riskframe.plans.chunked import Chunks
from riskframe.plans.scans import affine_scans
from riskframe.plans.windows import Keys, as_list, by, full, running, trailing, whole


def rolling_volatility(df: DataFrame, n: int = 20, keys: Keys = "symbol", ret: str = "ret", ts: str = "ts") -> DataFrame:
    w = trailing(keys, n, ts)
    return df.withColumn("volatility", full(F.stddev_samp(ret), ret, w, n) * ROOT_YEAR)


def volume_indicators(df: DataFrame, n: int = 20, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    mean = full(F.avg("volume"), "volume", trailing(keys, n, ts), n)
    return df.withColumns({"volume_ma": mean, "volume_ratio": F.try_divide(F.col("volume"), mean)})


def sma(df: DataFrame, column: str, windows: Sequence[int] = (5, 20), keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    return df.withColumns({f"sma_{n}": full(F.avg(column), column, trailing(keys, n, ts), n) for n in windows})


def ema(df: DataFrame, column: str, spans: Sequence[int] = (12, 26), keys: Keys = "symbol", ts: str = "ts",
        bucket: Column | None = None, chunk_rows: int = 200_000) -> DataFrame:
    """Exponential means with normalised weights over the whole series so far: ``num = keep * num + x`` and
    ``den = keep * den + 1`` by row.  A missing value adds nothing, but weights decay across it; before the first
    value the mean is null.  Series of any length: both recurrences are scanned over chunks (``bucket`` is the unit of
    time that rows are counted by; unless given a month, or ``chunk_rows`` units of a numeric ``ts``).
    """
    keys = as_list(keys)
    value = F.col(column).cast("double")
    known = value.isNotNull() & ~F.isnan(value)
    rows = df.withColumns({"_x": F.when(known, value).otherwise(0.0), "_one": F.when(known, 1.0).otherwise(0.0),
                           **{f"_keep_{n}": F.lit(1 - 2 / (n + 1)) for n in spans}})
    maps = {f"_{part}_{n}": (f"_keep_{n}", b) for n in spans for part, b in (("num", "_x"), ("den", "_one"))}
    if bucket is None:
        dated = df.schema[ts].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        bucket = F.date_trunc("month", F.col(ts)) if dated else F.floor(F.col(ts) / chunk_rows)
    scanned = affine_scans(rows, keys, [ts], maps, bucket, chunk_rows)

    def now(part: str, n: int, b: str) -> Column:
        return F.col(f"_keep_{n}") * F.col(f"_{part}_{n}") + F.col(b)

    return scanned.select(*df.columns, *[F.try_divide(now("num", n, "_x"), now("den", n, "_one")).alias(f"ema_{n}") for n in spans])


def rolling_moments(df: DataFrame, column: str, n: int = 20, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    w = trailing(keys, n, ts)
    ready = F.count(column).over(w) == n
    return df.withColumns({
        f"std_{n}": F.when(ready, F.stddev_samp(column).over(w)),
        f"skew_{n}": F.when(ready, adjusted_skewness(column, w)),
        f"kurt_{n}": F.when(ready, adjusted_kurtosis(column, w))})


def rsi(df: DataFrame, column: str, n: int = 14, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    """Relative strength on simple means; the missing first difference counts as zero."""
    w = trailing(keys, n, ts)
    moved = df.withColumn("_d", F.coalesce(F.col(column) - F.lag(column).over(by(keys, ts)), F.lit(0.0)))
    gain = F.avg(F.greatest("_d", F.lit(0.0))).over(w)
    loss = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w)
    value = F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return moved.withColumn("rsi", F.when(F.count("_d").over(w) == n, value)).drop("_d")


def bollinger(df: DataFrame, column: str, n: int = 20, width: float = 2.0, keys: Keys = "symbol",
              ts: str = "ts") -> DataFrame:
    w = trailing(keys, n, ts)
    mid, sd = full(F.avg(column), column, w, n), full(F.stddev_samp(column), column, w, n)
    return df.withColumns({"bb_middle": mid, "bb_upper": mid + width * sd, "bb_lower": mid - width * sd})


def momentum(df: DataFrame, column: str, windows: Sequence[int] = (10, 20), keys: Keys = "symbol",
             ts: str = "ts") -> DataFrame:
    return df.withColumns({f"momentum_{n}": full(F.sum(column), column, trailing(keys, n, ts), n) for n in windows})


def volatility_trend(df: DataFrame, column: str, short: int = 10, long: int = 60, keys: Keys = "symbol",
                     ts: str = "ts") -> DataFrame:
    from riskframe.operators.prep import sign_flag
    mean = full(F.avg(column), column, trailing(keys, long, ts), long)
    return df.withColumns({"vol_sma": full(F.avg(column), column, trailing(keys, short, ts), short),
                           "vol_regime": sign_flag(F.col(column) > mean)})


def rolling_correlation(df: DataFrame, a: str, b: str, n: int = 30, keys: Keys = "symbol", ts: str = "ts",
                        out: str = "correlation") -> DataFrame:
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    return df.withColumn(out, full(F.corr(a, b), both, trailing(keys, n, ts), n))


def _fold_drawdown(values: Column) -> Column:
    """Worst additive drawdown of an array of returns."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        w = acc["w"] * (1 + x)
        peak = F.greatest(acc["peak"], w)
        return F.struct(w.alias("w"), peak.alias("peak"), F.least(acc["worst"], w - peak).alias("worst"))

    return F.aggregate(values, start, step, lambda acc: acc["worst"])


def rolling_performance(df: DataFrame, n: int = 252, keys: Keys = "portfolio_id", ret: str = "ret", ts: str = "ts",
                        metrics: Sequence[str] = ("return", "volatility", "sharpe")) -> DataFrame:
    """Rolling return, volatility, sharpe, max_drawdown and var, complete windows only."""
    w = trailing(keys, n, ts)
    out: dict[str, Column] = {}
    if "return" in metrics:
        total = F.product(1 + F.col(ret)).over(w) - 1
        out |= {"rolling_return": total, "annualized_return": F.pow(1 + total, TRADING_DAYS / n) - 1}
    if "volatility" in metrics:
        out["rolling_volatility"] = F.stddev_samp(ret).over(w) * ROOT_YEAR
    if "sharpe" in metrics:
        out["rolling_sharpe"] = F.try_divide(F.avg(ret).over(w), F.stddev_samp(ret).over(w)) * ROOT_YEAR
    if "max_drawdown" in metrics:
        out["rolling_max_drawdown"] = _fold_drawdown(F.collect_list(ret).over(w))
    if "var" in metrics:
        out["rolling_var_95"] = F.percentile(ret, F.lit(0.05)).over(w)
    return (df.withColumns({**out, "_n": F.count(ret).over(w)}).where(F.col("_n") == n).drop("_n"))


def rolling_analysis(df: DataFrame, n: int, keys: Keys = "portfolio_id", ret: str = "ret", ts: str = "ts",
                     rf: float = 0.02) -> DataFrame:
    """Rolling return, volatility, Sharpe ((return * 252 - rf) / vol) and drawdown from the rolling peak."""
    w = trailing(keys, n, ts)
    valued = df.withColumn("_value", F.product(1 + F.col(ret)).over(running(keys, ts)))
    ready = F.count(ret).over(w) == n
    total = F.product(1 + F.col(ret)).over(w) - 1
    vol = F.stddev_samp(ret).over(w) * ROOT_YEAR
    return valued.withColumns({
        "rolling_return": F.when(ready, total), "rolling_volatility": F.when(ready, vol),
        "rolling_sharpe": F.when(ready, F.try_divide(total * TRADING_DAYS - rf, vol)),
        "rolling_drawdown": F.when(ready, F.try_divide(F.col("_value"), F.max("_value").over(w)) - 1)}).drop("_value")


def regime_features(df: DataFrame, windows: Sequence[int] = (5, 10, 20, 60), keys: Keys = "series_id",
                    ret: str = "ret", ts: str = "ts", fill: bool = True) -> DataFrame:
    """Regime feature block per window plus the cross-window features; gaps take the next value, then 0."""
    r = F.col(ret)
    base = df.withColumns({"abs_returns": F.abs(r), "squared_returns": r * r, "_prev": F.lag(ret).over(by(keys, ts))})
    first, second = {}, {}
    for n in windows:
        w, p = trailing(keys, n, ts), f"rolling_{n}d"
        pairs = by(keys, ts).rowsBetween(-(n - 2), 0)
        ready = F.count(ret).over(w) == n
        vol, mean = F.stddev_samp(ret).over(w), F.avg(ret).over(w)
        cols = {
            "volatility": vol, "realized_vol": F.sqrt(F.sum(r * r).over(w)), "mean_return": mean,
            "cumulative_return": F.product(1 + r).over(w) - 1, "skewness": adjusted_skewness(ret, w),
            "kurtosis": adjusted_kurtosis(ret, w), "momentum": F.sum(ret).over(w),
            "max_return": F.max(ret).over(w), "min_return": F.min(ret).over(w),
            "range": F.max(ret).over(w) - F.min(ret).over(w), "autocorr": F.corr(ret, "_prev").over(pairs)}
        first |= {f"{p}_{name}": F.when(ready, c) for name, c in cols.items()}
        gap, v = r - F.col(f"{p}_mean_return"), f"{p}_volatility"
        second |= {f"{p}_mean_reversion": F.when(F.count(gap).over(w) == n, F.avg(gap).over(w)),
                   f"{p}_vol_ratio": F.try_divide(F.col(v), full(F.avg(v), v, w, n))}
    shaped = base.withColumns(first).withColumns(second).drop("_prev")
    if {5, 20, 60} <= set(windows):
        year = trailing(keys, TRADING_DAYS, ts)
        short, long = F.col("rolling_5d_volatility"), F.col("rolling_60d_volatility")
        shaped = shaped.withColumns({
            "vol_short_long_ratio": F.try_divide(short, long),
            "return_short_long_ratio": F.try_divide("rolling_5d_mean_return", "rolling_60d_mean_return"),
            "fear_index": F.try_divide(short, full(F.avg(long), long, year, TRADING_DAYS)) * 100,
            "volatility_spike": F.coalesce((short > long * 2).cast("int"), F.lit(0)),
            "extreme_return": F.coalesce((F.abs(r) > F.col("rolling_20d_volatility") * 2).cast("int"), F.lit(0))})
    if not fill:
        return shaped
    ahead = by(keys, ts).rowsBetween(0, Window.unboundedFollowing)
    made = [c for c in shaped.columns if c not in df.columns]
    return shaped.withColumns({c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(0)) for c in made})


def cumulative(df: DataFrame, column: str, keys: Keys, ts: str = "ts") -> DataFrame:
    w = running(keys, ts)
    return df.withColumns({"cum_product": F.product(1 + F.col(column)).over(w), "cum_sum": F.sum(column).over(w),
                           "running_max": F.max(column).over(w)})


# Drawdown periods.

#: threshold, strict entry, recovery test, still-open period reported, depth measured from the entry row
DRAWDOWN_STYLES = {
    "performance": (0.05, False, "near", True, "entry"),
    "analyzer": (0.01, False, "above", False, "drawdown"),
    "engine": (0.01, True, "near", False, "entry"),
    "framework": (0.005, True, "near", False, "entry"),
}


def drawdown_periods(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts", style: str = "performance",
                     threshold: float | None = None) -> DataFrame:
    """One row per drawdown period: entry, trough, recovery.  Entry and exit cannot meet on one row, so the
    state machine is a last-known flag, and periods are numbered by counting entries."""
    if style not in DRAWDOWN_STYLES:
        raise ValueError(f"unknown drawdown style {style!r}; one of {sorted(DRAWDOWN_STYLES)}")
    default, strict, exit_test, keep_open, depth = DRAWDOWN_STYLES[style]
    limit = -(default if threshold is None else threshold)
    keys = as_list(keys)
    run, order = running(keys, ts), by(keys, ts)
    path = df.withColumn("_w", F.product(1 + F.col(ret)).over(run))
    path = path.withColumn("_dd", F.try_divide(F.col("_w"), F.max("_w").over(run)) - 1)
    enter = F.col("_dd") < limit if strict else F.col("_dd") <= limit
    leave = F.col("_dd") > -0.001 if exit_test == "above" else F.abs("_dd") < 0.001
    path = path.withColumn("_state", F.last(F.when(enter, 1).when(leave, 0), ignorenulls=True).over(run))
    path = path.withColumn("_was", F.coalesce(F.lag("_state").over(order), F.lit(0)))
    path = path.withColumn("_id", F.sum(((F.col("_state") == 1) & (F.col("_was") == 0)).cast("int")).over(run))
    # A period holds its rows in drawdown and the recovery row that closes it.
    inside = path.where((F.col("_state") == 1) | (F.col("_was") == 1))
    row = F.struct("_w", ts)
    trough = row if depth == "entry" else F.struct("_dd", ts)
    periods = inside.groupBy(*keys, F.col("_id").alias("period")).agg(
        F.min(ts).alias("start_date"), F.min_by("_w", ts).alias("peak_value"),
        F.min_by("_w", trough).alias("trough_value"), F.min_by(ts, trough).alias("trough_date"),
        F.min("_dd").alias("_deepest"), F.max(ts).alias("end_date"), F.max_by("_w", ts).alias("recovery_value"),
        F.max((F.col("_state") == 0).cast("int")).alias("_closed"))
    closed = F.col("_closed") == 1
    shaped = periods.withColumns({
        "max_drawdown": F.try_divide("trough_value", "peak_value") - 1 if depth == "entry" else F.col("_deepest"),
        "duration_days": F.datediff("end_date", "start_date"),
        "recovery_days": F.when(closed, F.datediff("end_date", "trough_date")),
        "recovered": closed})
    return (shaped if keep_open else shaped.where("recovered")).drop("_deepest", "_closed")


# Streaks.

def _runs(df: DataFrame, label: Column, keys: Sequence[str], ts: str) -> DataFrame:
    """Number the runs of equal labels: ``_label`` and ``run``."""
    w = by(keys, ts)
    labelled = df.withColumn("_label", label)
    change = (~F.col("_label").eqNullSafe(F.lag("_label").over(w))) | (F.row_number().over(w) == 1)
    return labelled.withColumn("_new", change.cast("int")).withColumn(
        "run", F.sum("_new").over(running(keys, ts))).drop("_new")


def win_loss_streaks(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Longest winning and losing run and the current one (signed); a zero return, or one not a number, ends both."""
    keys = as_list(keys)
    runs = (_runs(df, F.nanvl(F.signum(ret), F.lit(0.0)).cast("int"), keys, ts).groupBy(*keys, "run", "_label")
            .agg(F.count("*").alias("n"), F.max(ts).alias("_end")))
    longest = {s: F.coalesce(F.max(F.when(F.col("_label") == s, F.col("n"))), F.lit(0)) for s in (1, -1)}
    return runs.groupBy(*keys).agg(
        longest[1].alias("max_win_streak"), longest[-1].alias("max_loss_streak"),
        F.max_by(F.col("_label") * F.col("n"), "_end").alias("current_streak"))


def max_consecutive_losses(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts") -> DataFrame:
    return win_loss_streaks(df, keys, ret, ts).select(
        *as_list(keys), F.col("max_loss_streak").alias("max_consecutive_losses"))


# Regime label series.

def regime_changes(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts") -> DataFrame:
    """Rows on which the label differs from the one before."""
    w = by(keys, ts)
    return (df.withColumn("from_regime", F.lag(label).over(w)).withColumn("to_regime", F.col(label))
            .where(F.col("from_regime").isNotNull() & (F.col("from_regime") != F.col("to_regime"))))


def regime_change_stats(df: DataFrame, keys: Keys, label: str = "regime", ret: str = "ret", ts: str = "ts") -> DataFrame:
    return regime_changes(df, keys, label, ts).groupBy(*as_list(keys), "from_regime", "to_regime").agg(
        F.count("*").alias("count"), F.avg(ret).alias("avg_return"), F.stddev_pop(ret).alias("std_return"),
        F.avg((F.col(ret) > 0).cast("int")).alias("success_rate"))


def regime_intervals(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts",
                     ret: str | None = None) -> DataFrame:
    """Run-length intervals; with ``ret`` also mean, std, compounded return, drawdown and Sharpe."""
    keys = as_list(keys)
    runs = _runs(df, F.col(label), keys, ts)
    aggs = [F.min(ts).alias("start_date"), F.max(ts).alias("end_date"), F.count("*").alias("duration")]
    if ret is not None:
        inside = running([*keys, "run"], ts)
        runs = runs.withColumn("_s", F.sum(ret).over(inside)).withColumn(
            "_dd", F.col("_s") - F.max("_s").over(inside))
        sd = F.stddev_samp(ret)
        aggs += [F.avg(ret).alias("mean_return"), sd.alias("volatility"),
                 (F.product(1 + F.col(ret)) - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"),
                 F.when(sd > 0, F.avg(ret) / sd).otherwise(0.0).alias("sharpe_ratio")]
    return runs.groupBy(*keys, "run", F.col("_label").alias(label)).agg(*aggs)


def rank_strategies(metrics: DataFrame, name: str = "strategy", columns: Sequence[str] = ()) -> DataFrame:
    """Rank 1 = best per metric, ties by name; input one row per strategy, output long."""
    long = metrics.unpivot(name, list(columns), "metric", "value")
    order = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), name)
    return long.withColumn("rank", F.row_number().over(order))


def gaps(df: DataFrame, keys: Keys = "symbol", ts: str = "ts", factor: float = 2.0) -> DataFrame:
    """Steps longer than ``factor`` times the median step of the series."""
    keys = as_list(keys)
    moment = F.col(ts).cast("timestamp")
    step = F.unix_micros(moment) - F.unix_micros(F.lag(moment).over(by(keys, ts)))
    stepped = df.withColumn("step_seconds", step / 1e6).where("step_seconds IS NOT NULL")
    median = stepped.groupBy(*keys).agg(F.percentile("step_seconds", F.lit(0.5)).alias("median_seconds"))
    return stepped.join(median, keys).where(F.col("step_seconds") > factor * F.col("median_seconds"))


def correlation_breaks(df: DataFrame, n: int = 252, threshold: float = 0.3, ts: str = "ts", symbol: str = "symbol",
                       value: str = "ret", blocks: int = 1, slice_rows: int = 2000) -> DataFrame:
    """Dates on which some pair's correlation over the n rows before and the n rows from it differ by more
    than ``threshold``.  Complete dates only.  Blocks of symbols meet per slice of dates with its margins;
    no row-level pairs are formed."""
    from riskframe.plans.pairs import _block_copies, _matrix
    width = df.select(symbol).distinct().groupBy().agg(F.count("*").alias("_all"))
    rows = df.where(F.col(value).isNotNull()).select(
        F.col(symbol).cast("string").alias("_s"), F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"))
    # The dates every symbol has, numbered; one row per date, so the window is bounded by the calendar.
    dates = (rows.groupBy("_t").agg(F.count("*").alias("_n")).withColumn("_k", F.lit(1))
             .join(width.withColumn("_k", F.lit(1)), "_k").where(F.col("_n") == F.col("_all"))
             .withColumn("_rn", F.row_number().over(Window.partitionBy("_k").orderBy("_t")) - 1)
             .withColumn("_total", F.count("*").over(Window.partitionBy("_k")))
             .select("_t", "_rn", "_total"))
    first = F.greatest(F.lit(0), F.floor((F.col("_rn") - n) / slice_rows))
    last = F.floor((F.col("_rn") + n) / slice_rows)
    placed = rows.join(dates, "_t").withColumn("_slice", F.explode(F.sequence(first, last)))
    tagged = _block_copies(placed, blocks)

    def scan(group, pdf: pd.DataFrame) -> pd.DataFrame:
        x, _, times = _matrix(pdf)
        rn = pdf.drop_duplicates("_t").set_index("_t")["_rn"].reindex(times).to_numpy()
        total, low = int(pdf["_total"].iloc[0]), int(group[2]) * slice_rows
        out = []
        for position in range(len(rn)):
            r = int(rn[position])
            if low <= r < low + slice_rows and n <= r < total - n:
                before = np.corrcoef(x[position - n:position], rowvar=False)
                after = np.corrcoef(x[position:position + n], rowvar=False)
                out.append((times[position], float(np.nanmax(np.abs(after - before)))))
        return pd.DataFrame(out, columns=[ts, "change"]).astype({ts: "datetime64[us]", "change": "float64"})

    schema = f"`{ts}` timestamp, change double"
    return (tagged.groupBy("_bi", "_bj", "_slice").applyInPandas(scan, schema)
            .groupBy(ts).agg(F.max("change").alias("change")).where(F.col("change") > threshold))


def realised_volatility(ticks: DataFrame, method: str = "standard", keys: Keys = "symbol", ts: str = "ts",
                        price: str = "price", tie: Sequence[str] = (), bucket: str = "hour") -> DataFrame:
    """Daily realised variation from ticks.  Returns are chained over the whole series, buckets keep a hot
    symbol spread over tasks.  standard: sqrt(252 sum r^2); bipower: 252 pi/2 sum |r_t||r_t+1|; two_scale."""
    keys = as_list(keys)
    chunks = Chunks(keys, [ts, *tie], F.date_trunc(bucket, ts))
    slim = ticks.select(*keys, ts, *tie, price)
    rets = (chunks.previous(slim, {"_p": price}).withColumn("_r", ieee_ratio(price, "_p") - 1)
            .where("_r IS NOT NULL").withColumn("day", F.date_trunc("day", ts)))
    daily = Chunks([*keys, "day"], [ts, *tie], F.date_trunc(bucket, ts))
    total = F.sum(F.col("_r") * F.col("_r"))
    if method == "standard":
        return rets.groupBy(*keys, "day").agg(F.sqrt(total * TRADING_DAYS).alias("realised"))
    if method == "bipower":
        neighbours = daily.previous(rets, {"_q": "_r"})
        return neighbours.groupBy(*keys, "day").agg(
            (math.pi / 2 * TRADING_DAYS * F.coalesce(F.sum(F.abs("_r") * F.abs("_q")), F.lit(0.0))).alias("realised"))
    if method == "two_scale":
        n, sub = F.count("*"), 2 * F.sum(F.when(F.col("_i") % 2 == 1, F.col("_r") * F.col("_r")))
        value = F.when(n < 4, total).otherwise(total - (sub - total) / F.greatest(n / 2 - 1, F.lit(1e-300)))
        return daily.rank(rets, "_i").groupBy(*keys, "day").agg((value * TRADING_DAYS).alias("realised"))
    raise ValueError(f"unknown method {method!r}; one of standard, bipower, two_scale")


def hurst_exponent(df: DataFrame, keys: Keys = "series_id", ret: str = "ret", ts: str = "ts",
                   n_scales: int = 20) -> DataFrame:
    """Rescaled-range estimate over ``n_scales`` log-spaced scales, clipped to [0.1, 0.9]."""
    keys = as_list(keys)
    ranked = df.where(F.col(ret).isNotNull()).select(
        *keys, F.col(ret).alias("_r"), (F.row_number().over(by(keys, ts)) - 1).alias("_rn"),
        F.count("*").over(whole(keys)).alias("_n"))
    step = (F.log10(F.floor(F.col("_n") / 4)) - 1) / (n_scales - 1)
    scales = F.transform(F.sequence(F.lit(0), F.lit(n_scales - 1)),
                         lambda k: F.struct(k.alias("k"), F.floor(
                             F.pow(F.lit(10.0), 1 + k * step) + 1e-9).alias("scale")))
    spread = ranked.withColumn("_s", F.explode(scales)).select("*", "_s.k", "_s.scale").drop("_s")
    spread = spread.withColumn("_win", F.floor(F.col("_rn") / F.col("scale"))).where(
        (F.col("_win") + 1) * F.col("scale") <= F.col("_n"))
    window = [*keys, "k", "scale", "_win"]
    gone = spread.withColumn("_dep", F.col("_r") - F.avg("_r").over(whole(window)))
    gone = gone.withColumn("_dep", F.sum("_dep").over(running(window, "_rn")))
    per_window = gone.groupBy(*window).agg(
        (F.max("_dep") - F.min("_dep")).alias("_range"), F.stddev_pop("_r").alias("_sd")).where("_sd > 0")
    per_scale = per_window.groupBy(*keys, "k", "scale").agg(F.avg(F.col("_range") / F.col("_sd")).alias("rs"))
    slope = F.regr_slope(F.log("rs"), F.log("scale"))
    return per_scale.groupBy(*keys).agg(F.greatest(F.lit(0.1), F.least(F.lit(0.9), slope)).alias("hurst"))


def volatility_tercile_regimes(df: DataFrame, keys: Keys = "series_id", ret: str = "ret", ts: str = "ts",
                               n: int = 20, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """0 low, 1 middle (also while the window fills), 2 high volatility, against quantiles of the series."""
    keys = as_list(keys)
    rolled = df.withColumn("vol", full(F.stddev_samp(ret), ret, trailing(keys, n, ts), n))
    # The quantiles as a window: the series keeps its one shuffle.
    cuts = F.percentile("vol", F.array(F.lit(low), F.lit(high))).over(whole(keys))
    regime = F.when(F.col("vol") <= F.col("_q")[0], 0).when(F.col("vol") > F.col("_q")[1], 2).otherwise(1)
    return rolled.withColumn("_q", cuts).withColumn("regime", regime).drop("_q")


def regime_probabilities(df: DataFrame, states: int = 3, sure: float = 0.8, label: str = "regime") -> DataFrame:
    """Fixed probabilities: ``sure`` for the label, the rest shared equally."""
    rest = (1 - sure) / (states - 1)
    return df.withColumn("probs", F.array(*[F.when(F.col(label) == k, sure).otherwise(rest) for k in range(states)]))


def regime_switches(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts") -> DataFrame:
    """Flag the rows on which a portfolio should be rebalanced because the regime is a new one."""
    w = by(keys, ts)
    return df.withColumn("switched", F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)))
