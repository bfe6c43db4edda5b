"""Cleaning, reshaping, calendar and feature preparation on long tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.stats import ieee_ratio
from riskframe.plans.quantiles import exact_quantiles
from riskframe.plans.windows import Keys, as_list, by, following, running, trailing, whole

FREQUENCIES = ("daily", "weekly", "monthly", "quarterly", "yearly")


def simple_returns(df: DataFrame, keys: Keys = "symbol", price: str = "close", ts: str = "ts",
                   out: str = "ret") -> DataFrame:
    """price / previous price - 1, infinite after a price of zero; the first row of each series is dropped."""
    return df.withColumn(out, ieee_ratio(price, F.lag(price).over(by(keys, ts))) - 1).where(F.col(out).isNotNull())


def change_over(df: DataFrame, periods: int, keys: Keys = "symbol", column: str = "close", ts: str = "ts",
                out: str = "change") -> DataFrame:
    return df.withColumn(out, ieee_ratio(column, F.lag(column, periods).over(by(keys, ts))) - 1)


def cross_section_mean(df: DataFrame, columns: Mapping[str, str | Column], ts: str = "ts") -> DataFrame:
    """Mean over all assets per date; ``columns`` maps output names to columns."""
    return df.groupBy(ts).agg(*[F.avg(c).alias(name) for name, c in columns.items()])


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Keys = "symbol", ts: str = "ts",
                 back: bool = False) -> DataFrame:
    """Last value carried forward; ``back`` also fills leading gaps from the next value."""
    filled = {}
    for c in columns:
        value = F.last(c, ignorenulls=True).over(running(keys, ts))
        if back:
            value = F.coalesce(value, F.first(c, ignorenulls=True).over(following(keys, ts)))
        filled[c] = value
    return df.withColumns(filled)


def interpolate(df: DataFrame, column: str, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    """Linear between neighbours by row position, trailing gaps hold the last value, leading take the next."""
    mark = F.when(F.col(column).isNotNull(), F.struct(F.col("_rn").alias("p"), F.col(column).alias("v")))
    ranked = df.withColumn("_rn", F.row_number().over(by(keys, ts)))
    known = ranked.withColumns({
        "_a": F.last(mark, ignorenulls=True).over(running(keys, ts)),
        "_b": F.first(mark, ignorenulls=True).over(following(keys, ts))})
    a, b = F.col("_a"), F.col("_b")
    blend = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_rn") - a["p"], b["p"] - a["p"])
    return known.withColumn(
        column, F.coalesce(F.col(column), blend, a["v"], b["v"])).drop("_rn", "_a", "_b")


def to_daily(df: DataFrame, keys: Keys, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Every calendar day between first and last date of a key, values carried forward."""
    keys = as_list(keys)
    days = (df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
            .select(*keys, F.explode(F.sequence(F.date_trunc("day", "_a"), F.date_trunc("day", "_b"),
                                                F.expr("INTERVAL 1 DAY"))).alias(ts)))
    return forward_fill(days.join(df, [*keys, ts], "left"), columns, keys, ts)


def ohlcv_bars(ticks: DataFrame, width: str, keys: Keys = "symbol", ts: str = "ts", price: str = "price",
               size: str = "size", tie: str | None = None) -> DataFrame:
    """Bars of any width from ticks; combines on the map side, so a hot symbol costs one row per task."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return (ticks.groupBy(*as_list(keys), F.window(ts, width).alias("_w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(size).alias("volume"))
        .withColumn(ts, F.col("_w.start")).drop("_w"))


def coarser_bars(bars: DataFrame, unit: str, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    """Roll bars up to a calendar unit (week, month, quarter, year)."""
    return (bars.groupBy(*as_list(keys), F.date_trunc(unit, ts).alias("_unit")).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("_unit", ts))


def unified_features(prices: DataFrame, macro: DataFrame, sentiment: DataFrame, news: DataFrame,
                     ts: str = "ts") -> DataFrame:
    """Outer join of per-date tables, carried forward, incomplete dates dropped."""
    joined = prices.join(macro, ts, "full").join(sentiment, ts, "full").join(news, ts, "full")
    columns = [c for c in joined.columns if c != ts]
    return forward_fill(joined.withColumn("_k", F.lit(1)), columns, "_k", ts).drop("_k").na.drop()


def sign_flag(condition: Column, when_true: int = 1, when_false: int = -1) -> Column:
    """+1 / -1 flag; an undecided comparison counts as false."""
    return F.when(F.coalesce(condition, F.lit(False)), when_true).otherwise(when_false)


def trend_flags(df: DataFrame, keys: Keys, fear: str, slope: str, vol: str, ts: str = "ts", n: int = 60) -> DataFrame:
    """risk_sentiment, yield_curve_regime and vol_regime."""
    w = trailing(keys, n, ts)
    def above(c):
        return F.col(c) > F.when(F.count(c).over(w) == n, F.avg(c).over(w))
    return df.withColumns({
        "risk_sentiment": sign_flag(above(fear), -1, 1),
        "yield_curve_regime": sign_flag(F.col(slope) > 0),
        "vol_regime": sign_flag(above(vol))})


# Outliers.

def iqr_bounds(df: DataFrame, column: str, keys: Keys, reach: float = 1.5, long_groups: bool = False) -> DataFrame:
    """(keys, low, high).  ``long_groups`` takes the exact two-pass quantiles for groups of any size."""
    keys = as_list(keys)
    if long_groups:
        q = exact_quantiles(df, keys, column, (0.25, 0.75), "_q")
    else:
        q = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    a, b = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return q.select(*keys, (a - reach * (b - a)).alias("low"), (b + reach * (b - a)).alias("high"))


def iqr_outliers(df: DataFrame, column: str, keys: Keys = "symbol", reach: float = 1.5,
                 long_groups: bool = False) -> DataFrame:
    bounds = iqr_bounds(df, column, keys, reach, long_groups)
    return (df.join(bounds, as_list(keys))
            .withColumn("is_outlier", (F.col(column) < F.col("low")) | (F.col(column) > F.col("high")))
            .drop("low", "high"))


def zscore_outliers(df: DataFrame, column: str, keys: Keys = "symbol", threshold: float = 3.0) -> DataFrame:
    """|z| above threshold; moments are aggregated first and joined back, so groups may be skewed."""
    keys = as_list(keys)
    moments = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = F.abs((F.col(column) - F.col("_m")) / F.when(F.col("_s") != 0, F.col("_s")))
    return (df.join(moments, keys)
            .withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False))).drop("_m", "_s"))


def winsorise(df: DataFrame, column: str, keys: Keys = "symbol", low: float = 0.01, high: float = 0.99,
              long_groups: bool = False) -> DataFrame:
    keys = as_list(keys)
    if long_groups:
        q = exact_quantiles(df, keys, column, (low, high), "_q")
    else:
        q = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    clipped = F.when(F.col(column).isNotNull(), F.greatest(lo, F.least(hi, F.col(column))))
    return df.join(q, keys).withColumn(column, clipped).drop("_q")


def drop_outlier_dates(flagged: DataFrame, ts: str = "ts") -> DataFrame:
    """Drop every date on which any series has an outlier."""
    bad = flagged.where("is_outlier").select(ts).distinct()
    return flagged.join(bad, ts, "left_anti").drop("is_outlier")


def interpolate_outliers(flagged: DataFrame, column: str, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    blanked = flagged.withColumn(column, F.when(~F.col("is_outlier"), F.col(column))).drop("is_outlier")
    return interpolate(blanked, column, keys, ts)


# Scaling with separate fit and transform.

def fit_scaler(df: DataFrame, column: str, keys: Keys = "symbol", kind: str = "standard") -> DataFrame:
    """(keys, center, scale): mean and population std, or median and interquartile range."""
    grouped = df.groupBy(*as_list(keys))
    if kind == "standard":
        return grouped.agg(F.avg(column).alias("center"), F.stddev_pop(column).alias("scale"))
    if kind == "robust":
        q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return grouped.agg(q[1].alias("center"), (q[2] - q[0]).alias("scale"))
    raise ValueError(f"unknown scaler {kind!r}; one of standard, robust")


def apply_scaler(df: DataFrame, params: DataFrame, column: str, keys: Keys = "symbol", out: str = "scaled") -> DataFrame:
    unit = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    return (df.join(params, as_list(keys)).withColumn(out, (F.col(column) - F.col("center")) / unit)
            .drop("center", "scale"))


def lag_features(df: DataFrame, column: str, lags: Sequence[int] = (1, 2, 3, 5, 10), keys: Keys = "symbol",
                 ts: str = "ts") -> DataFrame:
    w = by(keys, ts)
    names = {f"{column}_lag_{k}": F.lag(column, k).over(w) for k in lags}
    return df.withColumns(names).na.drop(subset=list(names))


def clean_and_scale(df: DataFrame, column: str, keys: Keys = "symbol", ts: str = "ts",
                    lags: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Fill, winsorise, add indicators and lags, scale: the composite cleaning."""
    from riskframe.operators.series import sma
    steps = df.transform(forward_fill, [column], keys, ts, True).transform(winsorise, column, keys)
    steps = steps.transform(sma, column, (5, 20), keys, ts).transform(lag_features, column, lags, keys, ts).na.drop()
    return apply_scaler(steps, fit_scaler(steps, column, keys), column, keys)


class FeatureRegistry:
    """User-defined feature columns: name to a function of the DataFrame that returns a Column."""

    def __init__(self) -> None:
        self._features: dict[str, Callable[[DataFrame], Column]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], Column]) -> None:
        self._features[name] = fn

    def add_to(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        chosen = names if names is not None else list(self._features)
        missing = [n for n in chosen if n not in self._features]
        if missing:
            raise KeyError(f"unknown features {missing}")
        return df.withColumns({n: self._features[n](df) for n in chosen})


# Calendar.

def rebalance_dates(df: DataFrame, frequency: str, keys: Keys | None = None, ts: str = "ts") -> DataFrame:
    """Dates to rebalance on: every date, Fridays, or the last date of each month, quarter or year."""
    keys = as_list(keys)
    dates = df.select(*keys, ts).distinct()
    if frequency == "daily":
        return dates
    if frequency == "weekly":
        return dates.where(F.dayofweek(ts) == 6)
    units = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}
    if frequency not in units:
        raise ValueError(f"unknown frequency {frequency!r}; one of {FREQUENCIES}")
    return (dates.groupBy(*keys, F.date_trunc(units[frequency], ts).alias("_u"))
            .agg(F.max(ts).alias(ts)).drop("_u"))


#: Ticker fragments of each asset class (fixed values); everything else is equity.
ASSET_CLASSES = {
    "bond": ["AGG", "TLT", "IEF", "SHY", "HYG", "LQD", "TIP", "VTEB"],
    "international": ["VEA", "VWO", "EFA", "EEM"],
    "etf": ["GLD", "SLV", "USO", "XLF", "XLK", "XLE"],
}


def asset_class(symbol: Column | str, classes: Mapping[str, Sequence[str]] | None = None,
                default: str = "equity") -> Column:
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    result = None
    for name, parts in (classes or ASSET_CLASSES).items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | c.contains(part)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(default)


def trailing_period(df: DataFrame, period: str, keys: Keys, ts: str = "ts") -> DataFrame:
    """Rows of the last 1D, 1W, 1M, 3M or of the year to date (YTD), against the last date of the key."""
    keys = as_list(keys)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    spans = {"1D": "INTERVAL 1 DAY", "1W": "INTERVAL 7 DAYS", "1M": "INTERVAL 30 DAYS", "3M": "INTERVAL 90 DAYS"}
    joined = df.join(last, keys)
    if period == "YTD":
        kept = joined.where(F.year(ts) == F.year("_last"))
    elif period in spans:
        kept = joined.where(F.col(ts) >= F.col("_last") - F.expr(spans[period]))
    else:
        raise ValueError(f"unknown period {period!r}")
    return kept.drop("_last")


def last_rows(df: DataFrame, n: int, keys: Keys, ts: str = "ts") -> DataFrame:
    """The last ``n`` rows of each key (a report feature), bounded per task by a group limit."""
    order = Window.partitionBy(*as_list(keys)).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def growth_table(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Growth of 1 and cumulative return."""
    growth = F.product(1 + F.col(ret)).over(running(keys, ts))
    return df.withColumns({"growth": growth, "cumulative_return": growth - 1})


def normalised_prices(df: DataFrame, keys: Keys = "symbol", price: str = "close", ts: str = "ts") -> DataFrame:
    return df.withColumn("normalised", F.try_divide(F.col(price), F.first(price).over(running(keys, ts))))


def demean(column: str, keys: Keys) -> Column:
    return F.col(column) - F.avg(column).over(whole(keys))
