"""Validation of regime models, forecasts and backtests as tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.stats import chi2_tail_even, safe_ratio
from riskframe.plans.windows import Keys, as_list, by, whole


def _changes(df: DataFrame, keys: Sequence[str], label: str, ts: str) -> DataFrame:
    return df.withColumn("_ch", F.coalesce((F.col(label) != F.lag(label).over(by(keys, ts))).cast("int"), F.lit(0)))


def label_persistence(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts") -> DataFrame:
    """Average persistence, changes, switching frequency and consistency of a label series."""
    keys = as_list(keys)
    n, c = F.count("*"), F.sum("_ch")
    return _changes(df, keys, label, ts).groupBy(*keys).agg(
        n.alias("periods"), c.alias("regime_changes"), (n / (c + 1)).alias("average_persistence"),
        (c / n).alias("change_frequency"), F.countDistinct(label).alias("unique_regimes"),
        F.when(n > 1, 1 - c / (n - 1)).otherwise(0.0).alias("consistency_score"))


def label_distribution(df: DataFrame, keys: Keys, label: str = "regime") -> DataFrame:
    counts = df.groupBy(*as_list(keys), label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole(keys)))


def ljung_box(df: DataFrame, keys: Keys, value: str = "ret", ts: str = "ts", lags: int = 10) -> DataFrame:
    """Ljung-Box statistic and p-value over an even number of lags, in one window pass."""
    if lags % 2:
        raise ValueError("lags must be even")
    keys = as_list(keys)
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    centred = df.join(mean, keys).withColumn("_x", F.col(value) - F.col("_m"))
    w = by(keys, ts)
    lagged = centred.withColumns({f"_x{k}": F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    n, s0 = F.count("_x"), F.sum(F.col("_x") * F.col("_x"))
    terms = sum(F.pow(F.try_divide(F.sum(F.col("_x") * F.col(f"_x{k}")), s0), 2) / F.nullif(n - k, F.lit(0)) for k in range(1, lags + 1))
    stat = lagged.groupBy(*keys).agg((n * (n + 2) * terms).alias("statistic"))
    return stat.withColumn("p_value", chi2_tail_even(F.col("statistic"), lags)).withColumn(
        "significant_autocorr", F.col("p_value") < 0.05)


def jarque_bera(df: DataFrame, keys: Keys, value: str = "ret", enough: int = 20) -> DataFrame:
    n, s, k = F.count(value), F.skewness(value), F.kurtosis(value)
    stats = df.groupBy(*as_list(keys)).agg(n.alias("n"), (n / 6 * (s * s + k * k / 4)).alias("statistic")).where(F.col("n") > enough)
    return stats.withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn("is_normal", F.col("p_value") > 0.05)


def kolmogorov_smirnov(df: DataFrame, keys: Keys, value: str = "ret") -> DataFrame:
    """Distance of each series to a normal with its own mean and sample std, with the asymptotic p-value.

    Per key, in Spark: the sorted position of a value against the distribution function.
    """
    from riskframe.functions.stats import normal_cdf
    keys = as_list(keys)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    ranked = df.join(stats, keys).withColumns({
        "_c": normal_cdf(F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))), "_rk": F.row_number().over(by(keys, value))})
    d = F.max(F.greatest(F.col("_rk") / F.col("n") - F.col("_c"), F.col("_c") - (F.col("_rk") - 1) / F.col("n")))
    out = ranked.groupBy(*keys).agg(F.max("n").alias("n"), d.alias("statistic"))
    x = F.sqrt("n") * F.col("statistic")
    tail = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * tail)))


# Folds.

def time_series_folds(df: DataFrame, keys: Keys, n_splits: int = 5, ts: str = "ts") -> DataFrame:
    """Expanding folds: the last n_splits blocks of n // (n_splits + 1) rows are tests, training is all before.

    Rows are listed once per fold that uses them, with ``fold`` and ``part`` (train or test).
    """
    keys = as_list(keys)
    ranked = df.withColumns({"_rn": F.row_number().over(by(keys, ts)) - 1, "_n": F.count("*").over(whole(keys))})
    size = F.floor(F.col("_n") / (n_splits + 1))
    spread = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (n_splits - F.col("fold")) * size
    part = F.when(F.col("_rn") < start, "train").when(F.col("_rn") < start + size, "test")
    return spread.withColumn("part", part).where("part IS NOT NULL").drop("_rn", "_n")


def cross_validate(df: DataFrame, keys: Keys, scorer: Callable[[DataFrame, list[str]], DataFrame], n_splits: int = 5,
                   ts: str = "ts") -> DataFrame:
    """Score every fold with ``scorer(folds, keys + [fold]) -> (keys, fold, score)``; all folds in one job."""
    keys = as_list(keys)
    folds = time_series_folds(df, keys, n_splits, ts)
    return scorer(folds, [*keys, "fold"])


def consistency_scorer(label: str = "regime", ts: str = "ts") -> Callable[[DataFrame, list[str]], DataFrame]:
    def score(folds: DataFrame, keys: list[str]) -> DataFrame:
        tests = folds.where("part = 'test'")
        return label_persistence(tests, keys, label, ts).select(*keys, F.col("consistency_score").alias("score"))
    return score


def fold_summary(scores: DataFrame, keys: Keys) -> DataFrame:
    return scores.groupBy(*as_list(keys)).agg(F.avg("score").alias("mean_cv_score"), F.stddev_pop("score").alias("std_cv_score"),
                                              F.count("score").alias("n_successful_folds"))


# Label accuracy.

def confusion(df: DataFrame, keys: Keys | None = None, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*as_list(keys), truth, predicted).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, keys: Keys | None = None, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    keys = as_list(keys)
    cells = F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
                    F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    long = matrix.withColumn("_hit", hit).select(*keys, "_hit", F.explode(cells).alias("_c")).select(*keys, "_hit", "_c.*")
    sums = long.groupBy(*keys, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("_p"),
                                            F.sum(F.when(F.col("t") > 0, F.col("_hit"))).alias("_h"))
    h = F.coalesce("_h", F.lit(0))
    scored = sums.withColumns({"precision": safe_ratio(h, F.col("_p")), "recall": safe_ratio(h, F.col("support"))})
    f1 = safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1).drop("_p", "_h")


def accuracy(matrix: DataFrame, keys: Keys | None = None, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    return matrix.groupBy(*as_list(keys)).agg(F.try_divide(hit, F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


# Stability, out of sample.

def equal_periods(df: DataFrame, keys: Keys, periods: int = 4, ts: str = "ts") -> DataFrame:
    """Number the rows' period: equal lengths, the last one takes the rest."""
    ranked = df.withColumns({"_rn": F.row_number().over(by(keys, ts)) - 1, "_n": F.count("*").over(whole(keys))})
    length = F.greatest(F.lit(1), F.floor(F.col("_n") / periods))
    return ranked.withColumn("period", F.least(F.lit(periods - 1), F.floor(F.col("_rn") / length))).drop("_rn", "_n")


def stability(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts", periods: int = 4) -> DataFrame:
    keys = as_list(keys)
    scores = label_persistence(equal_periods(df, keys, periods, ts), [*keys, "period"], label, ts)
    s = "consistency_score"
    return scores.groupBy(*keys).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))


def positional_split(df: DataFrame, keys: Keys, train: float = 0.7, ts: str = "ts") -> DataFrame:
    """Mark the first share of each series as train, the rest as test."""
    ranked = df.withColumns({"_rn": F.row_number().over(by(keys, ts)) - 1, "_n": F.count("*").over(whole(keys))})
    return ranked.withColumn("part", F.when(F.col("_rn") < F.floor(F.col("_n") * train), "train").otherwise("test")).drop("_rn", "_n")


def prediction_confidence(df: DataFrame, keys: Keys, probs: str = "probs") -> DataFrame:
    best = F.array_max(probs)
    return df.groupBy(*as_list(keys)).agg(F.avg(best).alias("mean"), F.stddev_pop(best).alias("std"),
                                          F.min(best).alias("min"), F.max(best).alias("max"))


# Forecasts.

def forecast_accuracy(forecasts: DataFrame, realised: DataFrame, on: Keys = "ts", model: str = "model", value: str = "value",
                      actual: str = "actual") -> DataFrame:
    """MSE, MAE and MAPE per model."""
    joined = forecasts.join(realised, as_list(on)).where(F.col(value).isNotNull())
    e = F.col(value) - F.col(actual)
    return joined.groupBy(model).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                                     (F.avg(F.abs(F.try_divide(e, F.col(actual)))) * 100).alias("mape"), F.count("*").alias("n_observations"))


def ensemble_forecast(forecasts: DataFrame, weights: Mapping[str, float] | None = None, on: Keys = "ts", model: str = "model",
                      value: str = "value", models: Sequence[str] | None = None) -> DataFrame:
    """Weighted sum of model forecasts; equal weights over ``models`` when none are given."""
    if weights is None:
        if not models:
            raise ValueError("give weights or the list of models")
        weights = {m: 1 / len(models) for m in models}
    w = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col(model))
    return forecasts.groupBy(*as_list(on)).agg(F.sum(F.coalesce(w, F.lit(0.0)) * F.coalesce(value, F.lit(0.0))).alias("ensemble"))


#: Rule-based findings: metric, list of (lower bound, finding), finding below all (fixed values).
FINDINGS: dict[str, tuple[list[tuple[float, str]], str]] = {
    "mean_cv_score": ([(0.8, "Model shows good cross-validation performance"),
                       (0.6, "Model shows moderate cross-validation performance")],
                      "Model shows poor cross-validation performance - consider model refinement"),
    "overall_accuracy": ([(0.7, "Regime detection accuracy is acceptable")],
                         "Low regime detection accuracy - consider feature engineering or model selection"),
    "sharpe_ratio": ([(1.0, "Portfolio shows strong risk-adjusted returns"), (0.5, "Portfolio shows moderate risk-adjusted returns")],
                     "Portfolio shows poor risk-adjusted returns"),
}


def finding(metric: Column, value: Column) -> Column:
    out: Column = F.when((metric == "stability_std") & (value < 0.1), "Model shows good stability across time periods").when(
        metric == "stability_std", "Model shows instability across time periods - consider adaptive approaches")
    for name, (steps, otherwise) in FINDINGS.items():
        for bound, text in steps:
            out = out.when((metric == name) & (value > bound), text)
        out = out.when(metric == name, otherwise)
    return out


def findings(metrics: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return metrics.withColumn("finding", finding(F.col(metric), F.col(value)))


def validate_labels(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts", features: Sequence[str] = (),
                    train: float = 0.7) -> dict[str, DataFrame]:
    """Validation bundle of a label series: split, profile, persistence, folds and stability."""
    from riskframe.operators.quality import feature_profile
    keys = as_list(keys)
    split = positional_split(df, keys, train, ts)
    out = {"persistence": label_persistence(split, [*keys, "part"], label, ts),
           "folds": cross_validate(df, keys, consistency_scorer(label, ts), ts=ts), "stability": stability(df, keys, label, ts),
           "distribution": label_distribution(split.where("part = 'test'"), keys, label)}
    if features:
        out["profile"] = feature_profile(df, features)
    return out


