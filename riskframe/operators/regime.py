"""Regime label statistics: transitions, persistence, summaries, ensembles, decay of confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.stats import adjusted_kurtosis, adjusted_skewness
from riskframe.operators.align import transition_distance
from riskframe.operators.series import regime_intervals
from riskframe.plans.windows import Keys, as_list, by, whole


def transition_matrix(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts") -> DataFrame:
    """Counts of label pairs of consecutive rows and their row-normalised probability."""
    keys = as_list(keys)
    pairs = df.select(*keys, F.col(label).alias("from_regime"), F.lead(label).over(by(keys, ts)).alias("to_regime")).where("to_regime IS NOT NULL")
    counts = pairs.groupBy(*keys, "from_regime", "to_regime").agg(F.count("*").alias("count"))
    return counts.withColumn("probability", F.col("count") / F.sum("count").over(whole([*keys, "from_regime"])))


def transition_arrays(matrix: DataFrame, keys: Keys, states: int) -> DataFrame:
    """(keys, matrix ARRAY<ARRAY<DOUBLE>>) from the long matrix, missing cells 0."""
    keys = as_list(keys)
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("from_regime") * states + F.col("to_regime"), "probability")))
    rows = matrix.groupBy(*keys).agg(cells.alias("_m"))
    index = F.sequence(F.lit(0), F.lit(states - 1))
    full = F.transform(index, lambda i: F.transform(index, lambda j: F.coalesce(F.try_element_at(F.col("_m"), i * states + j), F.lit(0.0))))
    return rows.select(*keys, full.alias("matrix"))


def persistence(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts") -> DataFrame:
    """Mean, median, longest and shortest run and number of runs per label."""
    keys = as_list(keys)
    runs = regime_intervals(df, keys, label, ts)
    return runs.groupBy(*keys, label).agg(
        F.avg("duration").alias("mean_run"), F.percentile("duration", F.lit(0.5)).alias("median_run"),
        F.max("duration").alias("max_run"), F.min("duration").alias("min_run"), F.count("*").alias("runs"))


def feature_statistics(df: DataFrame, keys: Keys, features: Sequence[str], label: str = "regime") -> DataFrame:
    """Frequency, mean, std, skewness and kurtosis of each feature per regime, long."""
    keys = as_list(keys)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(*keys, label, F.explode(cells).alias("_f")).select(*keys, label, "_f.*")
    stats = long.groupBy(*keys, label, "feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        adjusted_skewness("value").alias("skewness"), adjusted_kurtosis("value").alias("kurtosis"))
    return stats.withColumn("frequency", F.col("n") / F.sum("n").over(whole([*keys, "feature"])))


#: Names by rank of the mean return (fixed values).
REGIME_NAMES = {3: ("Bear Market", "Sideways Market", "Bull Market"),
                4: ("Bear Market", "Low Volatility", "High Volatility", "Bull Market")}


def name_regimes(df: DataFrame, keys: Keys, ret: str = "ret", label: str = "regime", states: int = 3) -> DataFrame:
    """(keys, regime, mean_return, regime_name): lowest mean first."""
    keys = as_list(keys)
    means = df.groupBy(*keys, label).agg(F.avg(ret).alias("mean_return"))
    rank = F.row_number().over(by(keys or "_k", ["mean_return", label]))
    names = REGIME_NAMES.get(states, tuple(f"Regime {k}" for k in range(states)))
    base = means if keys else means.withColumn("_k", F.lit(1))
    return base.withColumn("regime_name", F.get(F.array(*[F.lit(n) for n in names]), rank - 1)).drop("_k")


def regime_statistics(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts", probs: str | None = None) -> DataFrame:
    """Share, mean run length and, with probabilities, the 2.5 / 97.5 percentiles of the label's probability."""
    keys = as_list(keys)
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(whole(keys))).join(
        persistence(df, keys, label, ts).select(*keys, label, "mean_run"), [*keys, label])
    if probs is None:
        return out
    long = df.select(*keys, F.posexplode(probs).alias(label, "_p"))
    q = long.groupBy(*keys, label).agg(F.percentile("_p", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return out.join(q.select(*keys, label, F.col("_q")[0].alias("prob_low"), F.col("_q")[1].alias("prob_high")), [*keys, label])


def regime_summary(df: DataFrame, names: Sequence[str], label: str = "regime", probs: str = "probs") -> DataFrame:
    """Per date: label, name, confidence and one probability column per name."""
    labels = F.array(*[F.lit(n) for n in names])
    cols = {f"prob_{n.lower().replace(' ', '_')}": F.get(probs, F.lit(i)) for i, n in enumerate(names)}
    return df.withColumns({"regime_name": F.get(labels, F.col(label)), "confidence": F.get(probs, F.col(label)), **cols})


# Ensembles of model outputs: outputs(keys, ts, model, state, prob) or (keys, ts, model, regime).

def softmax_weights(scores: DataFrame, keys: Keys | None = None, score: str = "score") -> DataFrame:
    w = Window.partitionBy(*(as_list(keys) or [F.lit(1)]))
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def ensemble_probabilities(outputs: DataFrame, weights: Mapping[str, float] | DataFrame, keys: Keys, ts: str = "ts") -> DataFrame:
    """Weighted mean of state probabilities over models and the likeliest state (lowest on ties)."""
    keys = as_list(keys)
    if isinstance(weights, DataFrame):
        joined = outputs.join(weights.select("model", F.col("weight").alias("_w")), "model")
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        joined = outputs.withColumn("_w", F.element_at(table, F.col("model")))
    states = joined.groupBy(*keys, ts, "state").agg((F.sum(F.col("_w") * F.col("prob"))).alias("_s"), F.sum("_w").alias("_w"))
    scaled = states.withColumn("prob", F.try_divide("_s", "_w"))
    best = F.max_by("state", F.struct("prob", -F.col("state")))
    return scaled.groupBy(*keys, ts).agg(
        best.alias("regime"), F.max("prob").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("state", "prob"))), lambda x: x["prob"]).alias("probs"))


def consensus(votes: DataFrame, keys: Keys, ts: str = "ts") -> DataFrame:
    """Majority label (lowest on ties), its share of the votes and the disagreement rate."""
    keys = as_list(keys)
    counts = votes.groupBy(*keys, ts, "regime").agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys, ts).agg(
        F.max_by("regime", F.struct("_n", -F.col("regime"))).alias("consensus"),
        (F.max("_n") / F.sum("_n")).alias("strength"), ((F.count("*") - 1) / F.sum("_n")).alias("disagreement"))


def drift_trigger(history: DataFrame, keys: Keys, ts: str = "ts", n: int = 5, drop: float = 0.1) -> DataFrame:
    """Mean of the last n accuracies against the n before; retrain when it fell by more than ``drop``."""
    recent, older = by(keys, ts).rowsBetween(-(n - 1), 0), by(keys, ts).rowsBetween(-(2 * n - 1), -n)
    ready = F.count("accuracy").over(older) == n
    fall = F.avg("accuracy").over(older) - F.avg("accuracy").over(recent)
    return history.withColumn("accuracy_drop", F.when(ready, fall)).withColumn(
        "retrain", F.coalesce(F.col("accuracy_drop") > drop, F.lit(False)))


def uncertainty_flag(df: DataFrame, keys: Keys, probs: str = "probs", ts: str = "ts", n: int = 10, sure: float = 0.8,
                     share: float = 0.7) -> DataFrame:
    """More than ``share`` of the last n rows without a probability of ``sure``."""
    w = by(keys, ts).rowsBetween(-(n - 1), 0)
    unsure = (F.array_max(probs) < sure).cast("int")
    return df.withColumn("uncertain", (F.count("*").over(w) == n) & (F.avg(unsure).over(w) > share))


def label_confidence(df: DataFrame, keys: Keys, label: str = "regime", ts: str = "ts") -> DataFrame:
    """Probability of the true label and confidence, both reduced near label changes."""
    far = transition_distance(df, keys, label, ts)
    d = F.col("distance")
    p = F.when(d <= 5, 0.9 * (0.5 + 0.1 * d)).otherwise(0.9)
    c = F.when(d <= 10, 0.3 + 0.07 * d).when(d <= 20, 0.8 + 0.01 * (d - 10)).otherwise(1.0)
    return far.withColumns({"true_probability": p, "confidence": F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))})


def spread_probability(df: DataFrame, matrix: DataFrame, keys: Keys, states: int, label: str = "regime") -> DataFrame:
    """Give the rest of the probability to the other states in proportion to the transition row."""
    arrays = transition_arrays(matrix, keys, states)
    row = F.get("matrix", F.col(label))
    off = F.transform(row, lambda x, i: F.when(i == F.col(label), 0.0).otherwise(x))
    total = F.aggregate(off, F.lit(0.0), lambda a, x: a + x)
    p = F.col("true_probability")
    probs = F.transform(off, lambda x, i: F.when(i == F.col(label), p).when(total > 0, (1 - p) * x / total).otherwise((1 - p) / (states - 1)))
    return df.join(arrays, as_list(keys)).withColumn("probs", probs).drop("matrix")


def characteristics(df: DataFrame, keys: Keys, features: Sequence[str], ret: str = "ret", label: str = "regime", ts: str = "ts") -> dict[str, DataFrame]:
    """Periods, statistics, transitions, persistence and performance tables of a labelled series."""
    from riskframe.operators.attribution import regime_statistics as conditional
    return {"periods": regime_intervals(df, keys, label, ts, ret), "statistics": feature_statistics(df, keys, features, label),
            "transitions": transition_matrix(df, keys, label, ts), "persistence": persistence(df, keys, label, ts),
            "performance": conditional(df, keys, label, ret, ts=ts)}


def stacked_states(probs: Column | str, model: str) -> tuple[Column, Column]:
    """(model name, exploded states) for turning an array of probabilities into ensemble rows."""
    return F.lit(model).alias("model"), F.posexplode(probs).alias("state", "prob")
