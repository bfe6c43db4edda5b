"""Brinson, regime and multi-level performance attribution on long tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import measures as m
from riskframe.functions.stats import ROOT_YEAR, adjusted_kurtosis, adjusted_skewness, safe_ratio
from riskframe.operators.risk import drawdown_path, tail_aggs, with_cuts
from riskframe.plans.windows import Keys, as_list, constant_key, running, whole


def brinson(panel: DataFrame, group: Keys = "symbol", pw: str = "pw", bw: str = "bw", rp: str = "ret", rb: str = "bret",
            totals: bool = True) -> DataFrame:
    """Allocation (wp - wb) rb, selection wb (rp - rb), interaction, added up over time per group.

    ``totals`` adds the grand total as a row with null group through a rollup of the same pass.
    """
    aw, ar = F.col(pw) - F.col(bw), F.col(rp) - F.col(rb)
    group = as_list(group)
    grouped = panel.rollup(*group) if totals else panel.groupBy(*group)
    out = grouped.agg(F.sum(aw * F.col(rb)).alias("allocation_effect"), F.sum(F.col(bw) * ar).alias("selection_effect"),
                      F.sum(aw * ar).alias("interaction_effect"))
    return out.withColumn("total_contribution", F.col("allocation_effect") + F.col("selection_effect") + F.col("interaction_effect"))


def to_groups(panel: DataFrame, group: str = "sector", ts: str = "ts", pw: str = "pw", bw: str = "bw", rp: str = "ret",
              rb: str = "bret") -> DataFrame:
    """Aggregate an asset panel to sectors: weight sums and weighted returns."""
    return panel.groupBy(ts, group).agg(
        F.sum(pw).alias(pw), F.sum(bw).alias(bw),
        safe_ratio(F.sum(F.col(pw) * F.col(rp)), F.sum(pw)).alias(rp),
        safe_ratio(F.sum(F.col(bw) * F.col(rb)), F.sum(bw)).alias(rb))


def sector_brinson(panel: DataFrame, group: str = "sector", totals: bool = True) -> DataFrame:
    return brinson(to_groups(panel, group), group, totals=totals)


def daily_brinson(panel: DataFrame, group: str = "sector", ts: str = "ts", pw: str = "pw", bw: str = "bw", ret: str = "bret",
                  ) -> DataFrame:
    """Per date against the total benchmark return: allocation (wp - wb)(rs - Rb), selection wb (rs - mean rs)."""
    date = whole(ts)
    r, a = F.col(ret), F.col(pw) - F.col(bw)
    off = panel.withColumns({"_rb": F.sum(F.col(bw) * r).over(date), "_mean": F.avg(r).over(date)})
    daily = off.groupBy(ts).agg(
        F.sum(a * (r - F.col("_rb"))).alias("allocation_effect"),
        F.sum(F.col(bw) * (r - F.col("_mean"))).alias("selection_effect"),
        F.sum(a * (r - F.col("_mean"))).alias("interaction_effect"))
    return daily.withColumn("total_effect", F.col("allocation_effect") + F.col("selection_effect") + F.col("interaction_effect"))


def cumulative_effects(daily: DataFrame, ts: str = "ts") -> DataFrame:
    """Running sums of daily effects; one row per date, so one calendar-sized window."""
    w = running("series_id", ts)
    effects = [c for c in daily.columns if c.endswith("_effect")]
    return constant_key(daily).withColumns({c: F.sum(c).over(w) for c in effects}).drop("series_id")


def regime_contributions(df: DataFrame, keys: Keys, label: str = "regime", ret: str = "ret", bench: str = "bench") -> DataFrame:
    """Contribution, frequency and averages of the active return per regime, with the timing split."""
    keys = as_list(keys)
    active = F.col(ret) - F.col(bench)
    parts = df.groupBy(*keys, label).agg(
        F.sum(active).alias("contribution"), F.avg(active).alias("avg_active_return"), F.count("*").alias("periods"),
        F.avg(ret).alias("portfolio_return"), F.avg(bench).alias("benchmark_return"), F.stddev_samp(active).alias("volatility"))
    share = parts.withColumn("frequency", F.col("periods") / F.sum("periods").over(whole(keys)))
    return share.withColumn("allocation_effect", F.col("frequency") * F.col("benchmark_return") * F.col("periods")).withColumn(
        "selection_effect", F.col("contribution") - F.col("allocation_effect"))


def regime_performance(df: DataFrame, keys: Keys, label: str = "regime", ret: str = "ret", bench: str = "bench",
                       ts: str = "ts") -> DataFrame:
    """Performance and share of the total return per regime."""
    keys = as_list(keys)
    excess = F.col(ret) - F.col(bench)
    path = drawdown_path(df, [*keys, label], ret, ts)
    parts = path.groupBy(*keys, label).agg(
        m.total_return(ret).alias("total_return"), m.annualised_return(ret).alias("annualized_return"),
        m.annualised_volatility(ret).alias("volatility"), m.sharpe(ret, style="mean").alias("sharpe_ratio"),
        F.min("dd_rel").alias("max_drawdown"), F.count("*").alias("periods"), F.avg(excess).alias("avg_excess_return"),
        (F.stddev_samp(excess) * ROOT_YEAR).alias("excess_volatility"), m.win_rate(ret).alias("win_rate"),
        F.sum(ret).alias("contribution"))
    w = whole(keys)
    return parts.withColumns({
        "frequency": F.col("periods") / F.sum("periods").over(w),
        "contribution_percentage": safe_ratio(F.col("contribution"), F.sum("contribution").over(w))})


def regime_statistics(df: DataFrame, keys: Keys, label: str = "regime", ret: str = "ret", bench: str | None = None,
                      ts: str = "ts", enough: int = 10) -> DataFrame:
    """Regime-conditional statistics, optionally against a benchmark, for regimes with enough rows."""
    keys = [*as_list(keys), label]
    path = with_cuts(drawdown_path(df, keys, ret, ts), keys, ret, (0.05,))
    sd = F.stddev_samp(ret)
    aggs = [F.count("*").alias("periods"), F.avg(ret).alias("mean_return"), sd.alias("std_return"),
            m.total_return(ret).alias("total_return"), m.annualised_mean_return(ret).alias("annualized_return"),
            *tail_aggs(ret, (0.05,)), F.min("dd_add").alias("max_drawdown"), m.win_rate(ret).alias("win_rate"),
            adjusted_skewness(ret).alias("skewness"), adjusted_kurtosis(ret).alias("kurtosis"),
            m.sharpe(ret, style="mean").alias("sharpe_ratio"), m.sortino(ret, 0.02).alias("sortino_ratio")]
    if bench is not None:
        alpha, te = F.avg(ret) - F.avg(bench), F.stddev_samp(F.col(ret) - F.col(bench))
        aggs += [alpha.alias("alpha"), m.beta(ret, bench).alias("beta"), F.corr(ret, bench).alias("correlation"),
                 te.alias("tracking_error"), safe_ratio(alpha, te).alias("information_ratio")]
    stats = path.groupBy(*keys).agg(*aggs)
    stats = stats.withColumn("frequency", F.col("periods") / F.sum("periods").over(whole(keys[:-1])))
    return stats.where(F.col("periods") >= enough).withColumnsRenamed({"var_5": "var_95", "cvar_5": "cvar_95"})


COMPARED = ("mean_return", "std_return", "sharpe_ratio", "max_drawdown", "win_rate")


def compare_regimes(stats: DataFrame, keys: Keys, label: str = "regime") -> DataFrame:
    """Best and worst regime, range and coefficient of variation per metric; smallest loss is best for drawdown."""
    keys = as_list(keys)
    long = stats.unpivot([*keys, label], list(COMPARED), "metric", "value")
    score = F.when(F.col("metric") == "max_drawdown", -F.abs("value")).otherwise(F.col("value"))
    order = F.struct(score.alias("s"), (-F.col(label)).alias("t"))
    reverse = F.struct(score.alias("s"), F.col(label).alias("t"))
    return long.groupBy(*keys, "metric").agg(
        F.max_by(label, order).alias("best_regime"), F.min_by(label, reverse).alias("worst_regime"),
        (F.max("value") - F.min("value")).alias("range"),
        safe_ratio(F.stddev_pop("value"), F.avg("value")).alias("coefficient_of_variation"))


def regime_diversity(stats: DataFrame, keys: Keys, label: str = "regime") -> DataFrame:
    f = F.col("frequency")
    return stats.groupBy(*as_list(keys)).agg(
        F.max_by(label, F.struct(f, -F.col(label))).alias("most_frequent"),
        F.min_by(label, F.struct(f, F.col(label))).alias("least_frequent"),
        (-F.sum(F.when(f > 0, f * F.log(f)))).alias("entropy"))


def multi_level(panel: DataFrame, levels: Mapping[str, str], factor_parts: DataFrame | None = None) -> DataFrame:
    """Brinson per level (sector, country, ...) and factor contributions, one table with a ``level`` column."""
    out = None
    for level, column in levels.items():
        part = sector_brinson(panel, column, totals=False).select(
            F.lit(level).alias("level"), F.col(column).alias("bucket"), "allocation_effect", "selection_effect",
            "interaction_effect", "total_contribution")
        out = part if out is None else out.unionByName(part)
    if factor_parts is not None:
        extra = factor_parts.groupBy(F.lit("factor").alias("level"), F.col("factor").alias("bucket")).agg(
            F.sum("contribution").alias("total_contribution"))
        out = out.unionByName(extra, allowMissingColumns=True)
    return out


def full_attribution(panel: DataFrame, returns: DataFrame, keys: Keys) -> dict[str, DataFrame]:
    """All attribution tables; lazy, so only what is read is computed."""
    from riskframe.operators.risk import excess_summary
    daily = daily_brinson(to_groups(panel))
    return {"brinson": sector_brinson(panel), "daily": daily, "cumulative": cumulative_effects(daily),
            "regimes": regime_performance(returns, keys), "summary": excess_summary(returns, keys)}


def waterfall(parts: DataFrame, keys: Keys | None = None, order: str = "position", value: str = "value") -> DataFrame:
    """Running total of ordered contributions with the start of each bar."""
    keyed = parts if keys else constant_key(parts, "_k")
    w = running(keys or "_k", order)
    out = keyed.withColumn("running_total", F.sum(value).over(w))
    return out.withColumn("bar_start", F.col("running_total") - F.col(value)).drop("_k")


def strategy_table(df: DataFrame, keys: Keys = "strategy", ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Performance and risk comparison of strategies in the analyzer convention."""
    keys = as_list(keys)
    path = with_cuts(drawdown_path(df, keys, ret, ts), keys, ret, (0.05,))
    base = path.groupBy(*keys).agg(*m.styled_set(ret, "analyzer", dd="dd_rel"), adjusted_skewness(ret).alias("skewness"),
                                   *tail_aggs(ret, (0.05,)))
    return base.withColumnsRenamed({"var_5": "var_95", "cvar_5": "cvar_95"})

