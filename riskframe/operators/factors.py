"""Factor construction, regressions and factor attribution.

Regressions run on normal equations: one map-side combined aggregation per asset, then a k by k solve in
vectorised batches of assets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.stats import TRADING_DAYS
from riskframe.plans.windows import Keys, as_list, by, full, trailing, whole

SIX_BUCKETS = ("SL", "SM", "SH", "BL", "BM", "BH")


# Factor construction from a panel of (ts, symbol, ret, cap, characteristic).

def market_factor(panel: DataFrame, ret: str = "ret", cap: str = "cap", ts: str = "ts", rf: str | None = None) -> DataFrame:
    value = F.try_divide(F.sum(F.col(cap) * F.coalesce(F.col(ret), F.lit(0.0))), F.sum(cap))
    if rf is not None:
        value = value - F.coalesce(F.max(rf), F.lit(0.0)) / TRADING_DAYS
    return panel.groupBy(ts).agg(value.alias("MKT"))


def _placed(panel: DataFrame, characteristics: Sequence[str], ret: str, cap: str, ts: str) -> DataFrame:
    """Bucket of each asset per characteristic: size split at the median, level at the 30/70 quantiles.

    The breakpoints are windows over the date, whose partitions hold one row per asset; the aggregation per
    date that follows keeps the same partitioning, so a factor table costs one shuffle.
    """
    date = whole(ts)
    rows = panel
    for i, name in enumerate(characteristics):
        c = F.when(F.col(cap).isNotNull() & F.col(ret).isNotNull(), F.col(name))
        size = F.when(c.isNotNull(), F.col(cap))
        rows = rows.withColumns({f"_n{i}": F.count(c).over(date), f"_m{i}": F.percentile(size, F.lit(0.5)).over(date),
                                 f"_q{i}": F.percentile(c, F.array(F.lit(0.3), F.lit(0.7))).over(date)})
        side = F.when(F.col(cap) <= F.col(f"_m{i}"), "S").otherwise("B")
        level = F.when(c <= F.col(f"_q{i}")[0], "L").when(c > F.col(f"_q{i}")[1], "H").otherwise("M")
        rows = rows.withColumn(f"_b{i}", F.when(c.isNotNull(), F.concat(side, level)))
    return rows


def _cell(bucket: str, i: int, ret: str, cap: str) -> Column:
    """Cap-weighted return of a bucket; an empty one contributes 0."""
    inside = F.col(f"_b{i}") == bucket
    return F.coalesce(F.try_divide(F.sum(F.when(inside, F.col(cap) * F.col(ret))), F.sum(F.when(inside, F.col(cap)))), F.lit(0.0))


def _size_value(i: int, ret: str, cap: str, enough: int) -> dict[str, Column]:
    c = {name: _cell(name, i, ret, cap) for name in SIX_BUCKETS}
    many = F.max(f"_n{i}") > enough
    return {"SMB": F.when(many, (c["SL"] + c["SM"] + c["SH"]) / 3 - (c["BL"] + c["BM"] + c["BH"]) / 3),
            "HML": F.when(many, (c["SH"] + c["BH"]) / 2 - (c["SL"] + c["BL"]) / 2)}


def _long_short(i: int, long: str, ret: str, cap: str, enough: int) -> Column:
    c = {name: _cell(name, i, ret, cap) for name in ("SL", "SH", "BL", "BH")}
    spread = (c["SH"] + c["BH"]) / 2 - (c["SL"] + c["BL"]) / 2
    return F.when(F.max(f"_n{i}") > enough, spread if long == "high" else -spread)


def size_value_factors(panel: DataFrame, value: str = "bm", ret: str = "ret", cap: str = "cap", ts: str = "ts",
                       enough: int = 6) -> DataFrame:
    """SMB and HML; dates with too few assets are null."""
    cells = _size_value(0, ret, cap, enough)
    return _placed(panel, [value], ret, cap, ts).groupBy(ts).agg(*[c.alias(name) for name, c in cells.items()])


def sort_factor(panel: DataFrame, characteristic: str, name: str, long: str = "high", ret: str = "ret",
                cap: str = "cap", ts: str = "ts", enough: int = 4) -> DataFrame:
    """Two by two sort: high minus low (profitability, momentum) or low minus high (investment)."""
    if long not in ("high", "low"):
        raise ValueError("long is high or low")
    return _placed(panel, [characteristic], ret, cap, ts).groupBy(ts).agg(_long_short(0, long, ret, cap, enough).alias(name))


def factor_table(panel: DataFrame, profitability: str | None = None, investment: str | None = None,
                 momentum: str | None = None, ret: str = "ret", cap: str = "cap", ts: str = "ts", value: str = "bm") -> DataFrame:
    """Market, size, value and the optional factors in one aggregation per date, complete dates only."""
    extra = [(c, n, s) for c, n, s in ((profitability, "RMW", "high"), (investment, "CMA", "low"), (momentum, "MOM", "high")) if c]
    rows = _placed(panel, [value, *[c for c, _, _ in extra]], ret, cap, ts)
    market = F.try_divide(F.sum(F.col(cap) * F.coalesce(F.col(ret), F.lit(0.0))), F.sum(cap))
    cells = {"MKT": market, **_size_value(0, ret, cap, 6),
             **{n: _long_short(i + 1, s, ret, cap, 4) for i, (_, n, s) in enumerate(extra)}}
    return rows.groupBy(ts).agg(*[c.alias(name) for name, c in cells.items()]).na.drop()


def macro_factors(wide: DataFrame, differences: Mapping[str, str], ts: str = "ts") -> DataFrame:
    """Macro table plus first differences of the named columns, complete dates only.

    One row per date: the constant key keeps a calendar-sized table in one window partition.
    """
    w = by("_k", ts)
    keyed = wide.withColumn("_k", F.lit(1))
    return keyed.withColumns({out: F.col(c) - F.lag(c).over(w) for out, c in differences.items()}).drop("_k").na.drop()


def custom_factor(returns: DataFrame, kind: str, ret: str = "ret", ts: str = "ts", keys: Keys = "symbol",
                  n: int | None = None) -> DataFrame:
    """Cross-section mean of a rolling value per asset: momentum (sum), size and quality (minus std), low_volatility."""
    lengths = {"momentum": 252, "size": 252, "quality": 252, "low_volatility": 60}
    if kind not in lengths:
        raise ValueError(f"unknown factor {kind!r}; one of {sorted(lengths)}")
    n = n or lengths[kind]
    w = trailing(keys, n, ts)
    value = full(F.sum(ret), ret, w, n) if kind == "momentum" else -full(F.stddev_samp(ret), ret, w, n)
    return returns.withColumn("_v", value).groupBy(ts).agg(F.avg("_v").alias(kind))


# Regressions.

def _moments(x: Sequence[str], y: str) -> list[Column]:
    """Count, means and centred cross products; the covariance aggregates update them without cancellation."""
    names, n = [*x, y], F.count(F.lit(1)).cast("double")
    cols = [n.alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names]]
    for i, a in enumerate(names):
        cols += [(F.covar_pop(a, b) * n).alias(f"s_{a}_{b}") for b in names[i:]]
    return cols


def _inverse(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-inverses after scaling to a unit diagonal, so that columns of very different size are judged alike,
    and whether each matrix has full rank."""
    size = np.sqrt(np.einsum("rii->ri", matrices))
    size = np.where(size > 0, size, 1.0)
    both = size[:, :, None] * size[:, None, :]
    scaled = matrices / both
    values = np.linalg.eigvalsh(scaled) if scaled.shape[1] else np.ones((len(scaled), 1))
    return np.linalg.pinv(scaled, rcond=1e-13, hermitian=True) / both, values[:, 0] > 1e-13 * values[:, -1]


def _solve(pdf: pd.DataFrame, x: Sequence[str], y: str, ridge: float, plain_t: bool) -> pd.DataFrame:
    """Coefficients and statistics of a batch of assets from their moment rows."""
    k, rows = len(x), len(pdf)
    n = pdf["n"].to_numpy()
    mean = np.column_stack([pdf[f"m_{c}"] for c in x]) if k else np.empty((rows, 0))
    my = pdf[f"m_{y}"].to_numpy()
    centred = np.empty((rows, k, k))
    for i, a in enumerate(x):
        for j in range(i, k):
            centred[:, i, j] = centred[:, j, i] = pdf[f"s_{a}_{x[j]}"]
    rhs = np.column_stack([pdf[f"s_{a}_{y}"] for a in x])
    syy = pdf[f"s_{y}_{y}"].to_numpy()
    solver, full_rank = _inverse(centred + ridge * np.eye(k))
    beta = np.einsum("rij,rj->ri", solver, rhs)
    alpha = my - (mean * beta).sum(1)
    sse = np.maximum(syy - 2 * (beta * rhs).sum(1) + np.einsum("ri,rij,rj->r", beta, centred, beta), 0)
    mse = sse / (n - k - 1)
    inverse = _inverse(centred + n[:, None, None] * mean[:, :, None] * mean[:, None, :])[0] if plain_t else solver
    with np.errstate(divide="ignore", invalid="ignore"):
        t_beta = beta / np.sqrt(mse[:, None] * np.einsum("rii->ri", inverse))
        se_alpha = np.sqrt(mse * (1 / n + np.einsum("ri,rij,rj->r", mean, solver, mean)))
        out = {"n": n.astype("int64"), "full_rank": full_rank, "alpha": alpha, "r_squared": np.where(syy > 0, 1 - sse / syy, np.nan),
               "residual_std": np.sqrt(sse / n), "t_alpha": alpha / se_alpha}
    for i, name in enumerate(x):
        out |= {f"beta_{name}": beta[:, i], f"t_{name}": t_beta[:, i]}
    return pd.DataFrame(out, index=pdf.index)


def fit_ols(df: DataFrame, keys: Keys, y: str, x: Sequence[str], enough: int | None = None, ridge: float = 0.0,
            plain_t: bool = False) -> DataFrame:
    """One regression with intercept per key: n, alpha, r_squared, residual_std, t_alpha, beta_*, t_*.

    Keys need more than ``enough`` rows (default factors + 10).  ``plain_t`` takes the t-statistics from the
    inverse of X'X without the intercept column.  Moments are centred as they are summed, and columns are scaled to
    unit size before they are solved.  ``full_rank`` is false where factors depend on each other: the
    coefficients are then those of least norm.
    """
    keys, x = as_list(keys), list(x)
    limit = len(x) + 10 if enough is None else enough
    rows = df.na.drop(subset=[y, *x])
    moments = rows.groupBy(*keys).agg(*_moments(x, y)).where(F.col("n") > limit)
    fields = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    stats = ["full_rank boolean", "alpha double", "r_squared double", "residual_std double", "t_alpha double"]
    stats += [f"`{p}_{c}` double" for c in x for p in ("beta", "t")]
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), "n bigint", *stats])

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.concat([pdf[keys], _solve(pdf, x, y, ridge, plain_t)], axis=1)

    return moments.mapInPandas(batches, schema)


def betas_long(fit: DataFrame, keys: Keys, x: Sequence[str]) -> DataFrame:
    """Coefficients of a fit as rows (keys, factor, beta, t)."""
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"beta_{c}").alias("beta"), F.col(f"t_{c}").alias("t")) for c in x])
    return fit.select(*as_list(keys), F.explode(cells).alias("_b")).select(*as_list(keys), "_b.*")


def student_p_values(df: DataFrame, t: str, dof: str, out: str = "p_value") -> DataFrame:
    """Two-sided Student p-values, vectorised over Arrow batches (regularised incomplete beta)."""
    fields = df.schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` double"])

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            v, s = pdf[dof].to_numpy(float), pdf[t].to_numpy(float)
            yield pdf.assign(**{out: _beta_tail(v, s)})

    return df.mapInPandas(batches, schema)


def _beta_tail(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(|T_v| > |t|) by integrating the density over theta = atan(t / sqrt(v)) with Gauss-Legendre nodes; the normal
    tail above a million degrees of freedom, where the two agree and the density is too narrow for the nodes."""
    if (v > 1e6).any():
        normal = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in t])
        out = normal.copy()
        small = v <= 1e6
        if small.any():
            out[small] = _beta_tail(v[small], t[small])
        return out
    nodes, weights = np.polynomial.legendre.leggauss(200)
    def mass(low: np.ndarray) -> np.ndarray:
        mid, half = (np.pi / 2 + low) / 2, (np.pi / 2 - low) / 2
        theta = mid[:, None] + half[:, None] * nodes
        return half * (np.cos(theta) ** (v[:, None] - 1) @ weights)
    return mass(np.arctan(np.abs(t) / np.sqrt(v))) / mass(np.zeros(len(t)))


# Principal components.

def pca_factors(df: DataFrame, k: int, symbol: str = "symbol", ts: str = "ts", value: str = "ret",
                standardise: bool = False, blocks: int = 1) -> tuple[DataFrame, DataFrame]:
    """(loadings (symbol, factor, loading), scores (ts, factor, score)) of complete dates.

    The covariance comes from block moments; only the assets by assets matrix reaches the driver, which is
    the size of the eigen problem itself, never a function of the number of rows.
    """
    from riskframe.plans.pairs import covariances, pair_moments
    from riskframe.session import cut_lineage
    every = df.select(symbol).distinct().count()
    complete = df.groupBy(ts).agg(F.count(value).alias("_n")).where(F.col("_n") == every).select(ts)
    rows = cut_lineage(df.join(complete, ts).select(ts, symbol, value))
    stats = rows.groupBy(symbol).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    cov = covariances(pair_moments(rows, ts, symbol, value, blocks=blocks)).select("i", "j", "corr" if standardise else "cov").toPandas()
    names = sorted(set(cov["i"]))
    at = {n: p for p, n in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    matrix[cov["i"].map(at), cov["j"].map(at)] = cov.iloc[:, 2]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(k)])
    table = pd.DataFrame([(n, f"PC{p + 1}", float(vectors[at[n], p])) for n in names for p in range(k)],
                         columns=[symbol, "factor", "loading"])
    loadings = df.sparkSession.createDataFrame(table)
    centred = F.col(value) - F.col("_m")
    scaled = F.try_divide(centred, F.col("_s")) if standardise else centred
    scores = (rows.join(stats, symbol).join(loadings, symbol)
              .groupBy(ts, "factor").agg(F.sum(scaled * F.col("loading")).alias("score")))
    return loadings, scores


def specific_risk(variances: DataFrame, loadings: DataFrame, symbol: str = "symbol") -> DataFrame:
    """sqrt(max(variance - sum of squared loadings, 0))."""
    common = loadings.groupBy(symbol).agg(F.sum(F.col("loading") * F.col("loading")).alias("_c"))
    left = F.col("variance") - F.coalesce(F.col("_c"), F.lit(0.0))
    return variances.join(common, symbol, "left").select(symbol, F.sqrt(F.greatest(left, F.lit(0.0))).alias("specific_risk"))


# Using fits.

def compare_models(fits: Mapping[str, tuple[DataFrame, Sequence[str]]], key: str = "symbol", cut: float = 1.96) -> DataFrame:
    """Alpha, R2, residual volatility, number of factors and of significant ones per asset and model."""
    out = None
    for name, (fit, x) in fits.items():
        significant = sum((F.abs(f"t_{c}") > cut).cast("int") for c in x)
        part = fit.select(key, F.lit(name).alias("model"), "alpha", "r_squared", "residual_std",
                          F.lit(len(x)).alias("factors"), significant.alias("significant_factors"))
        out = part if out is None else out.unionByName(part)
    return out


def combine_loadings(betas: DataFrame, weights: Mapping[str, float], keys: Keys = "symbol") -> DataFrame:
    """Weighted loadings keyed model_factor from long betas with a ``model`` column."""
    total = sum(weights.values())
    pairs = [F.lit(x) for m, w in weights.items() for x in (m, w / total)]
    return (betas.withColumn("_w", F.element_at(F.create_map(*pairs), F.col("model")))
            .groupBy(*as_list(keys), F.concat_ws("_", "model", "factor").alias("factor"))
            .agg(F.sum(F.col("_w") * F.col("beta")).alias("loading")))


def factors_long(factors: DataFrame, ts: str = "ts") -> DataFrame:
    names = [c for c in factors.columns if c != ts]
    return factors.unpivot(ts, names, "factor", "value")


def factor_attribution(fit: DataFrame, x: Sequence[str], factors: DataFrame, keys: Keys = "symbol", ts: str = "ts") -> DataFrame:
    """beta * mean factor * n per factor plus alpha * n."""
    keys = as_list(keys)
    means = factors_long(factors, ts).groupBy("factor").agg(F.avg("value").alias("mean_factor"))
    sized = fit.select(*keys, "n")
    parts = (betas_long(fit, keys, x).join(means, "factor").join(sized, keys)
             .select(*keys, "factor", (F.col("beta") * F.col("mean_factor") * F.col("n")).alias("contribution")))
    alpha = fit.select(*keys, F.lit("alpha").alias("factor"), (F.col("alpha") * F.col("n")).alias("contribution"))
    return parts.unionByName(alpha)


def daily_factor_contributions(portfolio: DataFrame, betas: DataFrame, factors: DataFrame, ts: str = "ts") -> DataFrame:
    """Loadings summed over assets times factor per date, and the remainder as alpha."""
    loads = betas.groupBy("factor").agg(F.sum("beta").alias("_b"))
    total = (factors_long(factors, ts).join(loads, "factor").groupBy(ts)
             .agg(F.sum(F.col("_b") * F.col("value")).alias("factor_return")))
    return portfolio.join(total, ts).withColumn("alpha_return", F.col("ret") - F.col("factor_return"))


def explained_variance(contributions: DataFrame, keys: Keys) -> DataFrame:
    return contributions.groupBy(*as_list(keys)).agg(
        F.sum("factor_return").alias("factor_total"), F.sum("alpha_return").alias("alpha_total"),
        F.pow(F.corr("ret", "factor_return"), 2).alias("explained_variance"))


def significance(fit: DataFrame, x: Sequence[str], factors: DataFrame, keys: Keys, ts: str = "ts",
                 level: float = 0.05) -> DataFrame:
    """Exposure, mean factor, contribution, t, p and a significance flag per key and factor."""
    keys = as_list(keys)
    means = factors_long(factors, ts).groupBy("factor").agg(F.avg("value").alias("factor_return"))
    rows = betas_long(fit, keys, x).join(means, "factor").join(
        fit.select(*keys, "n", (F.col("n") - len(x) - 1).cast("double").alias("dof")), keys)
    rows = rows.withColumn("contribution", F.col("beta") * F.col("factor_return") * F.col("n"))
    return student_p_values(rows, "t", "dof").withColumn(
        "significance", F.when(F.col("p_value") < level, "significant").otherwise("not_significant"))


def behavioural_fit(df: DataFrame, keys: Keys, ret: str = "ret", sentiment: str = "sentiment", volume: str = "volume",
                    enough: int = 30) -> DataFrame:
    """Return on sentiment and |return| on log volume, simple regressions per key."""
    size = F.log(F.col(volume) + 1)
    def three(y: Column, x: Column, name: str) -> list[Column]:
        return [F.regr_intercept(y, x).alias(f"{name}_alpha"), F.regr_slope(y, x).alias(f"{name}_beta"),
                F.regr_r2(y, x).alias(f"{name}_r2")]
    return df.na.drop(subset=[ret, sentiment, volume]).groupBy(*as_list(keys)).agg(
        F.count("*").alias("n"), *three(F.col(ret), F.col(sentiment), "sentiment"),
        *three(F.abs(ret), size, "herding")).where(F.col("n") > enough)


def behavioural_impact(fit: DataFrame, sentiment: Column, volume: Column) -> DataFrame:
    return fit.withColumns({
        "sentiment_impact": F.col("sentiment_alpha") + F.col("sentiment_beta") * sentiment,
        "herding_impact": F.col("herding_alpha") + F.col("herding_beta") * F.log(volume + 1)})


def standardised(column: str, keys: Keys) -> Column:
    w = whole(keys)
    return F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_pop(column).over(w))
