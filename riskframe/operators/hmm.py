"""Gaussian hidden Markov models pooled over many series.

Parameters are shared by all series of a table (with one series this is the ordinary fit).  Spark does the
passes over the data; only K x K, K x d and K x d x d sums reach the driver.  A long series is cut into
chunks: the forward pass is a product of K x K matrices, so each chunk is folded to one matrix, the
matrices of a series (one row per chunk) give every chunk its incoming forward and outgoing backward
vector, and the chunks then run independently.  Viterbi is the same scan in max-plus algebra.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.plans.chunked import Chunks
from riskframe.plans.windows import Keys, as_list, by
from riskframe.session import cut_lineage

COVARIANCES = ("full", "diag", "spherical")


@dataclass
class Gaussian:
    """Model parameters; ``cov`` is always K x d x d."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """n x K log emission densities, clipped to +-700."""
        n, d = x.shape
        out = np.empty((n, self.states))
        for k in range(self.states):
            chol = np.linalg.cholesky(self.cov[k])
            z = np.linalg.solve(chol, (x - self.mean[k]).T)
            out[:, k] = -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(chol)).sum()
        return np.clip(out, -700, 700)


def log_density_columns(features: Sequence[str], mean: np.ndarray, var: np.ndarray) -> list[Column]:
    """Diagonal emission log densities as column arithmetic, one column per state."""
    from riskframe.functions.stats import normal_logpdf
    out = []
    for k in range(len(mean)):
        total = F.lit(0.0)
        for i, f in enumerate(features):
            total = total + normal_logpdf(f, float(mean[k][i]), float(var[k][i]))
        out.append(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), total)))
    return out


# Passes over one chunk, plain arrays.

def _emissions(model: Gaussian, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logb = model.log_density(x)
    top = logb.max(1)
    return np.exp(logb - top[:, None]), top


def chunk_matrix(model: Gaussian, x: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """Scaled forward matrix of a chunk and the log of its scale."""
    b, top = _emissions(model, x)
    m, scale = np.eye(model.states), top.sum()
    for t in range(len(b)):
        m = (m if first and t == 0 else m @ model.trans) * b[t]
        s = m.sum()
        m, scale = m / s, scale + np.log(s)
    return m, scale


def forward_backward(model: Gaussian, x: np.ndarray, first: bool, alpha_in: np.ndarray, beta_out: np.ndarray,
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Filtered and smoothed probabilities, the sum of pair probabilities and the log-likelihood of a chunk."""
    b, top = _emissions(model, x)
    n, k = b.shape
    alpha, scale = np.empty((n, k)), np.empty(n)
    prior = alpha_in if first else alpha_in @ model.trans
    for t in range(n):
        a = prior * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
        prior = alpha[t] @ model.trans
    beta = np.empty((n, k))
    beta[-1] = beta_out
    for t in range(n - 2, -1, -1):
        v = model.trans @ (b[t + 1] * beta[t + 1])
        beta[t] = v / v.sum()
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    before = alpha[:-1] if first else np.vstack([alpha_in, alpha[:-1]])
    after = (b * beta)[1:] if first else b * beta
    pairs = before[:, :, None] * model.trans * after[:, None, :]
    xi = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0) if len(pairs) else np.zeros((k, k))
    return alpha, gamma, xi, float(np.log(scale).sum() + top.sum())


def max_matrix(model: Gaussian, x: np.ndarray, first: bool) -> np.ndarray:
    """Best log score from each state before the chunk to each state at its end."""
    logb, loga = model.log_density(x), np.log(model.trans + 1e-300)
    w = np.where(np.eye(model.states) > 0, 0.0, -np.inf)
    for t in range(len(logb)):
        step = w if first and t == 0 else (w[:, :, None] + loga).max(1)
        w = step + logb[t]
    return w


def best_path(model: Gaussian, x: np.ndarray, first: bool, score_in: np.ndarray, exit_state: int) -> np.ndarray:
    logb, loga = model.log_density(x), np.log(model.trans + 1e-300)
    n, k = logb.shape
    back, score = np.zeros((n, k), int), score_in
    for t in range(n):
        if first and t == 0:
            score = score_in + logb[0]
            continue
        step = score[:, None] + loga
        back[t] = step.argmax(0)
        score = step.max(0) + logb[t]
    path = np.empty(n, int)
    path[-1] = exit_state if exit_state >= 0 else int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _sums(x: np.ndarray, gamma: np.ndarray, xi: np.ndarray, first: bool) -> np.ndarray:
    """Sufficient statistics of a chunk as one vector."""
    start = gamma[0] if first else np.zeros(gamma.shape[1])
    second = np.einsum("nk,ni,nj->kij", gamma, x, x)
    return np.concatenate([start, xi.ravel(), gamma.sum(0), (gamma.T @ x).ravel(), second.ravel()])


def update(stats: np.ndarray, states: int, d: int, kind: str, floor: float) -> Gaussian:
    """M-step from pooled sums."""
    cuts = np.cumsum([states, states * states, states, states * d])
    start, xi, weight, first, second = np.split(stats, cuts)
    start = start + 1e-8
    trans = xi.reshape(states, states) + 1e-8
    weight = np.maximum(weight, 1e-300)
    mean = first.reshape(states, d) / weight[:, None]
    cov = second.reshape(states, d, d) / weight[:, None, None] - mean[:, :, None] * mean[:, None, :]
    eye = np.eye(d)
    if kind == "diag":
        cov = cov * eye
    elif kind == "spherical":
        cov = np.einsum("kii->k", cov)[:, None, None] / d * eye
    return Gaussian(start / start.sum(), trans / trans.sum(1, keepdims=True), mean, cov + floor * eye)


# Spark passes.

@dataclass
class HiddenMarkov:
    """Pooled Gaussian hidden Markov model over series of (keys, ts, features)."""

    features: Sequence[str]
    keys: Keys = "series_id"
    ts: str = "ts"
    states: int = 3
    covariance: str = "full"
    n_iter: int = 100
    tol: float = 1e-4
    seed: int = 42
    floor: float = 1e-6
    filtered: bool = False
    bucket: Column | None = None
    chunk_rows: int = 50_000
    model: Gaussian | None = None
    history: list[float] = field(default_factory=list)
    converged: bool = False

    def __post_init__(self) -> None:
        if self.covariance not in COVARIANCES:
            raise ValueError(f"unknown covariance {self.covariance!r}; one of {COVARIANCES}")
        self._keys = as_list(self.keys)
        self._heads = [*self._keys, "_chunk"]

    # Preparation.

    def _cut(self, df: DataFrame) -> DataFrame:
        """Rows with their rank and chunk.  Date-grain series fit in one chunk; give ``bucket`` for longer ones."""
        rows = df.na.drop(subset=list(self.features)).select(*self._keys, self.ts, *self.features)
        if self.bucket is None:
            ranked = rows.withColumn("_rn", F.row_number().over(by(self._keys, self.ts)))
        else:
            ranked = Chunks(self._keys, [self.ts], self.bucket).rank(rows, "_rn")
        return ranked.withColumn("_chunk", F.floor((F.col("_rn") - 1) / self.chunk_rows))

    def _key_types(self, df: DataFrame, columns: Sequence[str]) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        return ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def initial(self, df: DataFrame) -> Gaussian:
        """K-means clusters over all rows, ordered by the first feature; uniform start, 0.9 on the diagonal."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler
        f, d, k = list(self.features), len(self.features), self.states
        rows = VectorAssembler(inputCols=f, outputCol="_x").transform(df)
        fitted = KMeans(k=k, seed=self.seed, featuresCol="_x", predictionCol="_c").fit(rows)
        labelled = fitted.transform(rows)
        aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(f)]]
        pop = F.covar_samp if self.covariance == "full" else F.covar_pop
        aggs += [pop(f[i], f[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
        table = labelled.groupBy("_c").agg(*aggs).toPandas().sort_values("m0").reset_index(drop=True)
        if len(table) < k:
            raise ValueError(f"only {len(table)} distinct clusters for {k} states; the data is too small")
        mean, cov = table[[f"m{i}" for i in range(d)]].to_numpy(), np.zeros((k, d, d))
        for i in range(d):
            for j in range(i, d):
                cov[:, i, j] = cov[:, j, i] = table[f"c{i}_{j}"].fillna(0.0)
        eye = np.eye(d)
        if self.covariance == "diag":
            cov = cov * eye
        elif self.covariance == "spherical":
            cov = np.einsum("kii->k", cov)[:, None, None] / d * eye
        trans = np.full((k, k), 0.1 / (k - 1))
        np.fill_diagonal(trans, 0.9)
        return Gaussian(np.full(k, 1 / k), trans, mean, cov + self.floor * eye)

    # Chunk edges.

    def _edges(self, rows: DataFrame, model: Gaussian, best: bool) -> DataFrame:
        """(keys, _chunk, _in, _out): the vectors that enter and leave each chunk of each series."""
        f, heads, keys, k = list(self.features), self._heads, self._keys, self.states

        def fold(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("_rn")[f].to_numpy(float)
            m = max_matrix(model, x, group[-1] == 0) if best else chunk_matrix(model, x, group[-1] == 0)[0]
            return pd.DataFrame([(*group, m.ravel())], columns=[*heads, "_m"])

        def spread(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_chunk")
            ms = [np.asarray(m).reshape(k, k) for m in pdf["_m"]]
            ins, outs = _best_edges(model, ms) if best else _sum_edges(model, ms)
            return pdf[heads].assign(_in=ins, _out=outs)

        types = self._key_types(rows, heads)
        return (rows.groupBy(*heads).applyInPandas(fold, types + ", _m array<double>")
                .groupBy(*keys).applyInPandas(spread, types + ", _in array<double>, _out array<double>"))

    def _with_edges(self, rows: DataFrame, model: Gaussian, single: bool, best: bool) -> DataFrame:
        if single:
            start = np.log(model.start + 1e-300) if best else model.start
            out = np.array([-1.0]) if best else np.ones(self.states)
            return rows.withColumns({"_in": F.lit([float(v) for v in start]), "_out": F.lit([float(v) for v in out])})
        return rows.join(self._edges(rows, model, best), self._heads)

    # Fit.

    def fit(self, df: DataFrame) -> HiddenMarkov:
        """EM until the log-likelihood moves less than ``tol`` or ``n_iter`` passes are done."""
        rows = cut_lineage(self._cut(df))
        shape = rows.agg(F.count("*").alias("n"), F.max("_chunk").alias("c")).first()
        if shape["n"] < max(2 * self.states, len(self.features) + 1):
            raise ValueError(f"{shape['n']} complete rows are too few for {self.states} states")
        model, d = self.initial(rows), len(self.features)
        self.history, self.converged, previous = [], False, -np.inf
        for _ in range(self.n_iter):
            stats, score = self._pooled(rows, model, shape["c"] == 0)
            model = update(stats, self.states, d, self.covariance, self.floor)
            self.history.append(score)
            if abs(score - previous) < self.tol:
                self.converged = True
                break
            previous = score
        self.model = model
        return self

    def _pooled(self, rows: DataFrame, model: Gaussian, single: bool) -> tuple[np.ndarray, float]:
        f, filtered = list(self.features), self.filtered

        def expect(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, first = pdf.sort_values("_rn"), group[-1] == 0
            x, alpha_in = pdf[f].to_numpy(float), np.asarray(pdf["_in"].iloc[0])
            alpha, gamma, xi, score = forward_backward(model, x, first, alpha_in, np.asarray(pdf["_out"].iloc[0]))
            if filtered:
                before = alpha[:-1] if first else np.vstack([alpha_in, alpha[:-1]])
                gamma, xi = alpha, before.T @ (alpha[1:] if first else alpha)
            return pd.DataFrame({"_s": [np.append(_sums(x, gamma, xi, first), score)]})

        sums = self._with_edges(rows, model, single, False).groupBy(*self._heads).applyInPandas(expect, "_s array<double>")
        total = sums.select(F.posexplode("_s").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).toPandas()
        vector = total.sort_values("p")["v"].to_numpy()
        return vector[:-1], float(vector[-1])

    # Use.

    def _need(self) -> Gaussian:
        if self.model is None:
            raise ValueError("fit the model first")
        return self.model

    def _apply(self, df: DataFrame, best: bool, schema: str, fn) -> DataFrame:
        model, f, keys, ts = self._need(), list(self.features), self._keys, self.ts
        rows = self._cut(df)
        # Without a bucket rule every series is date grain and its chunks are few; the edge pass is skipped
        # only if no series is longer than one chunk, which the rank's maximum tells.
        single = self.bucket is None and (rows.agg(F.max("_chunk")).first()[0] or 0) == 0
        types = self._key_types(rows, [*keys, ts, *f])

        def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rn")
            x = pdf[f].to_numpy(float)
            return fn(model, pdf[[*keys, ts, *f]], x, group[-1] == 0, np.asarray(pdf["_in"].iloc[0]), np.asarray(pdf["_out"].iloc[0]))

        return self._with_edges(rows, model, single, best).groupBy(*self._heads).applyInPandas(run, f"{types}, {schema}")

    def predict(self, df: DataFrame) -> DataFrame:
        """Viterbi path: adds ``regime``."""
        def run(model, out, x, first, score_in, exit_state):
            return out.assign(regime=best_path(model, x, first, score_in, int(exit_state[0])).astype("int32"))
        return self._apply(df, True, "regime int", run)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Smoothed state probabilities: adds ``probs``."""
        def run(model, out, x, first, alpha_in, beta_out):
            return out.assign(probs=list(forward_backward(model, x, first, alpha_in, beta_out)[1]))
        return self._apply(df, False, "probs array<double>", run)

    def filter_proba(self, df: DataFrame) -> DataFrame:
        """Filtered probabilities, which use no later rows: adds ``probs``."""
        def run(model, out, x, first, alpha_in, beta_out):
            return out.assign(probs=list(forward_backward(model, x, first, alpha_in, beta_out)[0]))
        return self._apply(df, False, "probs array<double>", run)

    def score(self, df: DataFrame) -> DataFrame:
        """Log-likelihood per series."""
        def run(model, out, x, first, alpha_in, beta_out):
            value = forward_backward(model, x, first, alpha_in, beta_out)[3]
            return out.iloc[:1].assign(_ll=value)
        scored = self._apply(df, False, "_ll double", run)
        return scored.groupBy(*self._keys).agg(F.sum("_ll").alias("log_likelihood"))

    def parameters(self, df: DataFrame) -> DataFrame:
        """(regime, start_prob, persistence, expected_duration, mean_*, std_*): one row per state."""
        model = self._need()
        rows = []
        for k in range(self.states):
            stay = float(model.trans[k, k])
            rows.append((k, float(model.start[k]), stay, 1 / (1 - stay) if stay < 1 else None,
                         *[float(v) for v in model.mean[k]], *[float(v) for v in np.sqrt(np.diag(model.cov[k]))]))
        names = ["regime int", "start_prob double", "persistence double", "expected_duration double",
                 *[f"`mean_{f}` double" for f in self.features], *[f"`std_{f}` double" for f in self.features]]
        return df.sparkSession.createDataFrame(rows, ", ".join(names))

    def transitions(self, df: DataFrame) -> DataFrame:
        model = self._need()
        cells = [(i, j, float(model.trans[i, j])) for i in range(self.states) for j in range(self.states)]
        return df.sparkSession.createDataFrame(cells, "from_regime int, to_regime int, probability double")


def _sum_edges(model: Gaussian, ms: list[np.ndarray]) -> tuple[list, list]:
    ins, a = [], model.start
    for m in ms:
        ins.append(a)
        a = a @ m
        a = a / a.sum()
    outs, b = [], np.ones(model.states)
    for m in reversed(ms):
        outs.append(b)
        b = m @ b
        b = b / b.sum()
    return ins, outs[::-1]


def _best_edges(model: Gaussian, ms: list[np.ndarray]) -> tuple[list, list]:
    ins, s = [], np.log(model.start + 1e-300)
    for m in ms:
        ins.append(s)
        s = (s[:, None] + m).max(0)
    exits, state = [], int(s.argmax())
    for before, m in zip(reversed(ins), reversed(ms)):
        exits.append(np.array([float(state)]))
        state = int((before + m[:, state]).argmax())
    return ins, exits[::-1]


# Fits inside one task: bounded windows.

def fit_window(x: np.ndarray, states: int, n_iter: int = 50, tol: float = 1e-4, floor: float = 1e-6) -> Gaussian:
    """EM on the rows of one window, started from equal slices of the first feature."""
    n, d = x.shape
    order = np.argsort(x[:, 0], kind="stable")
    label = np.empty(n, int)
    label[order] = np.arange(n) * states // n
    for _ in range(10):
        centre = np.array([x[label == k].mean(0) if (label == k).any() else x.mean(0) for k in range(states)])
        label = ((x[:, None, :] - centre) ** 2).sum(2).argmin(1)
    centre = centre[np.argsort(centre[:, 0], kind="stable")]
    label = ((x[:, None, :] - centre) ** 2).sum(2).argmin(1)
    eye = np.eye(d)
    cov = np.array([np.cov(x[label == k].T).reshape(d, d) + floor * eye if (label == k).sum() > 1 else floor * eye for k in range(states)])
    trans = np.full((states, states), 0.1 / (states - 1))
    np.fill_diagonal(trans, 0.9)
    model, previous = Gaussian(np.full(states, 1 / states), trans, centre, cov), -np.inf
    for _ in range(n_iter):
        _, gamma, xi, score = forward_backward(model, x, True, model.start, np.ones(states))
        model = update(_sums(x, gamma, xi, True), states, d, "full", floor)
        if abs(score - previous) < tol:
            break
        previous = score
    return model


def rolling_fit(df: DataFrame, features: Sequence[str], keys: Keys = "series_id", ts: str = "ts", states: int = 3,
                window: int = 252, step: int = 21, smallest: int = 126, n_iter: int = 50) -> DataFrame:
    """Refit on every window of ``window`` rows each ``step`` rows, all windows in parallel.

    One row per (keys, window): dates, means, persistence, and the predictions of the window's last step.
    """
    keys, f = as_list(keys), list(features)
    ranked = df.na.drop(subset=f).select(*keys, ts, *f, (F.row_number().over(by(keys, ts)) - 1).alias("_rn"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_rn") - window + 1) / step))
    placed = ranked.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("_rn") / step))))
    kinds = {x.name: x.dataType.simpleString() for x in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "window bigint", "start_date timestamp", "end_date timestamp", "n int",
                        "means array<double>", "persistence array<double>", "dates array<timestamp>", "regimes array<int>", "confidence array<double>"])

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "window", "start_date", "end_date", "n", "means", "persistence", "dates", "regimes", "confidence"]
        if len(pdf) < smallest:
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values("_rn")
        x = pdf[f].to_numpy(float)
        model = fit_window(x, states, n_iter)
        path = best_path(model, x, True, np.log(model.start + 1e-300), -1)
        probs = forward_backward(model, x, True, model.start, np.ones(states))[1]
        times, last = list(pdf[ts]), slice(max(0, len(x) - step), None)
        return pd.DataFrame([(*group, times[0], times[-1], len(x), model.mean[:, 0], np.diag(model.trans), times[last],
                              path[last].astype("int32"), probs.max(1)[last])], columns=names)

    return placed.groupBy(*keys, "window").applyInPandas(one, schema)


def rolling_predictions(fits: DataFrame, keys: Keys = "series_id", ts: str = "ts") -> DataFrame:
    """Prediction per date; where windows overlap the latest window wins."""
    keys = as_list(keys)
    cells = F.explode(F.arrays_zip("dates", "regimes", "confidence")).alias("_p")
    long = fits.select(*keys, "window", cells).select(*keys, "window", F.col("_p.dates").alias(ts), F.col("_p.regimes").alias("regime"),
                                                      F.col("_p.confidence").alias("confidence"))
    return long.groupBy(*keys, ts).agg(F.max_by(F.struct("regime", "confidence", "window"), "window").alias("_r")).select(*keys, ts, "_r.*")


def parameter_evolution(fits: DataFrame, keys: Keys = "series_id") -> DataFrame:
    """Mean and persistence of each regime per window."""
    keys = as_list(keys)
    cells = F.posexplode(F.arrays_zip("means", "persistence")).alias("regime", "_p")
    return fits.select(*keys, "window", "start_date", "end_date", cells).select(
        *keys, "window", "start_date", "end_date", "regime", F.col("_p.means").alias("mean"), F.col("_p.persistence").alias("persistence"))


def volatility_regimes(df: DataFrame, keys: Keys, ret: str = "ret", ts: str = "ts", n_iter: int = 100) -> tuple[HiddenMarkov, DataFrame]:
    """Two-state model of returns; (model, table of mean, volatility and frequency per regime)."""
    fitted = HiddenMarkov([ret], keys, ts, states=2, n_iter=n_iter).fit(df)
    labelled = fitted.predict(df)
    counts = labelled.groupBy("regime").agg(F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("volatility"), F.count("*").alias("n"))
    from pyspark.sql import Window
    return fitted, counts.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
