"""Pairwise moments of many series without forming row-level pairs.

Each row is sent to the block pairs its symbol takes part in (universe / block copies, not one per
partner); a task holds two blocks of symbols for one slice of dates and multiplies the two matrices.
The slices are then added up per symbol pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MOMENTS = ["n", "si", "sj", "sij", "sii", "sjj"]


def _block_copies(df: DataFrame, blocks: int) -> DataFrame:
    """Tag rows with the block pairs (bi <= bj) they belong to."""
    block = F.pmod(F.xxhash64("_s"), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)),
                        lambda other: F.struct(F.least(F.col("_blk"), other).alias("bi"),
                                               F.greatest(F.col("_blk"), other).alias("bj")))
    return (df.withColumn("_blk", block).withColumn("_p", F.explode(pairs))
            .select("*", F.col("_p.bi").alias("_bi"), F.col("_p.bj").alias("_bj")).drop("_p"))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dates, di = np.unique(pdf["_t"].to_numpy(), return_inverse=True)
    symbols, si = np.unique(pdf["_s"].to_numpy().astype(str), return_inverse=True)
    values = np.full((len(dates), len(symbols)), np.nan)
    values[di, si] = pdf["_v"].to_numpy()
    return values, symbols, dates


def pair_moments(df: DataFrame, ts: str = "ts", symbol: str = "symbol", value: str = "ret",
                 keys: Sequence[str] = (), blocks: int = 1, dates_per_slice: str = "year") -> DataFrame:
    """Counts, sums and cross sums of every symbol pair i <= j over their common dates.

    ``blocks`` is the universe size over the wanted block width; 1 suits a few thousand symbols.
    """
    keys = list(keys)
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(symbol).cast("string").alias("_s"), F.col(ts).alias("_t"),
        F.date_trunc(dates_per_slice, F.col(ts)).alias("_slice"), F.col(value).cast("double").alias("_v"))
    tagged = _block_copies(rows, blocks)
    schema = ", ".join([*(f"`{k}` {key_types[k]}" for k in keys), "i string", "j string",
                        *(f"{m} double" for m in _MOMENTS)])

    def multiply(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, names, _ = _matrix(pdf)
        mask = ~np.isnan(x)
        x0, m = np.where(mask, x, 0.0), mask.astype(float)
        bi, bj = int(pdf["_bi"].iloc[0]), int(pdf["_bj"].iloc[0])
        of = dict(zip(pdf["_s"], pdf["_blk"]))
        blk = np.array([of[s] for s in names])
        # Keep i < j once: inside one block the upper triangle, across blocks every cross pair.
        keep = np.triu(np.ones((len(names), len(names)), bool))
        if bi != bj:
            keep &= blk[:, None] != blk[None, :]
        ii, jj = np.nonzero(keep)
        out = {k: group[p] for p, k in enumerate(keys)}
        stats = {"n": m.T @ m, "si": x0.T @ m, "sj": m.T @ x0, "sij": x0.T @ x0,
                 "sii": (x0 * x0).T @ m, "sjj": m.T @ (x0 * x0)}
        frame = pd.DataFrame({"i": names[ii], "j": names[jj], **{k: v[ii, jj] for k, v in stats.items()}})
        frame = frame[frame["n"] > 0]
        for k, v in out.items():
            frame[k] = v
        return frame[[*keys, "i", "j", *_MOMENTS]]

    return (tagged.groupBy(*keys, "_bi", "_bj", "_slice").applyInPandas(multiply, schema)
            .groupBy(*keys, "i", "j").agg(*[F.sum(m).alias(m) for m in _MOMENTS]))


def covariances(moments: DataFrame, keys: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Sample covariance and correlation per pair, both (i, j) and (j, i) listed."""
    n = F.col("n")
    cxy = F.col("sij") - F.col("si") * F.col("sj") / n
    cxx = F.col("sii") - F.col("si") * F.col("si") / n
    cyy = F.col("sjj") - F.col("sj") * F.col("sj") / n
    upper = moments.select(
        *keys, "i", "j", "n",
        F.when(n > 1, scale * cxy / (n - 1)).alias("cov"),
        F.when((cxx > 0) & (cyy > 0), cxy / F.sqrt(cxx * cyy)).alias("corr"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return (upper.withColumn("_ij", F.explode(both))
            .select(*keys, F.col("_ij.i").alias("i"), F.col("_ij.j").alias("j"), "n", "cov", "corr"))
