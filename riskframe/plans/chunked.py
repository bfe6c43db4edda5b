"""Ordered scans over series of any length, safe when one key holds a third of all rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole series to one task.  ``Chunks`` splits a
series into buckets (a column of the caller's choice, usually truncated time, that must not decrease in
the order of the series) and shuffles by (key, bucket).  What has to cross a bucket edge travels in a
summary table with one row per (key, bucket): counts for ranks, totals for running values, last values
for lags.  Rolling frames copy the rows just before a chunk edge into the next chunk.  Results equal the
plain window for every row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_AGG: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "prod": F.product, "max": F.max, "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_JOIN: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda carry, here: F.coalesce(carry, F.lit(0.0)) + here,
    "prod": lambda carry, here: F.coalesce(carry, F.lit(1.0)) * here,
    "max": lambda carry, here: F.greatest(carry, here),
    "min": lambda carry, here: F.least(carry, here),
    "last": lambda carry, here: F.coalesce(here, carry),
}


@dataclass(frozen=True)
class Chunks:
    """How a long series is cut: its ``keys``, its row ``order`` and the ``bucket`` column rule."""

    keys: Sequence[str]
    order: Sequence[str]
    bucket: Column

    def _inside(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_bucket").orderBy(*self.order)

    def _earlier(self) -> WindowSpec:
        return (Window.partitionBy(*self.keys).orderBy("_bucket")
                .rowsBetween(Window.unboundedPreceding, -1))

    def _summaries(self, bucketed: DataFrame, aggs: Sequence[Column]) -> DataFrame:
        return bucketed.groupBy(*self.keys, "_bucket").agg(*aggs)

    def rank(self, df: DataFrame, name: str = "rn") -> DataFrame:
        """Row number of each row in its whole series, from 1."""
        bucketed = df.withColumn("_bucket", self.bucket)
        before = self._summaries(bucketed, [F.count(F.lit(1)).alias("_n")]).select(
            *self.keys, "_bucket",
            F.coalesce(F.sum("_n").over(self._earlier()), F.lit(0)).alias("_before"))
        return (bucketed.withColumn("_rank", F.row_number().over(self._inside()))
                .join(before, [*self.keys, "_bucket"])
                .withColumn(name, F.col("_rank") + F.col("_before"))
                .drop("_bucket", "_rank", "_before"))

    def running(self, df: DataFrame, specs: Mapping[str, tuple[str, str]]) -> DataFrame:
        """Running values; ``specs`` maps an output name to (sum|prod|max|min|last, column)."""
        bucketed = df.withColumn("_bucket", self.bucket)
        inside = self._inside().rowsBetween(Window.unboundedPreceding, 0)
        ordered = F.struct(*self.order)
        totals = []
        for name, (kind, column) in specs.items():
            total = (F.max_by(F.col(column), F.when(F.col(column).isNotNull(), ordered))
                     if kind == "last" else _AGG[kind](F.col(column)))
            totals.append(total.alias(f"_t_{name}"))
        carries = self._summaries(bucketed, totals).select(
            *self.keys, "_bucket",
            *[_AGG[kind](F.col(f"_t_{name}")).over(self._earlier()).alias(f"_c_{name}")
              for name, (kind, _) in specs.items()])
        here = bucketed.withColumns({f"_h_{name}": _AGG[kind](F.col(column)).over(inside)
                                     for name, (kind, column) in specs.items()})
        joined = here.join(carries, [*self.keys, "_bucket"])
        return (joined.withColumns({name: _JOIN[kind](F.col(f"_c_{name}"), F.col(f"_h_{name}"))
                                    for name, (kind, _) in specs.items()})
                .drop("_bucket", *[f"_{p}_{name}" for name in specs for p in "ch"]))

    def previous(self, df: DataFrame, specs: Mapping[str, str]) -> DataFrame:
        """Value of the row before; ``specs`` maps an output name to a column."""
        bucketed = df.withColumn("_bucket", self.bucket)
        ordered = F.struct(*self.order)
        edge = Window.partitionBy(*self.keys).orderBy("_bucket")
        carries = self._summaries(
            bucketed, [F.max_by(F.struct(F.col(c).alias("v")), ordered).alias(f"_t_{n}")
                       for n, c in specs.items()]
        ).select(*self.keys, "_bucket",
                 *[F.lag(f"_t_{n}").over(edge).getField("v").alias(f"_c_{n}") for n in specs])
        ranked = bucketed.withColumn("_rank", F.row_number().over(self._inside()))
        here = ranked.withColumns({f"_h_{n}": F.lag(c).over(self._inside()) for n, c in specs.items()})
        return (here.join(carries, [*self.keys, "_bucket"])
                .withColumns({n: F.when(F.col("_rank") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_h_{n}"))
                              for n in specs})
                .drop("_bucket", "_rank", *[f"_{p}_{n}" for n in specs for p in "ch"]))

    def rolling(self, df: DataFrame, rows: int, exprs: Mapping[str, Callable[[WindowSpec], Column]],
                chunk_rows: int = 1_000_000) -> DataFrame:
        """Frames of up to ``rows`` rows; ``exprs`` maps a name to a function of the window.

        The series is re-cut into chunks of exactly ``chunk_rows`` rows by rank, so a burst inside one
        time bucket cannot overload a task of the second shuffle.
        """
        own = F.floor((F.col("_rn") - 1) / chunk_rows)
        reach = F.floor((F.col("_rn") + rows - 2) / chunk_rows)
        copied = (self.rank(df, "_rn").withColumn("_own", own)
                  .withColumn("_chunk", F.explode(F.sequence(F.col("_own"), reach))))
        window = (Window.partitionBy(*self.keys, "_chunk").orderBy("_rn")
                  .rowsBetween(-(rows - 1), 0))
        return (copied.withColumns({name: fn(window) for name, fn in exprs.items()})
                .where(F.col("_own") == F.col("_chunk"))
                .drop("_rn", "_own", "_chunk"))
