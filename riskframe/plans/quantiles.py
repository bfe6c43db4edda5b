"""Exact linear-interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer.  That is right for date-grain series
and wrong for a group with a third of all rows.  Here a mergeable sketch brackets each wanted rank, one
more pass counts the rows under the bracket and keeps only the values inside it, and the exact order
statistics are read from that sliver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

#: Wanted ranks (of all groups together) that are broadcast at most.
BROADCAST_ROWS = 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float],
                    out: str = "quantiles", accuracy: int = 100_000) -> DataFrame:
    """One row per key with an array of the quantiles at ``probs``."""
    keys = list(keys)
    slack = 2.0 / accuracy
    rows = df.select(*keys, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    bounds = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]
    sketch = cut_lineage(rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, accuracy).alias("_b")))
    band = [F.struct(
        F.lit(i).alias("slot"),
        F.floor(F.lit(p) * (F.col("_n") - 1)).alias("pos"),
        (F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))).alias("frac"),
        (F.col("_min") if p <= slack else F.get("_b", F.lit(2 * i))).alias("low"),
        (F.col("_max") if p >= 1 - slack else F.get("_b", F.lit(2 * i + 1))).alias("high"),
    ) for i, p in enumerate(probs)]
    wanted = sketch.select(*keys, F.explode(F.array(*band)).alias("_w")).select(*keys, "_w.*")
    # Few groups go to the rows, or a group's rows would meet in one task to be sorted; many leave each small or to AQE.
    if sketch.count() * len(probs) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # A row meets each wanted rank of its key (a handful), and is combined with equals before the shuffle.
    zone = F.when(F.col("_v") < F.col("low"), -1).when(F.col("_v") > F.col("high"), 1).otherwise(0)
    counted = (rows.join(wanted, keys).withColumn("_z", zone)
               .groupBy(*keys, "slot", "pos", "frac", "_z", F.when(F.col("_z") == 0, F.col("_v")).alias("_in"))
               .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    order = (Window.partitionBy(*keys, "slot").orderBy("_z", "_in")
             .rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", F.sum("_c").over(order)).withColumn(
        "_from", F.col("_upto") - F.col("_c"))

    def at(pos):
        """Order statistic ``pos``; outside the bracket only the value next to it is known."""
        return F.max(F.when((F.col("_z") == 0) & (F.col("_from") <= pos) & (pos < F.col("_upto")), F.col("_in"))
                     .when((F.col("_z") < 0) & (pos == F.col("_upto") - 1), F.col("_hi"))
                     .when((F.col("_z") > 0) & (pos == F.col("_from")), F.col("_lo")))

    picked = ranked.groupBy(*keys, "slot", "frac").agg(
        at(F.col("pos")).alias("_a"), at(F.col("pos") + 1).alias("_b"))
    value = F.when(F.col("frac") == 0, F.col("_a")).otherwise(
        F.col("_a") + F.col("frac") * (F.col("_b") - F.col("_a")))
    return picked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", value.alias("q")))),
                    lambda s: s["q"]).alias(out))
