"""Regime changes of a label stream that lose nothing: a log of labels and a table of time slots.

A label changes only what follows it directly, so the result is kept by (series, slot of time).  Each micro-batch adds
its labels to the log, whatever their times, and evaluates the slots it touches again: the changes within the slot and its
first and last label.  What lies between slots is read off a table with one row for each slot.  So late labels need no
watermark, nothing waits in a state when a stream ends, and a series on any share of the labels is spread over its slots.
A repeated batch overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from riskframe.session import scratch_folder
from riskframe.streaming.run import Handler, newest, start

#: Changes of a series that are numbered in one task.
CHUNK = 4096


def regime_log_handler(folder: str, slot: str = "1 hour") -> Handler:
    """Take labels (series_id, ts, tie, regime, confidence) into the log and the slots under ``folder``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        labels = batch.select("series_id", "ts", F.col("tie").cast("bigint").alias("tie"), F.col("regime").cast("int").alias("regime"),
                              F.col("confidence").cast("double").alias("confidence"), F.window("ts", slot)["start"].alias("slot"))
        # A folder for each day lets a batch read the days it touches only.
        labels = labels.withColumn("day", F.to_date("slot"))
        labels.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/labels/batch={batch_id}")
        own = [*labels.drop("day").schema.fields, StructField("day", DateType())]
        log = spark.read.schema(StructType([*own, StructField("batch", LongType())])).parquet(f"{folder}/labels").where(F.col("batch") <= batch_id)
        new = spark.read.schema(StructType(own)).parquet(f"{folder}/labels/batch={batch_id}")
        touched = log.join(new.select("series_id", "slot", "day").distinct(), ["series_id", "slot", "day"], "left_semi")
        evaluated(touched).write.mode("overwrite").parquet(f"{folder}/slots/batch={batch_id}")
    return handle


def evaluated(labels: DataFrame) -> DataFrame:
    """(series_id, slot, first, last, changes): one row for each slot, whose labels are ordered by (ts, tie)."""
    order = Window.partitionBy("series_id", "slot").orderBy("ts", "tie")
    rows = labels.withColumn("before", F.lag("regime").over(order))
    change = F.struct("ts", "tie", F.col("before").alias("from_regime"), F.col("regime").alias("to_regime"), "confidence")
    at = F.struct("ts", "tie", F.col("before").alias("from_regime"), F.col("regime").alias("to_regime"), "confidence")
    return rows.groupBy("series_id", "slot").agg(
        F.min(at).alias("first"), F.max_by("regime", F.struct("ts", "tie")).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("before") != F.col("regime"), change))).alias("changes"))


def regime_changes_logged(spark: SparkSession, folder: str, keep: int = 100) -> DataFrame:
    """(series_id, ts, from_regime, to_regime, confidence, switches, recent) of all labels taken in so far: each change, the number
    of changes up to it, and the last ``keep`` regimes changed to."""
    slots = newest(spark.read.parquet(f"{folder}/slots"), ["series_id", "slot"])
    by_time = Window.partitionBy("series_id").orderBy("slot")  # one row for each slot
    slots = slots.withColumn("previous", F.lag("last").over(by_time))
    edge = F.when(F.col("previous") != F.col("first.to_regime"), F.array(F.col("first").withField("from_regime", F.col("previous"))))
    slots = slots.withColumn("changes", F.concat(F.coalesce(edge, F.array().cast(slots.schema["changes"].dataType)), "changes"))
    slots = slots.withColumn("done", F.coalesce(F.sum(F.size("changes")).over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = slots.select("series_id", "done", F.posexplode("changes").alias("pos", "c")).select(
        "series_id", "c.*", (F.col("done") + F.col("pos") + 1).alias("switches")).drop("tie")
    # The last regimes come from the rows before: chunks of a series, each with the last rows of the one before.
    number = F.floor(F.col("switches") / CHUNK)
    carried = F.col("switches") % CHUNK > CHUNK - keep
    rows = rows.withColumn("own", number).withColumn("chunk", F.explode(F.when(carried, F.array(number, number + 1)).otherwise(F.array(number))))
    last = Window.partitionBy("series_id", "chunk").orderBy("switches").rowsBetween(1 - keep, 0)
    return rows.withColumn("recent", F.collect_list("to_regime").over(last)).where("chunk = own").drop("chunk", "own")


def drain_regime_changes(labels: DataFrame, slot: str = "1 hour", keep: int = 100) -> DataFrame:
    """Run a label stream over all available data; the changes of all of it, in whatever order and triggers it came."""
    spark = labels.sparkSession
    folder = scratch_folder(spark, "regimes")
    start(labels, regime_log_handler(f"{folder}/log", slot), f"{folder}/state").awaitTermination()
    return regime_changes_logged(spark, f"{folder}/log", keep)
