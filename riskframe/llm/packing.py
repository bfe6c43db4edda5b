"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents.  In each round (window) a queue earns its quantum, ``window`` tokens times
its share of the mixture, and sends whole documents as long as what it has sent is below what it has earned; the
rest of a document, beyond the quantum, is a deficit that it pays back in the windows that follow.  So the token
mixture of the stream never strays from the target by more than a document for each queue.  The stream is then
cut into sequences of ``length`` tokens, so documents are cut at sequence ends only and nothing but the last
sequence is padded.

The rounds need no sequential run.  A document that starts at a place ``a`` of its queue is sent once the queue has
earned ``a`` and a part of the document (the same part for all documents of a queue, by hash, so that the first
documents of many small queues do not all come at once).  Without weights a queue's earnings are a line.  With
weights all queues that are not dry are at the same number of tokens for each unit of weight, and the time at which
they are there follows from the totals of the queues that have a weight.  Any task finds the window of any document
by that alone; deficits carry over windows and partitions.

Every source has a queue of its own, however many there are: totals are a table.  Only the totals of sources that
``weights`` names come to the driver.

Shuffles: ids are written once in the shared folder and shuffled once, by row number, to meet their place.  All
else moves a few integers for each document.  No key holds more than one source partition or 1,024 windows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.llm.tokens import encoder, vocabulary
from riskframe.session import scratch_folder

#: Windows whose documents are put in order in one group: at most so many times ``window`` tokens.
GROUP_WINDOWS = 1024
#: Bytes of text, or of ids, that a task works on at a time.
HELD_BYTES = 1 << 20


def weighted_time(totals: dict[str, int], weights: dict[str, float], window: int):
    """The time, in windows, at which queues have earned so many tokens for each unit of weight, and the time when all
    are dry.  A queue that runs dry leaves its share to the others."""
    dry, left, sent = (np.array(x, float) for x in zip(*sorted((n / weights[q], weights[q], n) for q, n in totals.items())))
    sent = np.concatenate([[0.0], np.cumsum(sent)])
    left = np.concatenate([np.cumsum(left[::-1])[::-1], [0.0]])

    def time(level: np.ndarray) -> np.ndarray:
        i = np.searchsorted(dry, level)
        return (sent[i] + level * left[i]) / window

    return time, sent[-1] / window


def encode_rows(docs: DataFrame, vocabulary_path: str, end_id: int, id: str, text: str, source: str) -> DataFrame:
    """``(part, row, queue, id, n, ids)``: ids of whole texts with the end id, numbered within each task's part."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"))

    def run(batches):
        own, part, number = encoder(vocabulary_path), TaskContext.get().partitionId(), count()
        end = np.array([end_id], own.dtype).tobytes()
        for batch in bounded(batches, "text", HELD_BYTES, 8192):
            flat, ends = own.batch(batch.column("text"))
            ids = [flat[a:b].tobytes() + end for a, b in zip(ends, ends[1:])]
            yield record_batch(
                part=pa.array([part] * len(ids), pa.int32()), row=pa.array([next(number) for _ in ids], pa.int64()),
                queue=batch.column("queue"), id=batch.column("id"),
                n=pa.array(np.diff(ends) + 1, pa.int64()), ids=pa.array(ids, pa.binary()))

    return rows.mapInArrow(run, "part int, row long, queue string, id long, n long, ids binary")


def place(rows: DataFrame, weights: dict[str, float] | None, window: int) -> DataFrame:
    """``(part, row, place)``: where in the packed stream each row of ``(part, row, queue, n)`` begins."""
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    weights = {q: float(w) for q, w in (weights or {}).items() if w > 0}
    named = rows.sparkSession.createDataFrame([(q, w) for q, w in weights.items()], "queue string, weight double")
    totals = dict(parts.join(F.broadcast(named), "queue").groupBy("queue").agg(F.sum("n")).collect()) if weights else {}
    whole = (parts.agg(F.sum("n")).first()[0] or 0) - sum(totals.values())
    time, dry = weighted_time(totals, weights, window) if totals else (None, 0.0)
    of_queue = W.partitionBy("queue")  # a row for each part
    before = parts.select("queue", "part", F.sum("n").over(of_queue).alias("total"), F.sum("n").over(
        of_queue.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("ahead"))
    before = before.join(F.broadcast(named), "queue", "left")
    in_part = W.partitionBy("part", "queue").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    phase = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / (1 << 20)
    starts = (rows.withColumn("own", F.sum("n").over(in_part))
              .join(before, ["queue", "part"])
              .withColumn("a", F.coalesce("ahead", F.lit(0)) + F.coalesce("own", F.lit(0)))
              .withColumn("due", F.col("a") + F.col("n") * phase))
    # Queues without a weight follow when the others are dry, in the mixture of their totals; they end together.
    at = F.lit(dry) + F.col("due") / F.col("total") * (whole / window)
    if totals:
        when = F.pandas_udf(lambda level: pd.Series(time(level.to_numpy())), "double")
        at = F.when(F.col("weight").isNotNull(), when(F.coalesce(F.col("due") / F.col("weight"), F.lit(0.0)))).otherwise(at)
    timed = (starts.withColumn("k", F.floor(at))
             .select("part", "row", "queue", "a", "n", "k", F.floor(F.col("k") / GROUP_WINDOWS).alias("group")))
    groups = timed.groupBy("group").agg(F.sum("n").alias("n")).withColumn(  # one row for 1,024 windows
        "base", F.sum("n").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    order = W.partitionBy("group").orderBy("k", "queue", "a").rowsBetween(W.unboundedPreceding, -1)
    return (timed.withColumn("inner", F.sum("n").over(order)).join(groups, "group")
            .select("part", "row", (F.coalesce("base", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("place")))


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, length: int = 4096, weights: dict[str, float] | None = None,
         window: int | None = None, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset)``, one row for each piece: ``length``
    ids (little-endian, unsigned, 32 bits) from ``start`` of the document lie at ``offset`` of the sequence.

    ``weights``: target shares by source, by default those of the corpus.  ``window``: tokens of a round, by
    default a sequence.  A null or empty text is the end id alone; null sources are the source ''; repeated rows
    and ids are packed each for itself; an empty table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_folder(spark, "packing")
    encode_rows(docs, vocabulary_path, end_id, id, text, source).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    placed = place(rows.select("part", "row", "queue", "n"), weights, window or length)
    both = rows.select("part", "row", "id", "n", "ids").join(placed, ["part", "row"])

    def run(batches):
        dtype = encoder(vocabulary_path).dtype
        for batch in bounded(batches, "ids", HELD_BYTES):
            out = []
            for doc, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "ids", "place"))):
                start, ids = 0, np.frombuffer(ids, dtype).astype("<u4").tobytes()
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, ids[4 * start:4 * (start + size)], n, sequence, offset))
                    start += size
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield record_batch(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)})

    return both.select("id", "n", "ids", "place").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


@llm_query("op5_mixture_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens, in the corpus's own mixture."""
    pieces = pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
