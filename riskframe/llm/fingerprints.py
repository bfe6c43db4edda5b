"""Threshold-scaled sketches of documents.

A sketch keeps every shingle hash below a fixed share of the hash range (one in ``SCALE``), so its size follows the
document's, sketches of parts merge by union, and the overlap of two sketches estimates the containment of a
short document in a long one as well as their Jaccard similarity.  The smallest hash is always kept, so that
short texts have a sketch too.  Shingles are five lower-cased words; a shorter text is one shingle.

All of it is SQL expressions: no Python runs on the executors.  Each document meets the next one in
descending order of ids with one shuffle: documents go to buckets of 4,096 ids, with a copy of each bucket's first
document sent to the bucket above it, and a window inside the bucket looks one row ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskframe.llm.registry import llm_query, table

#: One hash in so many is kept.
SCALE = 8
LIMIT = -(1 << 63) + (1 << 64) // SCALE
#: Words of a shingle.
WORDS = 5
#: A bucket has 4,096 ids; the first ids of at most so many buckets are broadcast.
BUCKET_BITS, BROADCAST_ROWS = 12, 2_000_000


def hashed_words(text: Column) -> Column:
    """Hashes of the words of ``text``, in order."""
    trimmed = F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "))
    words = F.split(trimmed, " +")
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def shingles_of(words: str) -> Column:
    """Shingle hashes from the column named ``words`` of ``hashed_words``."""
    at = F.col(words)
    count = F.size(at) - (WORDS - 1)
    full = F.transform(F.slice(at, 1, F.greatest(count, F.lit(0))),
                       lambda x, i: F.xxhash64(x, *(F.get(at, i + k) for k in range(1, WORDS))))
    return F.when(count > 0, full).when(F.size(at) > 0, F.array(F.xxhash64(at))).otherwise(F.array().cast("array<bigint>"))


def kept(shingles: str) -> Column:
    """Sorted distinct hashes below the limit, or else the least."""
    below = F.array_sort(F.array_distinct(F.filter(shingles, lambda x: x < F.lit(LIMIT))))
    return F.when(F.array_min(shingles) < F.lit(LIMIT), below).otherwise(F.array_compact(F.array(F.array_min(shingles))))


def with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sketch of the column ``text`` as ``name`` (array of bigint); null texts have the empty one."""
    rows = rows.withColumn("_words", hashed_words(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_shingles", shingles_of("_words"))
    return rows.withColumn(name, kept("_shingles")).drop("_words", "_shingles")


def merged(a: str, b: str) -> Column:
    """Sketch of two documents put together, but for the shingles across the seam."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < F.lit(LIMIT))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: str, b: str) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds, whatever their sizes."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(sketch: str) -> Column:
    """Hexadecimal digits of the hashes, 16 each."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` by bucket, and copies of each bucket's first row (in descending order of ``id``) in the bucket of the
    row before it: columns ``_bucket`` and ``_copy``.  Null ids are a bucket below all others."""
    lowest = -(1 << 62)
    rows = rows.withColumn("_bucket", F.coalesce(F.shiftright("id", BUCKET_BITS), F.lit(lowest)))
    # One row for each bucket: its first id, and the bucket above.
    firsts = rows.groupBy("_bucket").agg(F.max("id").alias("_top"))
    least = firsts.agg(F.min("_bucket")).scalar()
    firsts = firsts.withColumn("_to", F.coalesce(F.lead("_bucket").over(W.orderBy("_bucket")), least))
    bounded = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    copies = rows.join(F.broadcast(firsts) if bounded else firsts, "_bucket").where(F.col("id").eqNullSafe(F.col("_top")))
    copies = copies.withColumn("_bucket", F.col("_to")).drop("_top", "_to")
    return rows.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the next row in descending order of ``id``, after the last the first, to rows of
    ``with_copies``.  Null ids come last; rows of equal ids are ordered by ``text``."""
    order = W.partitionBy("_bucket").orderBy("_copy", F.desc_nulls_last("id"), "text")
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_copy = 0").drop("_copy", "_bucket")


def compare(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_chars, edited, sketch, edited_sketch, near_edited, near_next)`` of every row: the text edited (its last
    third replaced by the start of the next document's text), the sketches of both, and how alike a document's
    sketch is to that of the edited text and of the next document.

    A null text is empty: it has no sketch, and is like an empty text only.  Repeated rows and ids are kept, a null
    id comes last; a lone document is its own next; an empty table gives an empty table; other columns are not
    read.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(with_copies(rows), "text", "sketch"), ["text", "sketch"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - third).cast("int")),
                                              F.substr("next_text", F.lit(1), third))).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(F.col("id").alias(id), "n_chars", "edited", "sketch", "edited_sketch",
                       likeness("sketch", "edited_sketch").alias("near_edited"),
                       likeness("sketch", "next_sketch").alias("near_next"))


@llm_query("op8_threshold_sketch")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare(table(spark, folder, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")
