"""Token ids in directly addressable files.

Format of a shard (all integers little-endian).  Ids are split into bytes.  Level 0 holds the lowest byte of
every id and one continuation bit for each: set if the id has more bytes.  Level 1 holds the next byte of the
ids whose bit is set, with their continuation bits, and so on; the last level has no bits set.  For each level a
rank directory holds the number of set bits before every block of 512 places, so that the place of a token's
next byte is one directory entry and a count over at most 512 bits: any token is read without decoding others.

A shard is one row ``(bucket, shard, bucket_start, n_docs, n_tokens, payload, doc_ids, sizes)`` of a Parquet
dataset: the payload is the bytes above, ``doc_ids`` and ``sizes`` (32-bit) its documents in order.  Buckets are
ranges of document ids, so (bucket, shard) is the order of the whole table.

Texts are encoded where they are read; only ids are shuffled, by bucket.  A task writes its buckets one after
the other as a stream of shards, whatever their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.llm.tokens import encoder, vocabulary
from riskframe.session import cut_lineage, scratch_folder

#: Places between two entries of a rank directory.
BLOCK = 512
#: A shard is closed at so many tokens; one longer document makes a longer shard.
SHARD_TOKENS = 1 << 18
#: Bytes that a writer holds back of a file, about; it looks at every row, as rows are large.
HELD_BYTES = 8 << 20
#: Lists that the requests for one shard are dealt into.
ASKED = 64
#: Documents in a bucket, but for the last; the number of buckets is bounded, as their totals go to the driver.
BUCKET_DOCS, MOST_BUCKETS = 4096, 65536
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned, up to 32 bits) in the format above."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(more) else np.zeros(0, "<u4")
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> np.uint32(8)
    head = np.array([len(levels), *(n for n, *_ in levels)], "<u4").tobytes()
    return head + b"".join(part for _, *parts in levels for part in parts)


class Codes:
    """Reader of one packed payload."""

    def __init__(self, payload: bytes):
        depth = int(np.frombuffer(payload, "<u4", 1)[0])
        counts = np.frombuffer(payload, "<u4", depth, 4).tolist()
        at, self.levels = 4 + 4 * depth, []
        for n in counts:
            level = []
            for kind, size in ((np.uint8, n), (np.uint8, -(-n // 8)), ("<u4", -(-n // BLOCK))):
                level.append(np.frombuffer(payload, kind, size, at))
                at += level[-1].nbytes
            self.levels.append(level)
        self.count = counts[0]

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        """One id, by one step for each of its bytes."""
        value = 0
        for depth, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << 8 * depth
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK * BLOCK
            before = int(_BITS[bits[block >> 3:i >> 3]].sum()) + int(_BITS[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i = int(ranks[i // BLOCK]) + before
        return value

    def all(self) -> np.ndarray:
        values = None
        for low, bits, _ in reversed(self.levels):
            own = low.astype("<u4")
            if values is not None:
                more = np.unpackbits(bits, bitorder="little", count=len(low)).astype(bool)
                own[more] |= values << np.uint32(8)
            values = own
        return values


def bucket_bounds(docs: DataFrame, id: str) -> list[int]:
    """Lowest ids of the buckets after the first, from approximate quantiles of the ids alone."""
    count = docs.select(F.count(id)).first()[0]
    buckets = min(MOST_BUCKETS, max(1, count // BUCKET_DOCS))
    if buckets == 1:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    return sorted(set(docs.select(F.percentile_approx(id, cuts, 10 * buckets)).first()[0]))


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, id: str = "doc_id",
                 text: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write the shards to ``path`` in ascending order of the
    integer ``id``.

    A null or empty text is the end id alone; rows with null ids come first; rows with equal ids are ordered by
    their ids' bytes.  An empty table writes an empty dataset.  Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    bounds = bucket_bounds(rows, "id")

    def encode(batches):
        own, edges = encoder(vocabulary_path), np.array(bounds, np.int64)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in bounded(batches, "text", 1 << 20, 4096):
            flat, ends = own.batch(batch.column("text"))
            ids = [flat[a:b].tobytes() + end for a, b in zip(ends, ends[1:])]
            del flat, ends
            doc = batch.column("id").to_pylist()
            bucket = [-1 if d is None else int(np.searchsorted(edges, d, "right")) for d in doc]
            yield record_batch(bucket=pa.array(bucket, pa.int32()), id=batch.column("id"), ids=pa.array(ids, pa.binary()))

    encoded = rows.mapInArrow(encode, "bucket int, id long, ids binary")
    encoded = encoded.repartition(F.col("bucket")).sortWithinPartitions("bucket", "id", "ids")

    def shards(batches):
        dtype = encoder(vocabulary_path).dtype
        held, tokens, bucket, shard, start = [], 0, None, 0, 0

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            return record_batch(
                bucket=pa.array([bucket], pa.int32()), shard=pa.array([shard], pa.int32()),
                bucket_start=pa.array([start], pa.int64()), n_docs=pa.array([len(held)], pa.int64()),
                n_tokens=pa.array([len(ids)], pa.int64()), payload=pa.array([pack(ids)], pa.binary()),
                doc_ids=pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                sizes=pa.array([[len(x) // dtype.itemsize for _, x in held]], pa.list_(pa.int32())))

        for batch in bounded(batches, "ids"):
            for b, d, x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "ids"))):
                if held and (b != bucket or tokens >= SHARD_TOKENS):
                    yield close()
                    start, shard = (start + tokens, shard + 1) if b == bucket else (0, 0)
                    held, tokens = [], 0
                bucket = b
                held.append((d, x))
                tokens += len(x) // dtype.itemsize
        if held:
            yield close()

    encoded.mapInArrow(shards, "bucket int, shard int, bucket_start long, n_docs long, n_tokens long, payload binary, "
                               "doc_ids array<long>, sizes array<int>").write.options(**{
        "parquet.block.size": HELD_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids binary, last)`` of every document in the files: ``start`` counts the ids of all documents
    before it, ``ids`` are 32-bit, ``last`` is the last of them, read by itself.  Only one total for each bucket goes to the driver."""
    files = spark.read.parquet(path)
    totals = sorted(files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    base, before = {}, 0
    for bucket, n in totals:
        base[bucket], before = before, before + n

    def run(batches):
        for batch in bounded(batches, "payload", 1 << 20, 64):
            for i in range(batch.num_rows):
                bucket, bucket_start = batch.column("bucket")[i].as_py(), batch.column("bucket_start")[i].as_py()
                codes = Codes(batch.column("payload")[i].as_buffer())
                ids, doc_ids = codes.all(), batch.column("doc_ids")[i].values
                at = np.concatenate([[0], np.cumsum(np.asarray(batch.column("sizes")[i].values), dtype=np.int64)])
                for a in range(0, len(doc_ids), 512):
                    b = min(a + 512, len(doc_ids))
                    yield record_batch(
                        doc_id=doc_ids.slice(a, b - a), start=pa.array(at[a:b] + bucket_start + base[bucket]),
                        ids=pa.array([ids[x:y].tobytes() for x, y in zip(at[a:b], at[a + 1:b + 1])], pa.binary()),
                        last=pa.array([codes[y - 1] for y in at[a + 1:b + 1].tolist()], pa.int64()))

    return files.select("bucket", "bucket_start", "payload", "doc_ids", "sizes").mapInArrow(
        run, "doc_id long, start long, ids binary, last long")


def lookup(spark: SparkSession, path: str, wanted: DataFrame, id: str = "doc_id", position: str = "position") -> DataFrame:
    """``(id, position, token)``: single tokens of documents in the files, read through the rank directories.

    Positions count from 0.  A position that a document has not, an unknown or null id and a null position have a null
    token; repeated requests have a row each, and one for each document of a repeated id.  Requests find their
    shard by a table of documents without payloads; of each shard its requests travel to it, in lists of at most ``ASKED``,
    so a shard that all ask for is read by many tasks.
    """
    files = spark.read.parquet(path)

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes")[i].values).astype(np.int64)
                many = len(sizes)
                yield record_batch(bucket=pa.array([batch.column("bucket")[i].as_py()] * many, pa.int32()),
                                   shard=pa.array([batch.column("shard")[i].as_py()] * many, pa.int32()), id=batch.column("doc_ids")[i].values,
                                   size=pa.array(sizes), at=pa.array(np.cumsum(sizes) - sizes))

    placed = files.select("bucket", "shard", "doc_ids", "sizes").mapInArrow(documents, "bucket int, shard int, id long, size long, at long")
    asked = wanted.select(F.col(id).cast("long").alias("id"), F.col(position).cast("long").alias("position"),
                          F.monotonically_increasing_id().alias("row"))
    found = asked.join(placed, "id", "left")
    inside = (F.col("position") >= 0) & (F.col("position") < F.col("size"))
    found = cut_lineage(found.withColumn("place", F.when(inside, F.col("at") + F.col("position"))).drop("at", "size"))
    lists = found.where("place IS NOT NULL").groupBy("bucket", "shard", F.pmod("row", F.lit(ASKED)).alias("part")).agg(
        F.collect_list(F.struct("id", "position", "place")).alias("asked"))

    def run(batches):
        for batch in bounded(batches, "payload", 1 << 20, 64):
            for i in range(batch.num_rows):
                codes = Codes(batch.column("payload")[i].as_buffer())
                rows = batch.column("asked")[i].as_py()
                yield record_batch(id=pa.array([r["id"] for r in rows], pa.int64()), position=pa.array([r["position"] for r in rows], pa.int64()),
                                   token=pa.array([codes[r["place"]] for r in rows], pa.int64()))

    read = lists.join(files.select("bucket", "shard", "payload"), ["bucket", "shard"]).select("asked", "payload").mapInArrow(
        run, "id long, position long, token long")
    none = found.where("place IS NULL").select("id", "position", F.lit(None).cast("long").alias("token"))
    return read.union(none).select(F.col("id").alias(id), F.col("position").alias(position), "token")


@llm_query("op10_addressable_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the token files of all documents and reads them back."""
    path = scratch_folder(spark, "token-files")
    write_tokens(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_documents(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"), F.col("last").alias("last_id"))
