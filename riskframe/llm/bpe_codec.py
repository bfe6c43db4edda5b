"""BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be joined by a merge, so a cut between
the two is certain whatever stands around it (62,847 of the 65,536 pairs in the 50k byte vocabulary).  The text
is cut at such pairs, each fragment is merged on its own, and the ids are put together again:

* A character other than white space followed by a space is a certain cut: no token holds such a pair (but for
  the byte of a no-break space, where the vocabulary's word pattern cuts anyway).  So a text falls into words
  with their leading space, and each distinct word of a batch is encoded once.
* A word is cut by the vocabulary's own word pattern and then at every forced pair inside; the fragments of a
  batch are merged by rank, all at once.

Runs of white space are the one place where the pattern looks ahead across such a cut; texts with runs of
three or more, or two at the end, go through the pattern as a whole instead.

Everything works per row: no shuffle, and a task holds a bounded batch of texts.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.merges import UnitMerger, byte_letters
from riskframe.llm.registry import llm_query, table
from riskframe.llm.tokens import LibraryEncoder, vocabulary

#: The word pattern of byte-level vocabularies (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From here on, Unicode versions may class characters differently; the library's own splitter is asked.
_WIDE = re.compile("[^\x00-\x1b\x20-ɏ]")
#: Fragments of more bytes are merged with a heap.
_LONG = 64


class ForcedBoundaryCodec(LibraryEncoder):
    """Encodes by forced boundaries; of the library, it asks only the word splitter, for rare characters."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        if spec["model"].get("end_of_word_suffix"):
            raise ValueError("forced boundaries are defined for byte-level vocabularies")
        self.dtype = np.dtype("<u4")
        self.token_bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items()}
        #: forced[a, b]: no token holds byte a followed by byte b.
        self.forced = np.ones((256, 256), bool)
        for token in self.token_bytes.values():
            codes = np.frombuffer(token, np.uint8)
            self.forced[codes[:-1], codes[1:]] = False
        self.merger = UnitMerger(spec, self.forced)
        self.byte_ids = self.merger.inner
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.words = regex.compile(WORDS)
        self.splitter = self.tokenizer.pre_tokenizer
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.table = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]

    # Encoding

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null or empty texts."""
        return self.ids(text).tobytes()

    def batch_bytes(self, texts: pa.Array) -> list[bytes]:
        ids, ends = self.batch(texts)
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def alone(self, texts: list[str]) -> list[np.ndarray]:
        """Texts cut by the word pattern, then at every forced pair; short fragments are merged all at once, longer
        ones one by one."""
        fragments = [[f for word in self._split(text) for f in self._fragments(word)] for text in texts]
        flat = [f for fs in fragments for f in fs]
        short = [f for f in flat if len(f) <= _LONG]
        sizes = np.fromiter(map(len, short), np.int64, len(short))
        ids, sizes = self.merger.merger.merge(self.byte_ids[np.frombuffer(b"".join(short), np.uint8)], sizes)
        merged = iter(np.split(ids.astype(self.dtype), np.cumsum(sizes)[:-1]))
        encoded = iter([next(merged) if len(f) <= _LONG else self._merge_long(f) for f in flat])
        return [np.concatenate([next(encoded) for _ in fs]) if fs else np.empty(0, self.dtype) for fs in fragments]

    def _split(self, text: str) -> list[bytes]:
        if _WIDE.search(text):
            return [text[a:b].encode() for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return [word.encode() for word in self.words.findall(text)]

    def _fragments(self, word: bytes) -> list[bytes]:
        """``word`` cut at every forced pair."""
        if len(word) < 2:
            return [word]
        codes = np.frombuffer(word, np.uint8)
        cuts = (np.flatnonzero(self.forced[codes[:-1], codes[1:]]) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def _merge_long(self, fragment: bytes) -> np.ndarray:
        """The same merges in n log n: a heap of (rank, place) over a linked list."""
        ids: list[int | None] = self.byte_ids[list(fragment)].tolist()
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(heap)
        while heap:
            rank, merged, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or merges.get((ids[i], ids[j])) != (rank, merged):
                continue
            ids[i], ids[j] = merged, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if found := merges.get((merged, ids[after[j]])):
                    heapq.heappush(heap, (*found, i))
            if before[i] >= 0 and (found := merges.get((ids[before[i]], merged))):
                heapq.heappush(heap, (*found, before[i]))
        return np.array([i for i in ids if i is not None], self.dtype)

    # Decoding

    def decode(self, ids: bytes | None) -> str:
        """Text of the ids; special tokens are written out, bytes that aren't UTF-8 become U+FFFD."""
        if not ids:
            return ""
        codes = np.frombuffer(ids, "<u4")
        parts = (b"".join(map(self.table.__getitem__, codes[i:i + (1 << 18)].tolist()))
                 for i in range(0, len(codes), 1 << 18))
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids binary, decoded string)`` of every row: ids of the whole text as little-endian unsigned 32-bit
    integers, and the text decoded from them.

    Null and empty texts have no ids and decode to ''.  Null and repeated ids are kept, row by row; an empty
    table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        own = codec(path)
        for batch in bounded(batches, "text"):
            ids = own.batch_bytes(batch.column("text"))
            yield record_batch(id=batch.column("id"), ids=pa.array(ids, pa.binary()),
                               decoded=pa.array([own.decode(i) for i in ids], pa.string()))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids binary)``; see ``round_trip``."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        own = codec(path)
        for batch in bounded(batches, "text"):
            yield record_batch(id=batch.column("id"), ids=pa.array(own.batch_bytes(batch.column("text")), pa.binary()))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(id, decoded string)`` of rows with ids as ``encode`` makes them; null ids decode to ''."""
    rows = encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids"))

    def run(batches):
        own = codec(path)
        for batch in bounded(batches, "ids"):
            texts = [own.decode(i) for i in batch.column("ids").to_pylist()]
            yield record_batch(id=batch.column("id"), decoded=pa.array(texts, pa.string()))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id)


@llm_query("op3_bpe_forced_boundaries")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of ids and decoded text of every document."""
    out = round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
