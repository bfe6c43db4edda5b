"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover all of it.  Learned filters slide over a chunk's
bytes; the largest answer of each filter in the chunk is kept.  A document combines its chunks by each filter's mean, largest and
smallest answer over them, which a logistic unit turns into one probability.

Training is data-parallel.  A bounded sample of labelled texts is dealt over ``PARTS`` tasks by hash; in each round
every task goes on from the shared weights over its own texts (mini-batches, Adam), and the weights of all tasks are
averaged.  Only weights move.  A task holds a few chunks at a time, however long a text is: of a text, pooled answers
and where they were found are kept, and gradients flow to those places alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.session import cut_lineage

#: Places of a chunk where filters begin, and how far chunks lie apart.
CHUNK, STEP = 512, 448
#: Bytes a filter sees, numbers that stand for a byte, filters.
WIDTH, DEPTH, FILTERS = 6, 6, 24
#: Neighbouring places that are multiplied as one row.
TOGETHER = 4
#: What stands for no byte.
PAD = 256
#: Chunks that are multiplied at a time.
STRIP = 128
#: Texts the network is fitted on at most, about, none of them longer (in bytes) than this.
SAMPLE, SAMPLE_BYTES = 4000, 1 << 18
#: Tasks of a round, mini-batches of a task and round, texts and bytes of a mini-batch, size of a step.
PARTS, BATCHES, BATCH, BATCH_BYTES, RATE = 8, 40, 16, 1 << 19, 0.02


class Chunks:
    """Chunks of all texts, in order; an empty or null text is one chunk without bytes."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.codes = np.append(np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8), [0])
        bounds, self.docs = bounds - bounds[0], len(texts)
        self.count = np.maximum(1, -(-(np.diff(bounds) - (CHUNK - STEP)) // STEP))
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(self.docs), self.count)
        self.start = bounds[:-1][self.doc] + STEP * (np.arange(len(self.doc)) - self.first[self.doc])
        self.end = bounds[1:][self.doc]

    def __len__(self) -> int:
        return len(self.doc)

    def at(self, rows, places: np.ndarray) -> np.ndarray:
        """Bytes at ``places`` of the chunks ``rows``; ``PAD`` behind a text's end."""
        shape = (-1,) + (1,) * (places.ndim - 1)
        where = self.start[rows].reshape(shape) + places
        inside = where < self.end[rows].reshape(shape)
        return np.where(inside, self.codes[np.where(inside, where, 0)], np.int16(PAD))


#: Bytes that filters see of a chunk, for the last places too.
_PLACES = np.arange(CHUNK + WIDTH - 1)[None]


def logistic(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    bytes_: np.ndarray  # PAD + 1 x DEPTH, the last row zero
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 * FILTERS: mean, largest, smallest
    base: np.ndarray  # one number

    @staticmethod
    def first(share: float, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        own = (rng.standard_normal((PAD + 1, DEPTH)) * 0.5).astype(np.float32)
        own[PAD] = 0
        filters = (rng.standard_normal((WIDTH * DEPTH, FILTERS)) * (1.4 / np.sqrt(WIDTH * DEPTH))).astype(np.float32)
        return Network(own, filters, np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32),
                       np.array([np.log(share / (1 - share))], np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.bias, self.weights, self.base]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def answers(self, chunks: Chunks, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest answer in each chunk, and where it is."""
        best = np.empty((len(chunks), FILTERS), np.float32)
        place = np.empty((len(chunks), FILTERS), np.int64) if where else None
        # One product gives the answers at TOGETHER neighbouring places: the filters, each moved on by a byte.
        moved = np.zeros(((WIDTH + TOGETHER - 1) * DEPTH, TOGETHER * FILTERS), np.float32)
        for i in range(TOGETHER):
            moved[i * DEPTH:(i + WIDTH) * DEPTH, i * FILTERS:(i + 1) * FILTERS] = self.filters
        for at in range(0, len(chunks), STRIP):
            part = chunks.at(slice(at, at + STRIP), _PLACES)
            x = self.bytes_.take(part.ravel(), axis=0).reshape(len(part), -1)
            windows = np.lib.stride_tricks.sliding_window_view(x, len(moved), axis=1)[:, ::DEPTH * TOGETHER]
            out = (moved.T @ windows.reshape(-1, len(moved)).T).reshape(TOGETHER, FILTERS, len(part), -1)
            most = out.max(axis=3)
            best[at:at + STRIP] = most.max(axis=0).T
            if where:
                first = most.argmax(axis=0)
                row = np.take_along_axis(out.argmax(axis=3), first[None], axis=0)[0]
                place[at:at + STRIP] = (row * TOGETHER + first).T
        return np.tanh(best + self.bias), place

    def pooled(self, answers: np.ndarray, chunks: Chunks) -> np.ndarray:
        """Mean, largest and smallest answers of each document."""
        mean = np.add.reduceat(answers, chunks.first, axis=0) / chunks.count[:, None].astype(np.float32)
        return np.concatenate([mean, np.maximum.reduceat(answers, chunks.first, axis=0),
                               np.minimum.reduceat(answers, chunks.first, axis=0)], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text."""
        if not len(texts):
            return np.zeros(0)
        chunks = Chunks(texts)
        return logistic((self.pooled(self.answers(chunks)[0], chunks) @ self.weights + self.base[0]).astype(np.float64))

    def gradient(self, texts: pa.Array, labels: np.ndarray) -> np.ndarray:
        """Gradient of the texts' mean log-loss, in the order of ``flat``."""
        chunks, n = Chunks(texts), len(labels)
        answers, place = self.answers(chunks, True)
        pools = self.pooled(answers, chunks)
        off = (logistic(pools @ self.weights + self.base[0]) - labels) / n
        each = off[:, None] * self.weights[None]
        mean, high, low = each[:, :FILTERS], each[:, FILTERS:2 * FILTERS], each[:, 2 * FILTERS:]
        back = (mean / chunks.count[:, None])[chunks.doc]
        for part, value in ((high, pools[:, FILTERS:2 * FILTERS]), (low, pools[:, 2 * FILTERS:])):
            same = answers == value[chunks.doc]  # ties share
            back = back + np.where(same, (part / np.add.reduceat(same, chunks.first, axis=0, dtype=np.int64))[chunks.doc], 0)
        back = back * (1 - answers ** 2)  # chunks x filters
        seen = chunks.at(slice(None), place[:, None, :] + np.arange(WIDTH)[None, :, None])  # chunk, byte, filter
        inputs = self.bytes_[seen]  # chunk, byte, filter, depth
        filters = np.einsum("mf,mwfd->wdf", back, inputs, optimize=True).reshape(WIDTH * DEPTH, FILTERS)
        ahead = back[:, None, :, None] * self.filters.reshape(WIDTH, DEPTH, FILTERS).transpose(0, 2, 1)[None]
        own = np.stack([np.bincount(seen.ravel(), ahead[..., d].ravel(), PAD + 1) for d in range(DEPTH)], axis=1)
        own[PAD] = 0
        return np.concatenate([own.ravel(), filters.ravel(), back.sum(axis=0), pools.T @ off, [off.sum()]])


def round_of(network: Network, state: np.ndarray, steps: int, texts: list, labels: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """``BATCHES`` mini-batches of Adam over the texts, in random order and as often as need be.  ``state`` (weights, mean
    gradient, mean square) goes in, ``steps`` mini-batches old, and comes out."""
    flat, first, second = state.copy()
    rng, queue = np.random.default_rng(seed), []
    for n in range(steps + 1, steps + BATCHES + 1):
        batch, size = [], 0
        while len(batch) < BATCH and (not batch or size < BATCH_BYTES):
            queue = queue or rng.permutation(len(texts)).tolist()
            batch.append(queue.pop())
            size += len(texts[batch[-1]] or "")
        slope = network.like(flat).gradient(pa.array([texts[i] for i in batch], pa.large_string()), labels[batch])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        flat = flat - RATE * (first / (1 - 0.9 ** n)) / (np.sqrt(second / (1 - 0.99 ** n)) + 1e-8)
    return np.stack([flat, first, second])


def is_held_out(id: Column) -> Column:
    """Rows that nothing is learned from; a null id counts as ''."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, text, label)``: labelled texts for the fit, dealt into ``PARTS``.

    Ids are taken in order of a hash, then rows by another, so that an id on any share of the rows keeps to the bound.  Texts over
    ``SAMPLE_BYTES`` aren't taken.  Labels of an id that disagree count as 1 where half of them do."""
    known = labels.where("id IS NOT NULL AND label IS NOT NULL").where(~is_held_out(F.col("id")))
    ids = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    ids = cut_lineage(ids.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE))
    rows = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES).join(F.broadcast(ids), "id")
    n = rows.select("id").count()
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(13))
    rows = rows.select("id", "text", "label", row.alias("row"))
    if n > SAMPLE:
        rows = rows.where(F.pmod("row", F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
    part = F.pmod(F.xxhash64("id", "row"), F.lit(PARTS)).cast("int")
    return cut_lineage(rows.select(part.alias("part"), "row", "text", "label").repartition(PARTS, "part").sortWithinPartitions("part", "row"))


def fit(docs: DataFrame, labels: DataFrame, rounds: int, seed: int) -> Network:
    """Network fitted on a sample of the rows ``(id, text)`` whose id has a label; without labels, or with labels of one kind, every
    text has the share of label 1, with one more label of either kind."""
    rows = sampled(docs, labels)
    ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    network = Network.first((ones + 1) / (n + 2), seed)
    if not 0 < ones < n:
        return network
    state = np.stack([network.flat(), *np.zeros((2, network.flat().size))])
    for number in range(rounds):
        def run(batches, state=state, number=number):
            parts: dict[int, tuple[list, list]] = {}
            for batch in batches:
                for part, text, label in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "label"))):
                    texts, marks = parts.setdefault(part, ([], []))
                    texts.append(text)
                    marks.append(label)
            for part, (texts, marks) in parts.items():
                after = round_of(network, state, number * BATCHES, texts, np.array(marks, np.float32), (seed, number, part))
                yield record_batch(part=pa.array([part], pa.int32()), n=pa.array([len(texts)], pa.int64()), state=pa.array([after.tobytes()], pa.binary()))

        # A state for each part: a bounded number of bounded rows.
        found = sorted(rows.mapInArrow(run, "part int, n long, state binary").collect())
        state = np.average([np.frombuffer(f["state"]).reshape(state.shape) for f in found], axis=0, weights=[f["n"] for f in found])
    return network.like(state[0])


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, rounds: int = 8, id: str = "doc_id", text: str = "text",
             label: str = "quality", seed: int = 7) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row: the probability that its label is 1, and whether it is at least ``least``.

    Learned from ``(id, label)`` rows of ``labels`` (0 or 1) whose crc32 of the id, as text, isn't divisible by 5; of a document
    only the text's bytes count.  Null and empty texts have a score like any other; a null id has no label and counts as held out;
    repeated rows are scored each; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    final = docs.sparkSession.sparkContext.broadcast(fit(rows, known, rounds, seed))

    def run(batches):
        for batch in bounded(batches, "text", 2 << 20, 2048):
            yield record_batch(id=batch.column("id"), score=pa.array(final.value.scores(batch.column("text"))))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@llm_query("op11_quality_network")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
