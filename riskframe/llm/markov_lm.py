"""Hidden Markov language model over word classes.

The most frequent words (``own_classes``) and the end of a text are classes of their own; all other words share
``shared_classes``, by a hash of their last two bytes.  A hidden state emits a class, and a class a word by its
smoothed training count.  Baum-Welch runs as a job for each round: every task turns its texts, in segments of
``SEGMENT`` classes, into expected transition, emission and start counts, which are summed by key; only these
(states x classes numbers, fixed by parameters) reach the driver.  Rounds go on until the likelihood of a token
gains less than ``tolerance``.  A text's score is exact: one scaled forward recursion over the whole text.

Word counts cover all training texts and grow with the corpus, so they stay a distributed table.  Counts of the
``HEAD`` most frequent words (a bounded set: a count above a cut, at most 64 bytes long) travel with the tasks; the
rest of each text's words meets the table in a join, where no word is frequent.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.session import cut_lineage, scratch_folder

#: The end of a text as a word: no word holds a space.
END = b" "
#: Most words whose counts travel with the tasks.
HEAD = 200_000
#: Classes of a training sequence.
SEGMENT = 512


def lower_ascii(texts: pa.LargeStringArray) -> pa.Array:
    """A-Z in lower case, without nulls.  (``pc.ascii_lower`` gives wrong text for an array that is a slice.)"""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts) or bounds[0] == bounds[-1]:
        return texts
    own = _LOWER[np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(own))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> pa.Array:
    """Lists of words (``[^\\x20\\x09-\\x0D]+``), A-Z in lower case, as binary values; null is empty."""
    split = pc.ascii_split_whitespace(lower_ascii(pc.fill_null(texts.cast(pa.large_string()), "")))
    return pa.LargeListArray.from_arrays(split.offsets.cast(pa.int64()), split.values.cast(pa.large_binary()))


def is_held_out(id) -> bool:
    return zlib.crc32(("" if id is None else str(id)).encode()) % 7 == 2


def count_words(rows: DataFrame) -> DataFrame:
    """``(word binary, n)`` over all texts that aren't held out, with one end each."""

    def run(batches):
        for batch in bounded(batches, "text", 8 << 20, 8192):
            train = [not is_held_out(i) for i in batch.column("id").to_pylist()]
            words = words_of(batch.column("text").filter(pa.array(train, pa.bool_())))
            counts = words.flatten().value_counts()
            word, n = counts.field("values"), counts.field("counts")
            some = pc.greater(pc.binary_length(word), 0)
            yield record_batch(word=word.filter(some).cast(pa.binary()), n=n.filter(some))
            yield record_batch(word=pa.array([END], pa.binary()), n=pa.array([sum(train)], pa.int64()))

    return rows.select("id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where("n > 0")


@dataclass
class Vocabulary:
    """Head words with counts, in descending order, and the sums that scores need."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    #: Words that are classes of their own; the end is the first.
    owners: dict[bytes, int]
    #: Tokens and distinct words of each shared class.
    shared_tokens: np.ndarray
    shared_words: np.ndarray

    @property
    def own(self) -> int:
        return len(self.owners)

    @property
    def shared(self) -> int:
        return len(self.shared_tokens)

    def shares(self) -> np.ndarray:
        """Share of each class, none of them zero."""
        own = np.zeros(self.own)
        for word, n in zip(self.words, self.counts):
            if word in self.owners:
                own[self.owners[word]] = n
        counts = np.concatenate([own, self.shared_tokens]) + 1
        return counts / counts.sum()


def suffix_class(words: pa.Array, shared: int) -> np.ndarray:
    """Shared class of each word, by its last two bytes."""
    ends = pc.binary_slice(words, -2).to_pylist()
    known: dict[bytes, int] = {}
    return np.fromiter((known[e] if e in known else known.setdefault(e, zlib.crc32(e) % shared) for e in ends),
                       np.int64, len(ends))


def vocabulary_of(counts: DataFrame, own_classes: int, shared_classes: int, head: int = HEAD) -> Vocabulary:
    power = F.floor(F.log2("n"))
    short = F.octet_length("word") <= 64
    sizes = sorted(counts.groupBy(power.alias("p")).agg(
        F.count_if(short), F.sum("n"), F.count(F.lit(1))).collect(), key=lambda r: -r[0])
    cut, held = None, 0
    for p, n, _, _ in sizes:  # at most 64 rows
        if held + n > head:
            break
        cut, held = p, held + n
    rows = counts.where(short & (power >= cut)).collect() if cut is not None else []
    rows = sorted(((bytes(r[0]), r[1]) for r in rows), key=lambda r: (-r[1], r[0]))
    words, n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    owners = {w: i for i, w in enumerate([END, *(w for w in words[:own_classes + 1] if w != END)][:own_classes + 1])}

    def sums(batches):
        for batch in batches:
            word = batch.column("word")
            keep = np.array([w not in owners for w in word.to_pylist()], bool)
            word, n = word.filter(pa.array(keep)), np.asarray(batch.column("n"))[keep]
            group = suffix_class(word, shared_classes)
            both = np.bincount(group, n, shared_classes), np.bincount(group, minlength=shared_classes)
            yield record_batch(g=pa.array(range(shared_classes), pa.int32()), n=pa.array(both[0].astype(np.int64)),
                               v=pa.array(both[1].astype(np.int64)))

    found = counts.mapInArrow(sums, "g int, n long, v long").groupBy("g").agg(F.sum("n"), F.sum("v")).collect()
    tokens, distinct = np.zeros(shared_classes), np.zeros(shared_classes)
    for g, n_, v in found:
        tokens[g], distinct[g] = n_, v
    return Vocabulary(words, n, sum(r[2] for r in sizes), sum(r[3] for r in sizes), owners, tokens, distinct)


def encode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(row, id, held_out, n_tokens, known, logs, words, classes, tail)`` of every text: ``known`` and ``logs`` count
    head words and sum their log10(c + 1); ``words`` is the log10 of what the classes give to words, but for the
    tail's log10(c + 1); ``tail`` has all other words with how often they stand in the text."""
    shared_broadcast = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared_broadcast.value
        head = pa.array(v.words, pa.large_binary())
        log = np.log10(v.counts + 1.0)
        end = v.words.index(END) if END in v.words else -1
        shared_logs = np.log10(v.shared_tokens + v.shared_words + 1)
        own_class = np.array([v.owners.get(w, -1) for w in v.words], np.int64)
        head_class = np.where(own_class >= 0, own_class, v.own + suffix_class(head, v.shared)) if len(head) else own_class
        for batch in bounded(batches, "text", 6 << 20, 8192):
            texts = words_of(batch.column("text"))
            bounds = np.asarray(texts.offsets)
            flat = texts.values.slice(bounds[0], bounds[-1] - bounds[0])
            bounds = bounds - bounds[0]
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            some = np.asarray(pc.binary_length(flat)) > 0
            flat, doc = flat.filter(pa.array(some)), doc[some]
            at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=head), -1)).astype(np.int64)
            known = at >= 0
            classes = np.empty(len(flat), np.int64)
            classes[known] = head_class[at[known]]
            tail = flat.filter(pa.array(~known))
            classes[~known] = v.own + suffix_class(tail, v.shared)
            lm = np.where(classes >= v.own, -shared_logs[np.maximum(classes - v.own, 0)], 0.0)
            logs = np.zeros(len(flat))
            logs[known] = log[at[known]]
            lm += np.where(classes >= v.own, logs, 0.0)
            docs = len(texts)
            n = np.bincount(doc, minlength=docs)
            edge = np.concatenate([[0], np.cumsum(n)])
            coded = [np.append(classes[a:b], 0).astype("<u2").tobytes() for a, b in zip(edge, edge[1:])]
            end_log = log[end] if end >= 0 else np.nan
            tail_doc, tail_words = doc[~known], tail.to_pylist()
            tails: list[dict] = [{} for _ in range(docs)]
            for d, w in zip(tail_doc.tolist(), tail_words):
                tails[d][w] = tails[d].get(w, 0) + 1
            if end < 0:
                for t in tails:
                    t[END] = 1
            yield record_batch(
                row=batch.column("row"), id=batch.column("id"),
                held_out=pa.array([is_held_out(i) for i in batch.column("id").to_pylist()], pa.bool_()),
                n_tokens=pa.array(n + 1), known=pa.array(np.bincount(doc, known, docs).astype(np.int64) + (end >= 0)),
                logs=pa.array(np.bincount(doc, logs, docs) + (end_log if end >= 0 else 0.0)),
                words=pa.array(np.bincount(doc, lm, docs).astype(float)), classes=pa.array(coded, pa.binary()),
                tail=pa.array([list(t.items()) for t in tails], pa.map_(pa.binary(), pa.int32())))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, logs double, "
                                "words double, classes binary, tail map<binary, int>")


@dataclass
class HiddenMarkov:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # states x classes

    @staticmethod
    def first(states: int, shares: np.ndarray, seed: int = 7) -> HiddenMarkov:
        """Emissions near the classes' shares, each state another way off."""
        rng = np.random.default_rng(seed)
        emits = shares * (0.5 + rng.random((states, len(shares))))
        moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 0.0)
        return HiddenMarkov(np.full(states, 1 / states), moves / moves.sum(axis=1, keepdims=True),
                            emits / emits.sum(axis=1, keepdims=True))

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
        """Expected starts, moves and emissions of the sequences, their log-likelihood and number of tokens; all
        sequences advance together, the longest first."""
        sequences = sorted((s for s in sequences if len(s)), key=len, reverse=True)
        k, c = self.emits.shape
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
        if not sequences:
            return starts, moves, emits.T, 0.0, 0
        sizes = np.array([len(s) for s in sequences])
        steps = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
        grid = np.zeros((steps, len(sequences)), np.int64)
        for i, s in enumerate(sequences):
            grid[:len(s), i] = s
        by_class = np.ascontiguousarray(self.emits.T)
        alpha, scale, seen = [], [], []
        for t in range(steps):
            n = active[t]
            b = by_class[grid[t, :n]]
            a = (self.start if t == 0 else alpha[-1][:n] @ self.moves) * b
            s = a.sum(axis=1)
            alpha.append(a / s[:, None])
            scale.append(s)
            seen.append(b)
        likelihood = sum(float(np.log(s).sum()) for s in scale)
        beta, gammas = np.ones((active[-1], k)), [None] * steps
        for t in range(steps - 1, -1, -1):
            gammas[t] = alpha[t] * beta
            if t:
                ahead = seen[t] * beta / scale[t][:, None]
                moves += alpha[t - 1][:active[t]].T @ ahead
                beta = np.concatenate([ahead @ self.moves.T, np.ones((active[t - 1] - active[t], k))])
        moves *= self.moves
        starts = gammas[0].sum(axis=0)
        codes = np.concatenate([grid[t, :active[t]] for t in range(steps)])
        gamma = np.concatenate(gammas)
        for state in range(k):
            emits[:, state] = np.bincount(codes, gamma[:, state], c)
        return starts, moves, emits.T, likelihood, len(codes)

    def likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        out = np.zeros(len(sequences))
        sizes = np.array([len(sequences[i]) for i in order])
        if not len(sizes) or not sizes[0]:
            return out
        flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        by_class, alpha, log = np.ascontiguousarray(self.emits.T), None, np.zeros(len(order))
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")
        for t, n in enumerate(active.tolist()):
            a = (self.start if t == 0 else alpha[:n] @ self.moves) * by_class[flat[begins[:n] + t]]
            s = a.sum(axis=1)
            alpha = a / s[:, None]
            log[:n] += np.log10(s)
        out[order] = log
        return out


def fit(encoded: DataFrame, shares: np.ndarray, states: int, rounds: int, tolerance: float, strength: float = 50.0
        ) -> tuple[HiddenMarkov, list[float]]:
    """Model, and the log-likelihood of a token before each round; ``strength`` is the weight, in tokens, of the
    classes' shares in every state."""
    model, history = HiddenMarkov.first(states, shares), []
    k, c = model.emits.shape
    train = encoded.where("NOT held_out").select("classes")
    for _ in range(rounds):
        def run(batches, model=model):
            sums = np.zeros(k + k * k + k * c + 2)
            for batch in bounded(batches, "classes", 1 << 20, 1 << 16):
                texts = (np.frombuffer(x, "<u2") for x in batch.column("classes").to_pylist())
                parts = [x[i:i + SEGMENT] for x in texts for i in range(0, len(x), SEGMENT)]
                starts, moves, emits, likelihood, n = model.expected(parts)
                sums += np.concatenate([starts, moves.ravel(), emits.ravel(), [likelihood, n]])
            yield record_batch(i=pa.array(range(len(sums)), pa.int32()), v=pa.array(sums))

        sums = np.zeros(k + k * k + k * c + 2)
        for i, value in train.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            sums[i] = value
        if not sums[-1]:
            break
        history.append(sums[-2] / sums[-1])
        starts, moves, emits = sums[:k] + 1, sums[k:k + k * k].reshape(k, k) + 1, sums[k + k * k:-2].reshape(k, c)
        emits = emits + strength * shares
        model = HiddenMarkov(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True),
                             emits / emits.sum(axis=1, keepdims=True))
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    return model, history


def score(docs: DataFrame, states: int = 6, own_classes: int = 4000, shared_classes: int = 95, rounds: int = 12,
          tolerance: float = 0.01, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row: log10 probabilities of the
    whole text under add-one word counts (``base_score``) and under the model.

    Trained on rows whose crc32 of the id, as text, has no remainder 2 by 7 (a null id is '').  A null or empty
    text is its end alone; repeated rows and ids are counted and scored each for itself; an empty table gives an
    empty table, and without training rows every word is unknown; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"),
                       F.col(text).cast("string").alias("text"))
    counts = cut_lineage(count_words(rows))
    vocabulary = vocabulary_of(counts, own_classes, shared_classes)
    path = scratch_folder(spark, "word-classes")
    encode(rows, vocabulary).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.parquet(path)

    model, _ = fit(encoded, vocabulary.shares(), states, rounds, tolerance)
    final = spark.sparkContext.broadcast(model)

    def forward(batches):
        for batch in bounded(batches, "classes", 6 << 20, 1 << 16):
            found = final.value.likelihoods([np.frombuffer(x, "<u2") for x in batch.column("classes").to_pylist()])
            names = [n for n in batch.schema.names if n != "classes"]
            yield record_batch(**{n: batch.column(n) for n in names}, states=pa.array(found))

    kind = encoded.schema["id"].dataType.simpleString()
    scored = encoded.drop("tail").mapInArrow(
        forward, f"row long, id {kind}, held_out boolean, n_tokens long, known long, logs double, words double, states double")
    tail = (encoded.select("row", F.explode("tail").alias("word", "times")).join(counts, "word", "left")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_logs"),
                                F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known")))
    rest = F.coalesce("tail_logs", F.lit(0.0))
    scale = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rest - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("states") + F.col("words") + rest).alias("score"))


@llm_query("op9_hidden_markov_lm")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents."""
    return score(table(spark, folder, "documents"))
