"""Spelling variants by composition of finite-state machines.

Words that are one inserted, deleted or replaced character apart are near.  With the minimised acceptor ``A`` of the
vocabulary and a transducer ``E`` of exactly one edit, near words are the pairs that ``A . E . A`` accepts: both sides
walk the same states, one edit leads to two states, and from there both must accept the same rest.

The machine is enumerated by partitions of its initial states, none of which holds the whole vocabulary.  Near words,
the shorter of ``m`` characters, share their first ``m // 2`` characters or their last ``m - m // 2``: the edit is
behind the ones or before the others.  So words are grouped by either end, once as the shorter and once as the longer word, and a
group's acceptor has the rest of its words.  A group of more than ``GROUP`` words is parted again, by the ends of
the rests, until it is small or its words differ in one or two characters: so groups are bounded, however common a
beginning or an end is, and no pair is lost.  A pair counts in one group only.  Groups send a row for each word, never the pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.llm.skew import salted_join
from riskframe.session import cut_lineage

#: Words of a group that is not parted again.
GROUP = 2000
#: One run in so many, by its checksum, loses a character (fixed value).
DAMAGED = 199
#: Longest run, in bytes, whose checksums are computed as arrays.
ARRAYS = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> np.uint32(1)) ^ np.uint32(0xEDB88320), values >> np.uint32(1))
    return values


_CRC = _crc_table()


def runs_of(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different runs of letters (``[A-Za-z\\u00C0-\\u00FF]+``, A-Z in lower case) of at least ``least`` characters; which
    one each run is, the text it is in, and the number of characters of the different runs."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    empty = np.empty(0, np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return pa.array([], pa.large_binary()), empty, empty, empty
    codes = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    first = codes == 0xC3  # U+00C0 to U+00FF are C3 and any following byte
    inside = _LETTER[codes] | first
    inside[1:] |= first[:-1]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(codes)]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    ends = np.flatnonzero(closes) + 1
    wide = np.concatenate([[0], np.cumsum(first, dtype=np.int32)])
    long = ends - starts - (wide[ends] - wide[starts]) >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return pa.array([], pa.large_binary()), empty, empty, empty
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[codes[place]])]).dictionary_encode()
    words = found.dictionary
    which = np.asarray(found.indices).astype(np.int64)
    length = np.empty(len(words), np.int64)
    length[which] = sizes - (wide[ends] - wide[starts])
    return words, which, np.searchsorted(bounds, starts, "right") - 1, length


def checksums(words: pa.Array, which: np.ndarray, doc: np.ndarray, ids: list) -> np.ndarray:
    """crc32 of ``<id>:<run>`` of each run; a null id is ''.

    A checksum that goes on from another differs from one that starts anew by what the other becomes over as many
    zero bytes, so words and ids are each summed once."""
    own = np.array([zlib.crc32(w) for w in words.to_pylist()], np.uint32)
    sizes = np.asarray(pc.binary_length(words)).astype(np.int64)
    state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    out = np.empty(len(which), np.uint32)
    size = sizes[which]
    order = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[order], np.arange(ARRAYS + 2))
    moved = state
    for n in range(1, ARRAYS + 1):
        moved = (moved >> np.uint32(8)) ^ _CRC[moved & np.uint32(255)]
        some = order[bounds[n]:bounds[n + 1]]
        out[some] = own[which[some]] ^ moved[doc[some]]
    for i in order[bounds[ARRAYS + 1]:].tolist():
        out[i] = zlib.crc32(words[int(which[i])].as_py(), int(state[doc[i]]))
    return out


def count_words(docs: DataFrame, least: int, times: int, id: str, text: str) -> DataFrame:
    """``(word, n)``: words of at least ``least`` characters that stand at least ``times`` times in all texts."""

    def run(batches):
        for batch in bounded(batches, "text", 6 << 20, 8192):
            words, which, doc, length = runs_of(batch.column("text"), least)
            if not len(which):
                continue
            sums = checksums(words, which, doc, batch.column("id").to_pylist())
            hit = sums % np.uint32(DAMAGED) == 0
            n = np.bincount(which[~hit], minlength=len(words))
            damaged: dict[str, int] = {}
            for w, h in zip(which[hit].tolist(), sums[hit].tolist()):
                word, at = words[w].as_py().decode(), h % int(length[w])
                word = word[:at] + word[at + 1:]
                if len(word) >= least:
                    damaged[word] = damaged.get(word, 0) + 1
            some = pa.array(n > 0)
            yield record_batch(word=words.filter(some).cast(pa.binary()).cast(pa.string()), n=pa.array(n[n > 0]))
            if damaged:
                yield record_batch(word=pa.array(list(damaged), pa.string()), n=pa.array(list(damaged.values()), pa.int64()))

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class Acceptor:
    """Minimised deterministic acceptor of words in ascending order; a state is listed after those it leads to."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.moves: list[dict[str, int]] = []
        known: dict = {}
        open_: list[list] = [[False, []]]  # states along the last word
        last = ""

        def close(depth: int) -> None:
            while len(open_) - 1 > depth:
                final, out = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], self._state(known, final, out)))

        for word in words:
            common, most = 0, min(len(last), len(word))
            while common < most and last[common] == word[common]:
                common += 1
            close(common)
            open_.extend([False, []] for _ in range(len(word) - common))
            open_[-1][0] = True
            last = word
        close(0)
        self.start = self._state(known, *open_[0])

    def _state(self, known: dict, final: bool, out: list) -> int:
        key = (final, tuple(out))
        if key not in known:
            known[key] = len(self.final)
            self.final.append(final)
            self.moves.append(dict(out))
        return known[key]

    def common(self, p: int, q: int, but: str = ""):
        """Words accepted from both states; none that begins with ``but``."""
        stack = [(p, q, "")]
        while stack:
            p, q, word = stack.pop()
            if self.final[p] and self.final[q]:
                yield word
            other = self.moves[q]
            for label, to in self.moves[p].items():
                if label in other and (word or label != but):
                    stack.append((to, other[label], word + label))

    def near(self) -> list[tuple[str, str]]:
        """Pairs of accepted words that are exactly one edit apart, once each; a shorter word is the first."""
        found: list[list[tuple[str, str]]] = []
        for state, moves in enumerate(self.moves):
            pairs = [(label + x, label + y) for label, to in moves.items() for x, y in found[to]]
            labels = list(moves.items())
            for i, (a, to) in enumerate(labels):
                for b, other in labels[i + 1:]:
                    pairs += [(a + rest, b + rest) for rest in self.common(to, other)]
                # An inserted character is the last of its run, so that a pair is found once.
                pairs += [(rest, a + rest) for rest in self.common(state, to, a)]
            found.append(pairs)
        return found[self.start]


def counts_here(path: str, m: int, x: str, y: str) -> bool:
    """Whether a pair counts in the group that ``path`` leads to: beginnings go before ends."""
    for step in path:
        half = m // 2
        if step == "P":
            x, y, m = x[half:], y[half:], m - half
        elif x[:half] == y[:half]:
            return False
        else:
            x, y, m = x[:len(x) - (m - half)], y[:len(y) - (m - half)], half
    return True


def parted(groups: DataFrame) -> DataFrame:
    """Rows ``(least, path, key, m, rest, word, n)`` in two smaller groups each: by the beginnings and the ends of the rests."""
    half, size = F.floor(F.col("m") / 2).cast("int"), F.length("rest")
    tail = F.col("m") - half
    begin = F.struct(F.concat("path", F.lit("P")).alias("path"), F.concat("key", F.lit("P"), F.substr("rest", F.lit(1), half)).alias("key"),
                     tail.alias("m"), F.substr("rest", half + 1).alias("rest"))
    end = F.struct(F.concat("path", F.lit("S")).alias("path"), F.concat("key", F.lit("S"), F.substr("rest", size - tail + 1)).alias("key"),
                   half.alias("m"), F.substr("rest", F.lit(1), size - tail).alias("rest"))
    return groups.withColumn("part", F.explode(F.array(begin, end))).select("least", "part.*", "word", "n")


def search(groups: DataFrame) -> DataFrame:
    """``(word, n_near, form_n, form)`` of the words of each group that have near words in it: their number, and the one of
    largest ``n``.  Groups come as runs of sorted rows, so a task holds one, and small groups cost nothing each."""

    def found(path, least, m, rows):
        if len(rows) < 2 or not any(len(rest) == m for rest in rows):
            return
        best: dict[str, list] = {}
        for x, y in Acceptor(sorted(rows)).near():
            if len(x) == m and counts_here(path, least, rows[x][0], rows[y][0]):
                for one, other in ((x, y), (y, x)):
                    word, n = rows[other]
                    held = best.get(one)
                    if held is None:
                        best[one] = [1, n, word]
                    else:
                        held[0] += 1
                        if (-n, word) < (-held[1], held[2]):
                            held[1:] = n, word
        for rest, row in best.items():
            yield (rows[rest][0], *row)

    def run(batches):
        held, rows, out = None, {}, []
        for batch in bounded(batches, "word", 1 << 20, 1 << 16):
            for key, path, least, m, rest, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "least", "m", "rest", "word", "n"))):
                if held is None or key != held[0]:
                    if held is not None:
                        out += found(*held[1:], rows)
                    held, rows = (key, path, least, m), {}
                    if len(out) > 1 << 14:
                        yield as_batch(out)
                        out = []
                rows[rest] = (word, n)
        if held is not None:
            out += found(*held[1:], rows)
        yield as_batch(out)

    def as_batch(rows):
        kinds = {"word": pa.string(), "n_near": pa.int64(), "form_n": pa.int64(), "form": pa.string()}
        columns = zip(*rows) if rows else ([] for _ in kinds)
        return record_batch(**{name: pa.array(list(c), kind) for (name, kind), c in zip(kinds.items(), columns)})

    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame, least: int) -> DataFrame:
    """``(word, n_near, form_n, form)`` of the words ``(word, n)`` that have near words: how many, the largest ``n``
    among them, and the first word that has it."""
    size = F.length("word")
    # Once as the shorter or an equal of a pair, once as the longer.
    groups = words.withColumn("m", F.explode(F.when(size > least, F.array(size, size - 1)).otherwise(F.array(size))))
    groups = parted(groups.select(F.col("m").alias("least"), F.lit("").alias("path"), F.col("m").cast("string").alias("key"), "m",
                                  F.col("word").alias("rest"), "word", "n"))
    parts = []
    while True:
        groups = cut_lineage(groups)
        large = cut_lineage(groups.where("m > 1").groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select(
            "key", F.lit(True).alias("large")))
        if large.limit(1).count() == 0:
            parts.append(search(groups))
            break
        groups = salted_join(groups, large, ["key"], "word")
        parts.append(search(groups.where("large IS NULL").drop("large")))
        groups = parted(groups.where("large").drop("large"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last word that forms lead to.  Jumps double each round."""
    jumps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = cut_lineage(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                      F.col("next").isNotNull().alias("moved")))
        if jumps.where("moved").limit(1).count() == 0:
            return jumps.select("word", "root")
        jumps = jumps.select("word", "root")


def variants(docs: DataFrame, least: int = 6, times: int = 5, ratio: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of at least ``least`` characters that stands at least ``times`` times.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case; where ``DAMAGED`` divides the crc32 of
    ``<id>:<run>``, the run lacks one character.  ``n_near`` counts the words one edit away; ``form`` is the most
    frequent of them (of equals the first), if it is at least ``ratio`` times as frequent, and ``form_n`` how often
    it stands; ``root`` is where forms lead in the end, a word without form its own.

    Null and empty texts have no words; a null id counts as ''; repeated rows and ids count each; words of any
    length have their groups; an empty table gives an empty table; other columns are not read.  ``least`` is at least 2.
    """
    words = cut_lineage(count_words(docs, least, times, id, text))
    near = near_words(words, least)
    is_form = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("form_n")).alias("form_n"))
    joined = cut_lineage(joined)
    last = roots(joined.where("form IS NOT NULL"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words by the words they have in common when one character is left out.
SQL_OP12 = r"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
  runs AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id, count(*) AS times FROM found WHERE length(run) >= 6 GROUP BY ALL),
  sums AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id, ''), lambda c: CASE WHEN unicode(c) < 128
    THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(c) - 64, 0, 0, 0, 0, 0, 0, 0] END))),
    lambda r, x: xor(xor(r, CAST(x AS BIGINT)) >> 1, 3988292384 * (xor(r, CAST(x AS BIGINT)) & 1))), 4294967295) AS h FROM runs),
  damaged AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM sums),
  words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
  cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  near AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
  placed AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near),
  best AS (SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.n >= 5 * w.n THEN p.other END AS form,
    CASE WHEN p.n >= 5 * w.n THEN p.n END AS form_n FROM words w LEFT JOIN placed p ON p.word = w.word AND p.place = 1),
  path AS (SELECT word, word AS root FROM words UNION ALL SELECT p.word, b.form FROM path p JOIN best b ON b.word = p.root WHERE b.form IS NOT NULL),
  ends AS (SELECT p.word, p.root FROM path p JOIN best b ON b.word = p.root WHERE b.form IS NULL)
SELECT b.word, b.form, e.root, b.n, b.n_near, b.form_n FROM best b JOIN ends e ON e.word = b.word"""


@llm_query("op12_spelling_variants", SQL_OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return variants(table(spark, folder, "documents"))
