"""Exact Jaccard self-join of word shingle sets by signature trees.

Two documents link when ``100 * intersection >= percent * union``.  Equal sets are one node from the start.

1. Blocks.  Shingles are dealt into buckets; what a set has in a bucket is a token.  Sets that link differ in few
   shingles, d at most, and so in d tokens at most: the first d + 1 tokens of either, in one order, have one in common
   (``first_tokens``).  Sets with such a token in common, and sizes of one grade, and what hangs together by that, are a
   block.  The order follows counts of all shingles by hash bucket: any order is right, and the better it is, the fewer
   sets meet that do not link.  Sizes are graded so that sets that link have a grade in common.  No pair is lost, and
   no pair is listed: the sets with a token in common only point to the smallest of them.  Under ``LEAST_TOKENS`` percent
   single shingles take the place of tokens.
2. Leaves.  A block is cut into leaves of about ``LEAF`` sets.  Every leaf is searched together with a few pivots of
   its block, which ties most of a family of copies together, over all leaves.
3. Trees.  Where a block is still in several parts, sets are cut into leaves again, large parts by themselves.  Nodes of a
   signature tree hold the OR (and the AND) of their sets' token bitmaps and the range of sizes.  A dual traversal
   visits pairs of nodes from the roots down and drops those whose largest possible overlap is too small, or that
   are tied together already.  Pairs of leaves that are left exchange bitmaps of their sets; sets that may have a partner by
   these are joined, and searched.

A search counts common shingles, those in many sets by products of token indicator matrices, after documents without a possible partner are sorted out by
bitmaps; it returns a spanning forest of the links it finds.  So a family of copies, however large, is held by no
single task and never expanded into pairs, but every link between different parts of a block is found.

A text is read three times, and once more if it is in a block (in a large one, a few times); the text itself is only shuffled if there are more than
``BROADCAST_ROWS`` sets in blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.components import components, gathered
from riskframe.llm.markov_lm import words_of
from riskframe.llm.registry import llm_query, table
from riskframe.llm.skew import salted_join
from riskframe.session import cut_lineage

#: Sets of a leaf, pivots of a block, bits of a token bitmap, children of a tree node.
LEAF, PIVOTS, BITS, FAN = 1024, 8, 1024, 8
#: Bits of the bitmap of a single set, at most.
MOST_MAP = 1 << 16
#: Shingles in more sets of a search than this are counted by matrix product, the others pair by pair.
DENSE = 24
#: Rows of a search that are compared at a time.
STRIP = 256
#: Buckets for each shingle in which sets that link may differ; percents from which on shingles are compared by buckets.
SPREAD, LEAST_TOKENS = 2, 70
#: The part of leaves that hold sets of several small parts.
MIXED = -1
#: Bytes of text that a task turns into shingles at a time, and keys that it combines before they are shuffled.
HELD_BYTES, HELD_KEYS = 1 << 20, 1 << 18
#: Keys that are compared in one task, about.
BUCKET_KEYS = 2_000_000
#: The table of how common shingles are has at most two to this power entries, of a byte: what it costs does not grow.
MOST_BITS = 20
#: Sets in blocks up to which their documents are found by a broadcast.
BROADCAST_ROWS = 1_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xbf58476d1ce4e5b9)
    x = (x ^ (x >> _U(27))) * _U(0x94d049bb133111eb)
    return x ^ (x >> _U(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values: a sum of mixed (byte, place) pairs, mixed with the length."""
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    sizes = np.diff(bounds)
    data = words.buffers()[2]
    out = sizes.astype(_U)
    if data is not None and bounds[-1] > bounds[0]:
        codes = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].astype(_U)
        place = np.arange(len(codes)) - np.repeat(bounds[:-1] - bounds[0], sizes)
        values = mix(codes + (place.astype(_U) + _U(1)) * _U(0x9e3779b97f4a7c15))
        some = np.flatnonzero(sizes)
        out[some] += np.add.reduceat(values, (bounds[:-1] - bounds[0])[some])
    return mix(out)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and the text each belongs to."""
    lists = words_of(texts)
    bounds = np.asarray(lists.offsets)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    some = np.asarray(coded.indices) if len(coded) else np.empty(0, np.int64)
    sizes = np.asarray(pc.binary_length(coded.dictionary)) if len(coded) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    full = sizes[some] > 0 if len(some) else np.empty(0, bool)
    some, doc = some[full], doc[full]
    if not len(some):
        return np.empty(0, _U), np.empty(0, np.int64)
    word = word_hashes(coded.dictionary)[some]
    count = np.bincount(doc, minlength=len(texts))
    found, owner = [], []
    if len(word) >= words:
        shingle = word[:len(word) - words + 1].copy()
        for i in range(1, words):
            shingle = mix(shingle) + word[i:len(word) - words + 1 + i]
        inside = doc[:len(shingle)] == doc[words - 1:]
        found.append(mix(shingle[inside]))
        owner.append(doc[:len(shingle)][inside])
    starts = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < words)):
        shingle = np.zeros(1, _U)
        for i in range(starts[d], starts[d] + count[d]):
            shingle = mix(shingle) + word[i:i + 1]
        found.append(mix(shingle + count[d:d + 1].astype(_U)))
        owner.append(np.array([d]))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[first], owner[first]


def set_ids(found: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of each text's set; equal sets have equal ids."""
    sizes = np.bincount(owner, minlength=texts)
    ids = np.zeros(texts, _U)
    if len(found):
        some = np.flatnonzero(sizes)
        ids[some] = mix(np.add.reduceat(mix(found + _U(0x632be59bd9b4e019)), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(_U))
    return sizes, ids.view(np.int64)


def bucket_counts(rows: DataFrame, words: int, bits: int) -> np.ndarray:
    """How common the shingles of each of ``2 ** bits`` hash buckets are, on a logarithmic scale of bytes.

    A task counts its texts into one table, of which pieces are added up by their number; the driver gets a byte for each bucket."""
    pieces = min(1 << bits, 64)

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in bounded(batches, "text", HELD_BYTES, 4096):
            found, _ = shingle_sets(batch.column("text"), words)
            np.add(total, np.bincount((found >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), out=total, casting="unsafe")
        if total.any():
            # Half precision in the square root keeps a piece small and large counts apart; of a small task only what it counted is sent.
            parts = np.split(np.sqrt(total).astype(np.float16), pieces)
            where = [np.flatnonzero(x).astype(np.uint16) for x in parts]
            some = [2 * len(w) < len(x) for w, x in zip(where, parts)]
            yield record_batch(piece=pa.array(range(pieces), pa.int32()),
                               at=pa.array([w.tobytes() if few else None for w, few in zip(where, some)], pa.binary()),
                               n=pa.array([(x[w] if few else x).tobytes() for x, w, few in zip(parts, where, some)], pa.binary()))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, at, n in zip(batch.column("piece").to_pylist(), batch.column("at").to_pylist(), batch.column("n")):
                part = np.frombuffer(n.as_buffer(), np.float16).astype(np.float64) ** 2
                total = sums.setdefault(piece, np.zeros((1 << bits) // pieces))
                if at is None:
                    total += part
                else:
                    total[np.frombuffer(at, np.uint16)] += part
        for piece, n in sums.items():
            scaled = np.minimum(np.rint(6 * np.log2(1 + n)), 255).astype(np.uint8)
            yield record_batch(piece=pa.array([piece], pa.int32()), n=pa.array([scaled.tobytes()], pa.binary()))

    counted = rows.select("text").mapInArrow(count, "piece int, at binary, n binary").repartition(pieces, "piece")
    table_ = np.zeros((pieces, (1 << bits) // pieces), np.uint8)
    for piece, n in counted.mapInArrow(add, "piece int, n binary").collect():
        table_[piece] = np.frombuffer(n, np.uint8)
    return table_.ravel()


@lru_cache(maxsize=8)
def grades(percent: int) -> np.ndarray:
    """Smallest size of each grade: sets that link are of one grade, or of two that follow each other."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low)


def first_shingles(found, owner, sizes, ids, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which sets that link have one in common, and the set each belongs to: the first shingles of a set in order
    of how common they are, with its grade, and, as the larger one of a pair, with the grade below."""
    bits = int(len(common)).bit_length() - 1
    order = np.lexsort((found, common[(found >> _U(64 - bits)).astype(np.int64)], owner))
    rank = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = rank < (sizes - (percent * sizes + 99) // 100 + 1)[owner]
    shingle, owner = found[order][first], owner[first]
    grade = np.searchsorted(grades(percent), sizes, "right").astype(_U)[owner]  # from 1
    keys = [mix(shingle + mix(grade - _U(below))) for below in (0, 1)]
    return np.concatenate(keys), np.concatenate([ids[owner]] * 2)


def first_tokens(found, owner, sizes, ids, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which sets that link have one in common, and the set each belongs to.

    Shingles are dealt by hash into buckets, about ``SPREAD`` for each shingle in which linking sets may differ and one more;
    all that a set has in a bucket is a token.  Sets that differ in d shingles have all tokens but d in common, so the first
    d + 1 tokens of either, in one order, have one in common: those of rare shingles, and of many, come first.  The number of
    buckets is that of a grade of the smaller set; a set has the tokens of its own grade and, as the larger one, of the grade below.
    """
    bits = int(len(common)).bit_length() - 1
    rarity = int(common.max()) + 1 - common[(found >> _U(64 - bits)).astype(np.int64)].astype(np.int64)
    low, keys, sets = grades(percent), [], []

    def most_apart(a, b):  # sets of these sizes that link differ in so many shingles at most
        return (a + b) * (100 - percent) // (100 + percent)

    grade = np.searchsorted(low, sizes, "right")  # from 1
    for below in (0, 1):
        own, least = np.maximum(grade - below, 0), low[np.maximum(grade, 1) - 1]
        apart = most_apart(sizes, least - 1 if below else 100 * sizes // percent)
        some = (own > 0) & (apart > 0) & (100 * (least - 1) >= percent * sizes if below else True)
        top = low[own] - 1
        width = SPREAD * (most_apart(top, 100 * top // percent) + 1)
        salt = mix(own.astype(_U) + _U(1))
        inside = some[owner]
        of, shingle = owner[inside], found[inside]
        place = of << 32 | (shingle % width.astype(_U)[of]).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
        if len(starts):
            of = of[order][starts]
            token = mix(np.add.reduceat(mix(shingle[order] + _U(0x8cb92ba72f3d8dd7)), starts) + salt[of])
            weight = np.add.reduceat(rarity[inside][order], starts)
            order = np.lexsort((token, -weight, of))
            of, token = of[order], token[order]
        else:
            of, token = np.empty(0, np.int64), np.empty(0, _U)
        number = np.bincount(of, minlength=len(sizes))
        first = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) <= apart[of]
        keys.append(token[first])
        sets.append(ids[of[first]])
        for s in np.flatnonzero(some & (number <= apart)):  # empty buckets are tokens too, the last ones
            lo, hi = np.searchsorted(place, [s << 32, (s + 1) << 32])
            empty = np.setdiff1d(np.arange(width[s]), place[lo:hi] & 0xffffffff).astype(_U)
            keys.append(np.sort(mix(mix(empty + _U(0x2545f4914f6cdd1d)) + salt[s]))[:apart[s] + 1 - number[s]])
            sets.append(np.full(len(keys[-1]), ids[s]))
    return np.concatenate(keys), np.concatenate(sets)


def first_keys(found, owner, sizes, ids, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of either kind: where sets that link may differ in nearly all shingles, buckets would hold less than one."""
    return (first_tokens if percent >= LEAST_TOKENS else first_shingles)(found, owner, sizes, ids, percent, common)


def stars(keys: np.ndarray, sets: np.ndarray):
    """Links of all sets with a key to the smallest, once each; and each key with its smallest set."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = sets[np.flatnonzero(first)][np.cumsum(first) - 1] if len(keys) else sets
    apart = sets != least
    return np.unique(np.stack([sets[apart], least[apart]], axis=1), axis=0), keys[first], sets[first]


def candidate_links(rows: DataFrame, words: int, percent: int, buckets: int, common: np.ndarray) -> DataFrame:
    """``(a, b)``: sets with a key in common, each linked to the smallest of them.  A task combines its keys before they
    are shuffled, so even one in all sets moves once for each ``HELD_KEYS`` of them."""

    shared = rows.sparkSession.sparkContext.broadcast(common)

    def deal(batches):
        held, size = [], 0
        for batch in bounded(batches, "text", HELD_BYTES, 4096):
            found, owner = shingle_sets(batch.column("text"), words)
            sizes, ids = set_ids(found, owner, batch.num_rows)
            held.append(first_keys(found, owner, sizes, ids, percent, shared.value))
            size += len(held[-1][0])
            if size >= HELD_KEYS:
                yield from dealt_out(held)
                held, size = [], 0
        if held:
            yield from dealt_out(held)

    def dealt_out(held):
        links, keys, sets = stars(*map(np.concatenate, zip(*held)))
        bucket = (keys >> _U(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, keys, sets = bucket[order], keys[order], sets[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, int)
        ends = np.append(starts[1:], len(bucket))
        out = [(int(bucket[a]), "keys", keys[a:b].tobytes(), sets[a:b].tobytes()) for a, b in zip(starts, ends)]
        if len(links):
            out.append((int(abs(links[0, 0])) % buckets, "links", np.ascontiguousarray(links[:, 0]).tobytes(),
                        np.ascontiguousarray(links[:, 1]).tobytes()))
        for i in range(0, len(out), 64):
            names, kinds = ("bucket", "kind", "x", "y"), (pa.int32(), pa.string(), pa.binary(), pa.binary())
            yield record_batch(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*out[i:i + 64]), kinds)})

    def meet(batches):
        keys, sets, links = [], [], []
        for batch in batches:
            for kind, x, y in zip(*(batch.column(c).to_pylist() for c in ("kind", "x", "y"))):
                if kind == "keys":
                    keys.append(np.frombuffer(x, _U))
                    sets.append(np.frombuffer(y, np.int64))
                else:
                    links.append(np.stack([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)], axis=1))
        if keys:
            links.append(stars(np.concatenate(keys), np.concatenate(sets))[0])
        if links:
            both = np.unique(np.concatenate(links), axis=0)
            for i in range(0, len(both), 1 << 16):
                yield record_batch(a=pa.array(both[i:i + (1 << 16), 0]), b=pa.array(both[i:i + (1 << 16), 1]))

    dealt = rows.select("text").mapInArrow(deal, "bucket int, kind string, x binary, y binary")
    return dealt.repartition(buckets, "bucket").select("kind", "x", "y").mapInArrow(meet, "a long, b long").distinct()


# Searching


def bitmap(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), BITS), bool)
    for row, s in zip(bits, sets):
        row[(s % _U(BITS)).astype(np.int64)] = True
    return bits


def possible(sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may link, by sizes and bitmaps: each bit of one that the other lacks is a shingle it lacks."""
    b = bits.astype(np.float32)
    lacks = b @ (1 - b).T
    out = np.empty(lacks.shape, bool)
    for at in range(0, len(sizes), STRIP):  # strips keep the temporaries small
        rows = slice(at, at + STRIP)
        most = np.minimum(sizes[rows, None] - lacks[rows], sizes[None, :] - lacks[:, rows].T)
        out[rows] = 100 * most >= percent * (sizes[rows, None] + sizes[None, :] - most)
    return out


def intersections(column: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many shingles (``column``) each two of ``n`` sets (``owner``) have in common."""
    order = np.lexsort((owner, column))
    column, owner = column[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.empty(0, np.int64)
    times = np.diff(np.append(starts, len(column)))
    common = np.zeros((n, n), np.float32)
    for d in np.unique(times[times <= DENSE]):
        held = owner[starts[times == d][:, None] + np.arange(d)]  # sets in ascending order
        pairs = [held[:, i] * n + held[:, j] for i in range(d) for j in range(i + 1, d)]
        if pairs:
            common += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)
    common += common.T
    many = times > DENSE
    wide = np.repeat(many, times)
    column, owner = np.repeat(np.cumsum(many) - 1, times)[wide], owner[wide]
    for a in range(0, int(many.sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((n, min(4096, int(many.sum()) - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        common += block @ block.T
    return common


def search(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the sets, as (id, smallest id of its tree)."""
    sizes = np.array([len(s) for s in sets])
    may = possible(sizes, bitmap(sets), percent)
    np.fill_diagonal(may, False)
    live = np.flatnonzero(may.any(axis=1))
    if not len(live):
        return []
    ids, sizes, sets = ids[live], sizes[live], [sets[i] for i in live]
    may = may[np.ix_(live, live)]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one set only is in no intersection
    column, owner = column[shared], owner[shared]
    common = intersections(column, owner, len(sets))
    strips = [slice(at, at + STRIP) for at in range(0, len(sets), STRIP)]
    for rows in strips:
        both = common[rows].astype(np.int64)
        may[rows] &= 100 * both >= percent * (sizes[rows, None] + sizes[None, :] - both)
    label = np.arange(len(sets))
    while True:  # least label among neighbours, until nothing changes
        near = [np.where(may[rows], label[None, :], len(sets)).min(axis=1) for rows in strips]
        least = np.minimum(label, np.concatenate(near))
        least = least[least]
        if (least == label).all():
            break
        label = least
    rank = pd.Series(ids).groupby(label).transform("min").to_numpy()
    return [(int(a), int(b)) for a, b in zip(ids, rank) if a != b]


class Node:
    """A node of a signature tree: one leaf, or up to ``FAN`` nodes."""

    def __init__(self, leaf, part, low, high, any_, all_, children=()):
        self.leaf, self.part, self.low, self.high, self.any, self.all, self.children = leaf, part, low, high, any_, all_, children

    @staticmethod
    def over(children: list[Node]) -> Node:
        part = children[0].part if len({c.part for c in children}) == 1 else None
        return Node(None, part, min(c.low for c in children), max(c.high for c in children),
                    np.logical_or.reduce([c.any for c in children]), np.logical_and.reduce([c.all for c in children]), children)


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether sets under the two nodes may link and aren't tied together yet."""
    if x.part is not None and x.part == y.part:
        return False
    if 100 * min(x.high, y.high) < percent * max(x.low, y.low):
        return False
    # Every set under x has the bits of x.all; those that no set under y has are shingles it lacks.
    most = min(x.high - int((x.all & ~y.any).sum()), y.high - int((y.all & ~x.any).sum()))
    return 100 * most >= percent * max(x.low, y.low)


def traverse(leaves: list[Node], percent: int):
    """Pairs of leaves that the dual traversal can't rule out."""
    level = sorted(leaves, key=lambda n: (n.part is None, n.part or 0, n.low))
    while len(level) > 1:
        level = [Node.over(level[i:i + FAN]) if len(level[i:i + FAN]) > 1 else level[i] for i in range(0, len(level), FAN)]
    stack = [(level[0], level[0])] if level else []
    while stack:
        x, y = stack.pop()
        if x is y:
            kids = list(x.children)
            stack += [(a, b) for i, a in enumerate(kids) for b in kids[i:]]
            if not kids and x.part is None:
                yield x.leaf, x.leaf
        elif may_link(x, y, percent):
            if not x.children and not y.children:
                yield x.leaf, y.leaf
            elif x.children and (not y.children or x.high - x.low >= y.high - y.low):
                stack += [(c, y) for c in x.children]
            else:
                stack += [(x, c) for c in y.children]


def leaves_of(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``leaf``: sets of equal ``keys`` and about equal size, dealt by hash into leaves of about ``LEAF`` sets.
    The numbers of sets meet them over salted keys, since a block may hold any share of them."""
    band = F.floor(F.log("n") / F.log(F.lit(1.1))).cast("int")
    total = sets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > LEAF)
    counts = sets.groupBy(*keys, band.alias("_band")).agg(F.count(F.lit(1)).alias("_n")).join(total, keys)
    joined = salted_join(sets.withColumn("_band", band), counts, [*keys, "_band"], "set")
    number = F.pmod(F.xxhash64("set"), F.ceil(F.col("_n") / LEAF))
    return joined.withColumn("leaf", F.when(F.col("_n").isNull(), -1).otherwise(F.col("_band").cast("long") * (1 << 32) + number)).drop("_band", "_n", "_all")


def forest(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links found by searching each group of ``(*keys, set, shingles)``: groups come as runs of sorted rows, so a
    task holds one group, and small groups cost nothing each."""

    def run(batches):
        held, ids, sets, links = None, [], [], []
        for batch in bounded(batches, "shingles", 16 << 20, 8192):
            names = [batch.column(k).to_pylist() for k in keys]
            for *key, i, s in zip(*names, batch.column("set").to_pylist(), batch.column("shingles").to_pylist()):
                if key != held:
                    if len(ids) > 1:
                        links += search(np.array(ids), sets, percent)
                    held, ids, sets = key, [], []
                    if len(links) > 1 << 14:
                        yield record_batch(a=pa.array([x for x, _ in links], pa.int64()), b=pa.array([y for _, y in links], pa.int64()))
                        links = []
                if i not in ids[-1:]:
                    ids.append(i)
                    sets.append(np.frombuffer(s, _U))
        if len(ids) > 1:
            links += search(np.array(ids), sets, percent)
        yield record_batch(a=pa.array([x for x, _ in links], pa.int64()), b=pa.array([y for _, y in links], pa.int64()))

    return (groups.select(*keys, "set", "shingles").repartition(*keys).sortWithinPartitions(*keys, "set")
            .mapInArrow(run, "a long, b long"))


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """``(block, part, leaf, set, n, bits)``: ``bits`` is a bitmap of two to four bits for each shingle of the set, ``MOST_MAP`` at most."""

    def run(batches):
        for batch in bounded(batches, "shingles", 8 << 20, 8192):
            out = []
            for s in batch.column("shingles"):
                shingles = np.frombuffer(s.as_buffer(), _U)
                bits = np.zeros(min(MOST_MAP, max(64, 1 << int(2 * len(shingles) - 1).bit_length())), bool)
                bits[(shingles % _U(len(bits))).astype(np.int64)] = True
                out.append(np.packbits(bits).tobytes())
            yield record_batch(**{c: batch.column(c) for c in ("block", "part", "leaf", "set", "n")}, bits=pa.array(out, pa.binary()))

    return sets.select("block", "part", "leaf", "set", "n", "shingles").mapInArrow(
        run, "block long, part long, leaf long, set long, n long, bits binary")


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits from a larger one of the same set."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size // 8), axis=0)


def partnered(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """``(*keys, set)``: the sets of each group of ``(*keys, set, n, bits)`` that may link with another one of it."""

    def live(key, ids, sizes, bits):
        size = min(len(b) for b in bits) * 8
        packed = np.stack([folded(b, size) for b in bits])
        sizes, lacks = np.array(sizes), np.zeros((len(ids), len(ids)), np.float32)
        for at in range(0, size // 8, 512):
            b = np.unpackbits(packed[:, at:at + 512], axis=1).astype(np.float32)
            lacks += b @ (1 - b).T
        some = np.zeros(len(ids), bool)
        for at in range(0, len(ids), STRIP):
            rows = slice(at, at + STRIP)
            most = np.minimum(sizes[rows, None] - lacks[rows], sizes[None, :] - lacks[:, rows].T)
            may = 100 * most >= percent * (sizes[rows, None] + sizes[None, :] - most)
            may[np.arange(len(may)), np.arange(at, at + len(may))] = False
            some[rows] = may.any(axis=1)
        chosen = [i for i, keep in zip(ids, some) if keep]
        return record_batch(**{k: pa.array([v] * len(chosen), pa.int64()) for k, v in zip(keys, key)}, set=pa.array(chosen, pa.int64()))

    def run(batches):
        held, ids, sizes, bits = None, [], [], []
        for batch in bounded(batches, "bits", 16 << 20, 8192):
            columns = [batch.column(c).to_pylist() for c in (*keys, "set", "n", "bits")]
            for *key, i, n, b in zip(*columns):
                if key != held:
                    if len(ids) > 1:
                        yield live(held, ids, sizes, bits)
                    held, ids, sizes, bits = key, [], [], []
                if i not in ids[-1:]:
                    ids.append(i)
                    sizes.append(n)
                    bits.append(b)
        if len(ids) > 1:
            yield live(held, ids, sizes, bits)

    schema = ", ".join(f"{k} long" for k in keys) + ", set long"
    return groups.select(*keys, "set", "n", "bits").repartition(*keys).sortWithinPartitions(*keys, "set").mapInArrow(run, schema)


def tree_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``(block, i, j)``: leaves of a block that may hold links between parts, from ``(block, part, leaf, n, shingles)``.
    Summaries of leaves are 256 bytes; those of one block meet in one task."""

    def summaries(batches):
        held: dict = {}
        for batch in bounded(batches, "shingles", 16 << 20, 8192):
            for block, part, leaf, n, s in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "leaf", "n", "shingles"))):
                bits = bitmap([np.frombuffer(s, _U)])[0]
                known = held.get((block, part, leaf))
                if known is None and len(held) >= 4096:
                    yield summary(held)
                    held = {}
                held[block, part, leaf] = (n, n, bits, bits) if known is None else (
                    min(known[0], n), max(known[1], n), known[2] | bits, known[3] & bits)
        if held:
            yield summary(held)

    def summary(held):
        rows = [(*k, v[0], v[1], np.packbits(v[2]).tobytes(), np.packbits(v[3]).tobytes()) for k, v in held.items()]
        names = ("block", "part", "leaf", "low", "high", "any", "all")
        return record_batch(**{n: pa.array(c, pa.binary() if n in ("any", "all") else pa.int64()) for n, c in zip(names, zip(*rows))})

    made = sets.select("block", "part", "leaf", "n", "shingles").mapInArrow(
        summaries, "block long, part long, leaf long, low long, high long, any binary, all binary")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: dict = {}
        for r in pdf.itertuples(index=False):
            any_, all_ = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (r.any, r.all))
            node = nodes.get((r.part, r.leaf))
            nodes[r.part, r.leaf] = Node((r.part, r.leaf), None if r.part == MIXED else r.part, r.low, r.high, any_, all_) if node is None else Node(
                node.leaf, node.part, min(r.low, node.low), max(r.high, node.high), any_ | node.any, all_ & node.all)
        out = [(int(pdf["block"].iloc[0]), *x, *y) for x, y in traverse(list(nodes.values()), percent)]
        return pd.DataFrame(out, columns=["block", "part_i", "i", "part_j", "j"], dtype="int64")

    return made.groupBy("block").applyInPandas(pairs, "block long, part_i long, i long, part_j long, j long")


def join(docs: DataFrame, words: int, percent: int, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row, and its columns ``keep``: the number of distinct shingles (``words`` words; a shorter text
    is one shingle), and the smallest id reachable by links, the own one included.

    Words are runs of characters other than ASCII white space; A-Z count in lower case.  Null and empty texts and
    texts of white space have no shingles, link with nothing, and are their own component.  Rows of equal ids are
    one document with several texts: each has its own size, and links of any are links of all.  A null id takes
    part like any other, and is the component only where no id is known.  An empty table gives an empty table;
    other columns are not read.
    """
    kept = {f"kept{i}": c for i, c in enumerate(keep)}
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"),
                       *(F.col(c).alias(k) for k, c in kept.items()))
    kinds = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in kept)

    def sizes(batches):
        for batch in bounded(batches, "text", HELD_BYTES, 4096):
            found, owner = shingle_sets(batch.column("text"), words)
            n, ids = set_ids(found, owner, batch.num_rows)
            yield record_batch(id=batch.column("id"), n=pa.array(n, pa.int64()), set=pa.array(ids, pa.int64()),
                               **{k: batch.column(k) for k in kept})

    members = cut_lineage(rows.mapInArrow(sizes, f"id long, n long, set long{kinds}"))
    rows = rows.select("id", "text")
    nodes = cut_lineage(members.where("n > 0").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"),
                                                                F.count(F.lit(1)).alias("k")))
    tied = link_sets(rows, nodes, words, percent)
    # Ids with several texts tie their sets together.
    several = members.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(
        F.min("set").alias("a"), F.max("set").alias("b"), F.countDistinct("set").alias("k")).where("k > 1")
    ties = members.where("n > 0").join(several.select("id", F.col("a").alias("least")), "id").select(
        F.col("set").alias("a"), F.col("least").alias("b"))
    if several.limit(1).count():
        tied = components(tied.select(F.col("set").alias("a"), F.col("part").alias("b")).union(ties)).toDF("set", "part")
    least = nodes.join(tied, "set").groupBy("part").agg(F.min("rep").alias("component"))
    # A set of one row that nothing is tied to is its own component.
    of_set = nodes.select("set", "rep", "k").join(tied.join(least, "part"), "set", "left").where("k > 1 OR component IS NOT NULL").select(
        "set", F.coalesce("component", "rep").alias("component"))
    joined = salted_join(members, of_set, ["set"], "id")
    return joined.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce(
        F.when(F.col("n") > 0, F.least("component", "id")), "id").alias("component_id"),
        *(F.col(k).alias(c) for k, c in kept.items()))


def texts_of(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of the sets ``wanted`` (found by their document ``rep``), with ``columns`` of it."""
    found = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return rows.join(found, rows["id"].eqNullSafe(found["rep"])).select(*columns, "text")


def blocks_of(rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """``(set, block)`` of the sets that may link with another.

    Sets in blocks of more than ``LEAF`` are dealt anew, with shingles counted in these sets only, which tells rare ones
    apart better, for as long as that spares a fifth of them."""
    every = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts, own, (before, shingles) = [], rows, every
    while True:
        bits = min(MOST_BITS, max(12, int(shingles // 32).bit_length()))
        keys = 2 * shingles * (100 - percent) // 100
        links = gathered(candidate_links(own, words, percent, max(12, keys // BUCKET_KEYS), bucket_counts(own, words, bits)))
        blocks = gathered(components(links).toDF("set", "block").join(nodes.select("set", "rep", "n"), "set"))
        big = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > LEAF).select("block", F.lit(True).alias("big"))
        blocks = gathered(salted_join(blocks, big, ["block"], "set"))
        many, shingles = blocks.where("big").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if many == 0 or many > 0.8 * before:
            parts.append(blocks.drop("big"))
            break
        parts.append(blocks.where("big IS NULL").drop("big"))
        # A text of the same document that isn't the wanted set may come along; it is sorted out below.
        before, large = many, blocks.where("big").drop("big", "block")
        own, nodes = texts_of(rows, large, []), large
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def link_sets(rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """``(set, part)`` of the sets that link with another: ``part`` is the smallest set it is tied to."""
    wanted = gathered(leaves_of(blocks_of(rows, nodes, words, percent), ["block"]))

    def sets_of(batches):
        for batch in bounded(batches, "text", HELD_BYTES, 4096):
            found, owner = shingle_sets(batch.column("text"), words)
            n, ids = set_ids(found, owner, batch.num_rows)
            ends = np.cumsum(n)
            keep = np.flatnonzero(ids == np.asarray(batch.column("set")))
            at = pa.array(keep)
            yield record_batch(block=batch.column("block").take(at), leaf=batch.column("leaf").take(at), set=pa.array(ids[keep], pa.int64()),
                               n=pa.array(n[keep], pa.int64()),
                               shingles=pa.array([found[ends[i] - n[i]:ends[i]].tobytes() for i in keep], pa.binary()))

    def read(some):
        return texts_of(rows, some, ["block", "leaf", "set"]).mapInArrow(sets_of, "block long, leaf long, set long, n long, shingles binary")

    alone = gathered(forest(read(wanted.where("leaf < 0")), ["block"], percent))
    if wanted.where("leaf >= 0").limit(1).count() == 0:
        return components(alone).toDF("set", "part")

    # Blocks of several leaves.
    sets = cut_lineage(read(wanted.where("leaf >= 0")))
    leaves = sets.groupBy("block", "leaf").agg(F.min("set").alias("least"))
    pivots = leaves.groupBy("block").agg(F.slice(F.sort_array(F.collect_list("least")), 1, PIVOTS).alias("p")).select(
        "block", F.explode("p").alias("set"))
    pivots = sets.join(pivots, ["block", "set"]).drop("leaf").dropDuplicates(["set"]).join(
        leaves.select("block", "leaf"), "block").select("block", "leaf", "set", "shingles")
    first = gathered(forest(sets.select("block", "leaf", "set", "shingles").union(pivots), ["block", "leaf"], percent))

    # Parts that are still apart.
    parts = components(first).toDF("set", "part")
    small_rows = sets.select("block", "set", "n").dropDuplicates(["set"])
    large = small_rows.join(parts, "set", "left").withColumn("part", F.coalesce("part", "set"))
    apart = large.groupBy("block").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("block")
    large = large.join(apart, "block", "left_semi")
    small = large.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > LEAF // 4).select(F.col("part").alias("own"))
    large = salted_join(large.withColumn("own", F.col("part")), small.withColumn("big", F.lit(True)), ["own"], "set")
    large = large.withColumn("part", F.when(F.col("big"), F.col("part")).otherwise(F.lit(MIXED).cast("long"))).drop("own", "big")
    large = leaves_of(large, ["block", "part"]).select("set", "part", "leaf")
    large = cut_lineage(sets.drop("leaf").join(large, "set").dropDuplicates(["set"]))
    pairs = gathered(tree_pairs(large, percent))
    side = lambda p, i: pairs.select("block", F.col(p).alias("part"), F.col(i).alias("leaf"), "part_i", "i", "part_j", "j")
    sides = side("part_i", "i").union(side("part_j", "j"))
    keys = ["block", "part_i", "i", "part_j", "j"]
    # Bitmaps are sent first, shingles only of sets that may have a partner by these.
    live = gathered(partnered(with_bitmaps(large).join(sides, ["block", "part", "leaf"]), keys, percent))
    second = forest(large.select("set", "shingles").join(live, "set"), keys, percent)
    return components(alone.union(first).union(second)).toDF("set", "part")


#: The same by brute force: all pairs that share a shingle, and everything reachable.
SQL_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS shingle FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
  reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN links ON a = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1"""


@llm_query("op7_signature_tree_join", SQL_OP7)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share nine tenths of their 3-word shingles."""
    return join(table(spark, folder, "documents"), words=3, percent=90)
