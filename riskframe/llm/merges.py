"""BPE merges of many short segments at once, as array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_NONE = np.int32(2**31 - 1)

def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by the published rule: printable
    Latin-1 characters stand for themselves, the others follow from code point 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Rank and result of a merge by its pair of ids: two hash tables, the second for collisions in the first."""

    BITS = 20

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.left = np.array([a for a, _ in merges], np.uint64)
        keys = (self.left << np.uint64(32)) | np.array([b for _, b in merges], np.uint64)
        self.values = np.array([*merges.values(), (_NONE, 0)], np.int32)
        rng = np.random.default_rng(7)
        while True:
            self.factors = rng.integers(1 << 60, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
            rest, self.tables = np.arange(len(keys)), []
            for factor in self.factors:
                entries = np.full(1 << self.BITS, len(keys), np.int32)
                slots = self._slot(keys[rest], factor)
                entries[slots] = rest
                self.tables.append(entries)
                rest = rest[entries[slots] != rest]
            if not len(rest):
                break
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def _slot(self, keys, factor):
        return (keys * factor) >> np.uint64(64 - self.BITS)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in ``values``; the last place where there is no merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        place = self.tables[0][self._slot(keys, self.factors[0])]
        miss = np.flatnonzero(self.keys[place] != keys)
        if len(miss):
            again = self.tables[1][self._slot(keys[miss], self.factors[1])]
            again[self.keys[again] != keys[miss]] = len(self.keys) - 1
            place[miss] = again
        return place


class BatchMerger:
    """Merges segments of ids by rank: each round joins, in every segment, all places of its best pair."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.table = PairTable(merges)

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids and the segments' new sizes; ``sizes`` are over 0."""
        ids, segment = ids.astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        values = self.table.values
        place = self._pairs(ids, segment, np.arange(len(ids)))
        done_ids, done_segments = [], []
        while len(ids):
            rank = values[place, 0]
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            finished = best == _NONE
            if finished.any():
                done_ids.append(ids[finished])
                done_segments.append(segment[finished])
                going = ~finished
                ids, segment, place, rank, best = ids[going], segment[going], place[going], rank[going], best[going]
                if not len(ids):
                    break
            chosen = np.flatnonzero(rank == best)
            close = np.diff(chosen) == 1
            if close.any():  # a run such as a a a: every second place, from the left
                first = np.concatenate([[True], ~close])
                offset = np.arange(len(chosen)) - np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
                chosen = chosen[offset % 2 == 0]
            ids[chosen] = values[place[chosen], 1]
            keep = np.ones(len(ids), bool)
            keep[chosen + 1] = False
            now = chosen - np.arange(len(chosen))
            ids, segment, place = ids[keep], segment[keep], place[keep]
            touched = np.zeros(len(ids), bool)
            touched[now] = touched[now[now > 0] - 1] = True
            changed = np.flatnonzero(touched)
            place[changed] = self._pairs(ids, segment, changed)
        order = np.concatenate(done_segments) if done_segments else np.empty(0, np.int32)
        merged = np.concatenate(done_ids) if done_ids else ids
        return merged[np.argsort(order, kind="stable")], np.bincount(order, minlength=len(sizes))

    def _pairs(self, ids, segment, at):
        """Places in the table of the pairs (i, i + 1) for i in ``at``."""
        last = len(self.table.values) - 1
        place = np.full(len(at), last, np.int32)
        inner = np.flatnonzero(at + 1 < len(ids))
        inner = inner[segment[at[inner]] == segment[at[inner] + 1]]
        place[inner] = self.table.find(ids[at[inner]], ids[at[inner] + 1])
        return place


#: Classes of bytes: white space, letters, digits, other characters, and those that need a closer look.
_BLANK, _LETTER, _DIGIT, _MARK, _UNSURE = range(5)


def byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8.  Two-byte letters of Latin alphabets are letters; an apostrophe may begin a
    contraction; all else beyond ASCII is unsure."""
    out = np.full(256, _UNSURE, np.int8)
    out[[ord(" "), ord("\n")]] = _BLANK
    for b in range(0x21, 0x7f):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    out[ord("'")] = _UNSURE
    out[0x80:0xc0] = out[0xc3:0xc9] = _LETTER
    return out


class UnitMerger:
    """Ids of units of plain letters by a vocabulary's own merges, as array operations over all of them.

    ``forced``: also cut between two bytes where ``forced[a, b]``.
    """

    #: Units of more bytes are left to others.
    LONGEST = 64

    def __init__(self, spec: dict, forced: np.ndarray | None = None):
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        letters = sorted(byte_letters().items(), key=lambda x: x[1])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = {}
        for rank, (a, b) in enumerate(pairs):
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.word_ends, self.forced = bool(suffix), forced
        self.inner = np.array([vocab[letter] for letter, _ in letters], np.int32)
        self.last = np.array([vocab[letter + suffix] for letter, _ in letters], np.int32)
        self.merger = BatchMerger(merges)
        self.classes = byte_classes()
        if self.word_ends:  # lower case is known here for ASCII and the letters from U+00C0 to U+00FF
            self.classes[0xc4:0xc9] = _UNSURE

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the plain units one after the other, how many each unit has, and which units are plain."""
        units = units.cast(pa.large_binary())
        bounds = np.frombuffer(units.buffers()[1], np.int64)[units.offset:units.offset + len(units) + 1]
        data = units.buffers()[2]
        codes = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
        sizes = np.diff(bounds)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        kinds = self.classes[codes]
        before, first = np.empty_like(codes), np.ones(len(codes), bool)
        before[1:] = codes[:-1]
        first[1:] = unit[1:] != unit[:-1]
        # Two letters' places hold signs, and the alphabets end within a lead byte.
        unsure = (kinds == _UNSURE) | (before == 0xc3) & ((codes == 0x97) | (codes == 0xb7)) | (before == 0xc8) & (codes > 0xb3)
        plain = (np.bincount(unit[unsure], minlength=len(units)) == 0) & (sizes <= self.LONGEST)
        keep = plain[unit]
        codes, kinds, unit, before, first = codes[keep], kinds[keep], unit[keep], before[keep], first[keep]
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(units), np.int64), plain
        changed = np.ones(len(codes), bool)
        changed[1:] = kinds[1:] != kinds[:-1]
        if self.word_ends:
            codes = codes.copy()
            codes[(codes >= 65) & (codes <= 90)] += 32
            codes[(before == 0xc3) & (codes >= 0x80) & (codes <= 0x9e) & ~first] += 32
            begins = first | changed | (kinds == _DIGIT)
        else:  # a leading space joins what follows; a line feed stands alone
            joins = np.zeros(len(codes), bool)
            joins[1:] = codes[:-1] == 32
            begins = first | changed & ~joins
        if self.forced is not None:
            begins[1:] |= self.forced[codes[:-1], codes[1:]]
        starts = np.flatnonzero(begins)
        ids = self.inner[codes]
        if self.word_ends:
            lasts = np.append(starts[1:], len(codes)) - 1
            ids[lasts] = self.last[codes[lasts]]
        merged, made = self.merger.merge(ids, np.diff(np.append(starts, len(codes))))
        return merged, np.bincount(unit[starts], made, len(units)).astype(np.int64), plain
