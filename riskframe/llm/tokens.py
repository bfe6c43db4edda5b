"""Token ids of whole texts, equal to the ``tokenizers`` library's, a batch of texts at a time.

Both kinds of vocabulary part a text at white space before any merge, so a text is cut into units that never
influence each other (words, with their leading space in byte-level vocabularies).  Arrow splits a batch and finds
its distinct units; each is encoded once, all of plain letters together as arrays, the others by the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskframe.llm.merges import UnitMerger

#: White space, as an RE2 class (fixed values).
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters that are white space to some engines only, and the one that marks units.
_ODD = r"[\x{0}\x{1c}-\x{1f}\x{180e}]"


class LibraryEncoder:
    """``ids(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Special tokens written in a text become their ids, as in the library.  Null and empty texts have no ids.
    Vocabularies with word ends drop white space.  With the others the word pattern looks ahead in white space, and
    texts with three of them in a row, or two at the end, are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.merger = UnitMerger(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        odd = _ODD if self.merger.word_ends else rf"{_SPACE}{{3}}|{_SPACE}{{2}}\z|{_ODD}"
        self.whole = "|".join([odd, *map(re.escape, self.special)])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def alone(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, or units, that need no cut at white space."""
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in out]

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more entry: the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.asarray(pc.match_substring_regex(texts, self.whole))
        ids, ends = self._by_units(texts.filter(pa.array(~whole)) if whole.any() else texts)
        if not whole.any():
            return ids, ends
        parts, k = [], 0
        for text, alone in zip(texts, whole):
            if alone:
                parts.append(self._with_special(text.as_py()))
            else:
                parts.append(ids[ends[k]:ends[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _with_special(self, text: str) -> np.ndarray:
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        return np.concatenate([np.array([self.special[p]], self.dtype) if p in self.special else self.alone([p])[0]
                               for p in parts if p])

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.merger.word_ends:
            split = pc.utf8_split_whitespace(texts)
        else:  # a unit begins at each space and line feed
            split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n"), " ", "\0 "), "\0")
        bounds = split.offsets.to_numpy()
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        index = coded.indices.to_numpy()
        source, sizes = self._units(coded.dictionary)
        counts = sizes[index]
        ends = np.cumsum(counts)
        ids = source[spread(np.cumsum(sizes) - sizes, sizes, index, ends)]
        return ids, np.concatenate([[0], ends])[bounds - bounds[0]]

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has."""
        ids, sizes, plain = self.merger.encode(units)
        other = np.flatnonzero(~plain)
        if not len(other):
            return ids.astype(self.dtype), sizes
        alone = self.alone(units.take(pa.array(other)).to_pylist())
        sizes[other] = [len(a) for a in alone]
        out, ends = np.empty(sizes.sum(), self.dtype), np.cumsum(sizes)
        out[spread(ends - sizes, sizes, np.flatnonzero(plain))] = ids
        out[spread(ends - sizes, sizes, other)] = np.concatenate(alone)
        return out, sizes


def spread(begins: np.ndarray, sizes: np.ndarray, index: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Places ``begins[i] ... begins[i] + sizes[i] - 1`` for each ``i`` of ``index``, one after the other."""
    counts = sizes[index]
    ends = np.cumsum(counts) if ends is None else ends
    return np.repeat(begins[index] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=4)
def encoder(path: str) -> LibraryEncoder:
    """One encoder for each vocabulary and worker process."""
    return LibraryEncoder(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
