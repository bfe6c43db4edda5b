import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from samples import documents, texts

from riskframe.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def is_near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute_words(rows, least, times):
    counts = Counter()
    for id, text in rows:
        for run in RUN.findall(lower(text)):
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def brute(rows, least=6, times=5, ratio=5):
    words = brute_words(rows, least, times)
    near = {w: [] for w in words}
    for x, y in combinations(words, 2):
        if abs(len(x) - len(y)) < 2 and is_near(x, y):
            near[x].append(y)
            near[y].append(x)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def family(seed, count):
    """Words a few edits from each other, some far more frequent than others."""
    rng = random.Random(seed)
    found = ["générations", "abababab", "aaaaaa", "aaaaaaa", "aabaaa"]
    while len(found) < count:
        w = list(rng.choice(found))
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(w))
            w[i:i + rng.randrange(2)] = rng.choice(["a", "b", "é", "aa", "", "÷"])
        found.append("".join(w))
    return found


def corpus(seed, count=150):
    rng = random.Random(seed)
    rows = []
    for i, w in enumerate(family(seed, count)):
        rows.append((10 + i, f" {w}, " * (5 ** rng.randrange(1, 4)) + f"9{w.upper()}9"))
    rows += [(900 + i, t) for i, t in enumerate(texts())] + [(None, "généra generation " * 9), (7, None), (7, "aaaaaa " * 3), (7, "aaaaaa " * 3), (8, "é" * 3000 + " " + "é" * 3001)]
    rows += [(2000, " ".join(["x" * 2000] * 5 + ["x" * 2001] * 30))]
    return rows


@pytest.mark.parametrize("group,least", [(2000, 6), (3, 6), (2, 2)])
def test_variants(spark, monkeypatch, group, least):
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = corpus(group + least)
    table = documents(spark, [(d, t, "en", "s") for d, t in rows]).limit(len(rows)).repartition(3)
    out = spelling.variants(table, least=least).collect()
    assert sorted(tuple(r) for r in out) == brute([(r.doc_id, r.text) for r in table.collect()], least)


def test_variants_of_nothing(nothing):
    assert spelling.variants(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_composition(seed):
    words = sorted(set(family(seed, 60)) | ({""} if seed % 2 else set()))
    machine = spelling.Acceptor(words)
    found = machine.near()
    assert sorted(machine.common(machine.start, machine.start)) == words
    assert all(len(x) <= len(y) for x, y in found)
    want = {frozenset((x, y)) for x, y in combinations(words, 2) if is_near(x, y)}
    assert {frozenset(p) for p in found} == want and len(found) == len(want)


def test_acceptor_is_minimal():
    machine = spelling.Acceptor(sorted(a + b for a in ("walk", "talk", "jump") for b in ("", "ed", "ing", "s")))
    rests = set()
    for state in range(len(machine.final)):
        rests.add(frozenset(machine.common(state, state)))
    assert len(rests) == len(machine.final)


def test_checksums_of_runs():
    array = pa.array(["x", *texts(), "Éé" * 50 + " straße naïve÷"])
    for part in (array, array.slice(3)):
        words, which, doc, length = spelling.runs_of(part, 2)
        ids = [None, *range(1, len(part))]
        sums = spelling.checksums(words, which, doc, ids).tolist()
        want = [(d, w, zlib.crc32(f"{'' if ids[d] is None else ids[d]}:{w}".encode())) for d, t in enumerate(part.to_pylist())
                for w in RUN.findall(lower(t)) if len(w) >= 2]
        assert [(d, words[w].as_py().decode(), s) for d, w, s in zip(doc.tolist(), which.tolist(), sums)] == want
        assert [len(w.decode()) for w in words.to_pylist()] == length.tolist()
