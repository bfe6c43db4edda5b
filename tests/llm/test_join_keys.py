"""Which sets the Jaccard join compares, and what components cost."""

import random

import numpy as np
import pytest

from riskframe.llm import components, jaccard_join


def sets_of(rng, percent):
    """Small families of sets that differ in about as many members as a link allows."""
    out = []
    for n in rng.choice([1, 2, 3, 5, 8, 9, 10, 12, 20, 50, 200, 1000], 6):
        base = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        out.append(base)
        for _ in range(5):
            apart = int(rng.integers(0, n * (100 - percent) // percent + 2))
            drop = min(int(rng.integers(0, apart + 1)), n - 1)
            out.append(np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 2**63, apart - drop).astype(np.uint64)]))
    return [np.unique(s) for s in out]


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_no_link_without_a_key(percent):
    rng, links = np.random.default_rng(percent), 0
    for _ in range(30):
        sets = sets_of(rng, percent)
        sizes, ids = np.array([len(s) for s in sets]), np.arange(len(sets))
        common = rng.integers(0, 200, 1 << 12).astype(np.uint8)
        keys, of = jaccard_join.first_keys(np.concatenate(sets), np.repeat(ids, sizes), sizes, ids, percent, common)
        own = [set(keys[of == i].tolist()) for i in ids]
        for i in ids:
            for j in ids[:i]:
                both = len(np.intersect1d(sets[i], sets[j]))
                if both < max(sizes[i], sizes[j]) and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    links += 1
                    assert own[i] & own[j]
    assert links > 200


def test_texts_with_a_passage_in_common_do_not_meet(spark):
    rng = random.Random(5)
    rows, passage = [], []
    for _ in range(40):
        rest = [f"w{rng.randrange(10**9)}" for _ in range(80)]
        rows.append((" ".join(passage + rest[:60] + rest[60:]),))
        passage = rest[60:]
    table = spark.createDataFrame(rows, "text string")
    assert jaccard_join.candidate_links(table, 3, 90, 12, np.zeros(1 << 12, np.uint8)).count() == 0


def test_few_links_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "gathered", None)  # what each round ends with
    links = [(i, i + 1) for i in range(1, 500)] + [(1000, i) for i in range(1001, 1200)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 501)} | {i: 1000 for i in range(1000, 1200)}


def test_many_links_go_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 16)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 200)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 200)}
