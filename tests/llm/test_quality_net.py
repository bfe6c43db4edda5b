import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import documents, texts, words

from riskframe.llm import quality_net
from riskframe.llm.quality_net import CHUNK, DEPTH, FILTERS, PAD, STEP, WIDTH, Chunks, Network


def network(seed=3):
    net = Network.first(0.8, seed)
    net = net.like(net.flat() + 0.2 * np.random.default_rng(seed).standard_normal(net.flat().size))
    net.bytes_[PAD] = 0
    return net


def plain_score(net, text):
    """The network's probability, place by place."""
    data = (text or "").encode()
    chunks, start = [], 0
    while True:
        chunks.append(start)
        if start + STEP + (CHUNK - STEP) >= len(data):
            break
        start += STEP
    pools = []
    for start in chunks:
        best = np.full(FILTERS, -np.inf)
        for at in range(start, start + CHUNK):
            seen = [data[i] if i < len(data) else PAD for i in range(at, at + WIDTH)]
            best = np.maximum(best, net.bytes_[seen].reshape(WIDTH * DEPTH).astype(float) @ net.filters)
        pools.append(np.tanh(best + net.bias))
    pools = np.array(pools)
    z = np.concatenate([pools.mean(axis=0), pools.max(axis=0), pools.min(axis=0)]) @ net.weights + net.base[0]
    return 1 / (1 + np.exp(-z))


def test_scores_of_whole_texts():
    net = network()
    some = texts()[:12] + ["é" * 1000 + "x", "y" * (CHUNK - 1), "y" * CHUNK, "y" * (CHUNK + 1), "ab " * 700 + "!!!!"]
    array = pa.array(some)
    want = [plain_score(net, t) for t in some]
    assert np.allclose(net.scores(array), want, atol=1e-5)
    assert np.allclose(net.scores(array.slice(3, 5)), want[3:8], atol=1e-5)
    assert net.scores(array.slice(0, 0)).size == 0


def test_chunks_cover_texts():
    array = pa.array(["a" * n for n in (0, 1, CHUNK, CHUNK + 1, 5000)] + [None])
    chunks = Chunks(array)
    for d, t in enumerate(array.to_pylist()):
        seen = set()
        for s in chunks.start[chunks.doc == d] - chunks.start[chunks.doc == d][0]:
            seen |= set(range(s, s + CHUNK))
        assert seen >= set(range(len(t or "")))


def test_gradient():
    net = network()
    array, labels = pa.array(texts()[4:14] + [None]), np.array([0, 1] * 5 + [1], float)
    found, flat = net.gradient(array, labels), net.flat()

    def loss(x):
        s = net.like(x).scores(array)
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    rng = np.random.default_rng(1)
    for i in np.concatenate([rng.choice(PAD * DEPTH, 12), rng.choice(np.arange((PAD + 1) * DEPTH, len(flat)), 30), [len(flat) - 1]]):
        step = np.zeros(len(flat))
        step[i] = 1e-3
        assert abs(found[i] - (loss(flat + step) - loss(flat - step)) / 2e-3) < 5e-4


def corpus(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        base = words(i, 80)
        rows.append((i, " ".join(base if good else [w.upper() + "!!" for w in base]), "en", f"s{i % 3}"))
        labels.append((i, int(good)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame([(d, q, 0, "x", 1) for d, q in labels], "doc_id long, quality int, toxic int, text string, id int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(400)
    rows += [(None, "no id", "en", "s"), (9000, "", "en", "s"), (9001, None, "en", "s"), (5, rows[5][1], "en", "s")]
    labels += [(5, labels[5][1]), (None, 1), (7000, 1), (1, None)]
    out = quality_net.classify(documents(spark, rows).limit(len(rows)).repartition(3), labelled(spark, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    want = dict(labels[:400])
    held = [r for r in out if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len({r.score for r in out if r.doc_id == 5}) == 1


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = corpus(120)
    held = {d for d, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0}
    docs = documents(spark, rows).repartition(2).cache()
    one = quality_net.classify(docs, labelled(spark, labels), rounds=2).collect()
    other = quality_net.classify(docs, labelled(spark, [(d, 1 - q if d in held else q) for d, q in labels]), rounds=2).collect()
    assert {(r.doc_id, round(r.score, 5)) for r in one} == {(r.doc_id, round(r.score, 5)) for r in other}


def test_an_id_on_most_rows_keeps_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(quality_net, "SAMPLE", 50)
    rows, labels = corpus(60)
    rows = [(d, t) for d, t, _, _ in rows + [rows[3]] * 600]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    found = quality_net.sampled(docs, spark.createDataFrame(labels, "id long, label int"))
    assert 20 <= found.count() <= 90


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_one_kind_of_labels(spark, nothing, labels):
    rows, _ = corpus(6)
    known = labelled(spark, labels)
    out = quality_net.classify(documents(spark, rows).limit(6), known).collect()
    assert len(out) == 6 and len({r.score for r in out}) == 1
    assert quality_net.classify(nothing, known).count() == 0
