import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import texts
from tokenizers import Tokenizer

from riskframe.llm import bpe_codec, packing, token_files
from riskframe.llm.tokens import LibraryEncoder, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "Œ", "İ", "1", "²", "٣", "中", "😀", "'s", "'re", ".", "!!", "\x1c", "\xa0", "×", "÷",
             "\x00", "<|endoftext|>", "\r\n", "\u0301", "Σ", "aaaa", "the", "ɐ", "ȳ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path, odd_texts):
    own, library = LibraryEncoder(path), Tokenizer.from_file(path)
    for text in odd_texts + texts():
        assert own.ids(text).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_codec_equals_library(odd_texts):
    own, library = bpe_codec.ForcedBoundaryCodec(BYTES), Tokenizer.from_file(BYTES)
    for text in odd_texts + texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_forced_pairs_stand_in_no_token():
    codec = bpe_codec.ForcedBoundaryCodec(BYTES)
    assert codec.forced.sum() > 50_000
    assert not any(codec.forced[a, b] for t in codec.token_bytes.values() for a, b in zip(t, t[1:]) if t != b"<|endoftext|>")


def test_codec_rows(docs, nothing):
    rows = bpe_codec.round_trip(docs, BYTES).collect()
    assert len(rows) == docs.count() and {r.decoded for r in rows} == {t or "" for t in texts()}
    back = bpe_codec.decode(bpe_codec.encode(docs, BYTES), BYTES).collect()
    assert sorted(r.decoded for r in back) == sorted(r.decoded for r in rows)
    assert bpe_codec.round_trip(nothing, BYTES).count() == 0


def test_codes_are_addressable():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << s, 700, dtype=np.uint64) for s in (4, 8, 16, 24, 32)]).astype("<u4")
    rng.shuffle(ids)
    codes = token_files.Codes(token_files.pack(ids))
    assert codes.all().tolist() == ids.tolist() and [codes[i] for i in range(len(ids))] == ids.tolist()
    assert len(token_files.Codes(token_files.pack(ids[:0]))) == 0


def test_token_files(spark, docs, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_DOCS", 4)
    token_files.write_tokens(docs, str(tmp_path / "a"), BYTES, 2)
    rows = sorted(token_files.read_documents(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys) and len(rows) == docs.count()
    start, want = 0, {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and ids == ids_of(BYTES, want[r.doc_id]) + [2]
        start += len(ids)
    own = np.frombuffer(rows[0].ids, "<u4")
    assert all(r.last == 2 for r in rows)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id is not None}
    asked = [(d, p) for d, t in ids.items() for p in {0, len(t) // 2, len(t) - 1, len(t), -1}] + [(None, 0), (1, 0), (max(ids), None)] * 2
    found = token_files.lookup(spark, str(tmp_path / "a"), spark.createDataFrame(asked, "doc_id long, position long").repartition(3)).collect()
    times = {d: sum(r.doc_id == d for r in rows) for d in ids}
    want = [(d, p, ids[d][p] if d in ids and p is not None and 0 <= p < len(ids[d]) else None) for d, p in asked for _ in range(times.get(d, 1))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want)) and len(own)
    token_files.write_tokens(nothing, str(tmp_path / "b"), BYTES, 2)
    assert token_files.read_documents(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("weights", [None, {"src0": 1.0, "a/b": 3.0}])
def test_packing(docs, weights):
    rows = packing.pack(docs, WORDS, 2, length=256, weights=weights).collect()
    sequences = defaultdict(list)
    want = {r.doc_id: ids_of(WORDS, r.text) + [2] for r in docs.collect()}
    for r in rows:
        sequences[r.sequence_id].append(r)
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start:r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(r.ids)
    assert sum(r.length for r in rows) == sum(len(want[r.doc_id]) for r in docs.collect())
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or s == len(sequences) - 1


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORDS, 2).count() == 0


def test_queues_keep_to_their_shares(spark):
    rows = [(0, i, q, 1 + (7 * i) % 50) for i, q in enumerate("aab" * 3000)]
    meta = spark.createDataFrame(rows, "part int, row long, queue string, n long")
    placed = sorted(packing.place(meta, {"a": 1, "b": 3}, 500).join(meta, ["part", "row"]).collect(), key=lambda r: r.place)
    at, sent = 0, {"a": 0, "b": 0}
    for r in placed:
        assert r.place == at
        at += r.n
        sent[r.queue] += r.n
        if sent["b"] < 3000 * 20:  # b has not run dry
            assert abs(sent["b"] - 0.75 * at) < 500 + 2 * 50


def test_each_of_many_sources_keeps_its_share(spark):
    names = ["big"] * 3000 + ["other"] * 3000 + [f"s{i}" for i in range(6000)]
    rows = [(i % 5, i, q, 1 + (7 * i) % 50) for i, q in enumerate(names)]
    meta = spark.createDataFrame(rows, "part int, row long, queue string, n long")
    for weights in (None, {"big": 3, "other": 1}):
        placed = sorted(packing.place(meta, weights, 500).join(meta, ["part", "row"]).collect(), key=lambda r: r.place)
        assert len(placed) == len(rows)
        total = Counter()
        for r in placed:
            total[r.queue if r.queue in ("big", "other") else "rest"] += r.n
        whole, at, sent = sum(total.values()), 0, Counter()
        for r in placed:
            assert r.place == at
            at += r.n
            sent[r.queue if r.queue in ("big", "other") else "rest"] += r.n
            if weights is None:
                assert all(abs(sent[q] - at * total[q] / whole) < 3000 for q in total)
            elif sent["big"] < total["big"] - 50:
                assert abs(sent["big"] - 0.75 * at) < 600 and not sent["rest"]
            elif sent["other"] < total["other"] - 50:
                assert sent["rest"] == 0
