"""Operators that read Arrow batches in slices give the same rows whatever the slices are."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import documents, plain_words, texts, words

from riskframe.llm import bpe_codec, jaccard_join, language_id, markov_lm, packing, secret_scan, spelling, token_files
from riskframe.llm.batches import bounded
from riskframe.llm.tokens import vocabulary

MODULES = (bpe_codec, jaccard_join, language_id, markov_lm, packing, secret_scan, spelling, token_files)


@pytest.fixture(scope="module")
def one_task(spark):
    base = words(9, 80)
    rows = [(i, t) for i, t in enumerate(texts())] + [(100 + i, " ".join(base[:40 + i % 3] + [f"N{i}"] + base[42:])) for i in range(30)]
    return documents(spark, [(d, t, ["en", "fr"][d % 2], f"s{d % 3}") for d, t in rows]).coalesce(1).cache()


def tokens(spark, docs, folder):
    token_files.write_tokens(docs, folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read_documents(spark, folder)


OPERATORS = {
    "join": lambda s, d, p: jaccard_join.join(d, 3, 90),
    "score": lambda s, d, p: markov_lm.score(d, states=2, own_classes=8, shared_classes=5, rounds=2),
    "language": lambda s, d, p: language_id.identify(language_id.document_rows(d, F.col("doc_id"))),
    "spelling": lambda s, d, p: spelling.variants(d, least=3, times=2),
    "secrets": lambda s, d, p: secret_scan.scan(d),
    "packing": lambda s, d, p: packing.pack(d, vocabulary("word_bpe_49k.json"), end_id=2),
    "files": lambda s, d, p: tokens(s, d, p),
    "codec": lambda s, d, p: bpe_codec.round_trip(d, vocabulary("byte_bpe_50k.json")),
}


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_slices_change_nothing(spark, one_task, monkeypatch, tmp_path, name):
    whole = plain(OPERATORS[name](spark, one_task, str(tmp_path / "a")).collect())

    def small(batches, column, max_bytes=0, max_rows=0):
        return bounded(batches, column, 1 << 11, 3)

    for module in MODULES:
        monkeypatch.setattr(module, "bounded", small, raising=False)
    assert plain(OPERATORS[name](spark, one_task, str(tmp_path / "b")).collect()) == whole


def test_words_of_slices():
    array = pa.array(texts())
    for start in range(len(texts())):
        part = array.slice(start, 3)
        found = [[w for w in t if w] for t in markov_lm.words_of(part).to_pylist()]
        assert found == [[w.encode() for w in plain_words(t)] for t in texts()[start:start + 3]]
        assert isinstance(found, list) and np.all([isinstance(t, list) for t in found])
