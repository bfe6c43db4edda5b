"""Memory that a task of the packing operator needs for its texts."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from riskframe.llm import packing
from riskframe.llm.tokens import encoder, vocabulary


class Rows:
    """Takes the function that would run in the tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_texts_are_encoded_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    path, rng = vocabulary("word_bpe_49k.json"), np.random.default_rng(3)
    letters = rng.integers(97, 123, (1000, 8192)).astype(np.uint8)
    letters[rng.random(letters.shape) < 0.2] = 32
    texts = [row.tobytes().decode() for row in letters]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts), pa.array(["s"] * 1000)], names=["id", "text", "queue"])
    run = packing.encode_rows(Rows(), path, 2, "id", "text", "source")
    encoder(path)
    tracemalloc.start()
    rows = sum(out.num_rows for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak", peak >> 20)
    assert rows == 1000 and peak < 90 << 20
