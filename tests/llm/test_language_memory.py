"""Memory that a task of the language model needs for its texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from riskframe.llm import language_id as li
from riskframe.llm.batches import bounded


def test_texts_are_held_in_small_slices():
    words = np.random.default_rng(3).integers(97, 123, (1000, 8192)).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([row.tobytes().decode() for row in words])], names=["text"])
    tracemalloc.start()
    rows = 0
    for part in bounded([batch], "text", li.HELD_BYTES, 8192):
        bucket, doc = li.trigrams(part.column("text"))
        np.unique(doc * li.BUCKETS + bucket, return_counts=True)
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000 and peak < 100 << 20
