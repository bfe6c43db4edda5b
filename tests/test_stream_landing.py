"""Events landed by eighths: the same rows as by exact percentiles, one file for each eighth that has any."""

import glob
import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from riskframe.queries import streams


def test_eighths(spark, tmp_path):
    events = spark.range(0, 400).select((F.col("id") * F.col("id") % 1009 * 3 + 7).alias("event_id"), F.lit(1.0).alias("value")).union(
        spark.createDataFrame([(None, 2.0)], "event_id long, value double"))
    t = SimpleNamespace(spark=spark, read=lambda name: events)
    exact = events.agg(F.percentile("event_id", F.lit([i / 8 for i in range(1, 8)]))).first()[0]
    edges = streams.eighth_edges(t)
    assert edges == [math.floor(q) for q in exact]
    ids = sorted(r.event_id for r in events.where("event_id IS NOT NULL").collect())
    for i in range(8):
        folder = str(tmp_path / str(i))
        streams.landed(t, folder, edges, range(i, i + 1))
        assert len(glob.glob(f"{folder}/*.parquet")) == 1
        want = [x for x in ids if sum(x > q for q in exact) == i]
        assert sorted(r.event_id for r in spark.read.parquet(folder).collect()) == want
