"""Exact quantiles of few large groups: no group's rows meet in one task."""

import pytest
from pyspark.sql import functions as F

from riskframe.plans import quantiles


@pytest.mark.parametrize("limit, few", [(100_000, True), (1, False)])
def test_few_groups_are_not_shuffled_by_key(spark, monkeypatch, limit, few):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", limit, raising=False)
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(999).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 999).cast("double").alias("v"))
        got = quantiles.exact_quantiles(df, ["k"], "v", (0.5,), "q", accuracy=50)
        joins = got._jdf.queryExecution().executedPlan().toString()
        values = {r.k: r.q[0] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
    assert ("BroadcastHashJoin" in joins) == few
    want = {k: df.where(F.col("k") == k).agg(F.percentile("v", F.lit(0.5))).first()[0] for k in range(3)}
    assert values == want
