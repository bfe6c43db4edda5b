"""Joins whose key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, stats: DataFrame, keys: list[str], by: str | Column, salts: int = 16, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``stats`` (one row for each key), each row of which is sent ``salts`` times; the
    rows of one key meet it in so many groups, by a hash of ``by``."""
    stats = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(stats, [*keys, "_salt"], how).drop("_salt")
