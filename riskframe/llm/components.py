"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.batches import record_batch
from riskframe.session import cut_lineage

#: Rows of a few numbers that one task holds easily (2 MB of links).
SMALL = 1 << 17


def gathered(df: DataFrame) -> DataFrame:
    """A checkpointed table of narrow rows: in one partition, where nothing needs a shuffle any more, if it has at most
    ``SMALL`` rows, and as it is otherwise.  So the number of tasks follows the rows, whatever the session's number of partitions."""
    df = cut_lineage(df)
    return df.coalesce(1) if df.count() <= SMALL else df


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the smallest of its component, and that smallest one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = place[:len(a)], place[len(a):], np.arange(len(nodes))
    while len(a):  # roots point to the smallest root they are linked with, paths are halved to their ends, loops go
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def contracted(links: DataFrame) -> DataFrame:
    """``(a, b)``: stars in place of the links, ``SMALL`` of them at a time within each task."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
            size += batch.num_rows
            if size >= SMALL:
                yield star_batch(held)
                held, size = [], 0
        if held:
            yield star_batch(held)

    def star_batch(held):
        a, b = stars_of(*map(np.concatenate, zip(*held)))
        return record_batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the links ``(a long, b long)``; a component is its smallest node.

    Tasks contract their own links to stars first, so that at most ``SMALL`` links are done at once.  Of more, alternating
    large and small stars: each round every node sends its larger, then its smaller neighbours to the
    smallest one, until nothing moves.  Smallest neighbours are aggregated before they are shuffled; where they meet
    the links, the links of one node may be any share of all: adaptive execution splits them, as the other side
    has one row for each node.  The number of rounds grows with the
    logarithm of the number of nodes; each is cut by a checkpoint.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    if links.count() <= SMALL:
        return labels(cut_lineage(contracted(links.coalesce(1))))
    links, state = gathered(contracted(links).distinct()), None
    while True:
        # Large star: larger neighbours of u, to the smallest of u and its neighbours.
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        # Small star: u and its smaller neighbours, to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = gathered(small.select(F.col("b").alias("x"), "m").union(small.select("a", "m")).where("x <> m").distinct()
                         .toDF("a", "b"))
        # Done when every node has one link, and no target has a link of its own: then the sum repeats.
        now = tuple(links.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or (now[0] == now[1] and links.select("b").distinct().join(
                links.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0):
            break
        state = now
    return labels(links)


def labels(links: DataFrame) -> DataFrame:
    """``(node, component)`` of stars ``(a, b)``."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct())
