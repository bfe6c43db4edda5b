"""Nearest neighbours by block matrix join.

Queries and candidates are cut into blocks of bounded size; every pair of a query block and a candidate block is
one tile of the score matrix and one group of the join.  In a tile, vectors are quantised to int8 with a scale of
their own.  The product of the int8 matrices gives every score with a proven error bound, and with it, for each
query, a lower bound of its k-th best score in the tile; pairs whose upper bound lies below are discarded.  The
pairs that survive are computed again in double precision from the original vectors, and a heap keeps each
query's k best of the tile.  Tiles send at most k pairs a query; heaps merge them by ``FAN`` candidate blocks at a
time, level by level, so a group never holds more than a query block's best of ``FAN`` blocks.  The result is exact:
bounds only spare work.

Blocks are dealt by a hash of the id, so equal vectors spread over all blocks.  A stated query set against all
rows needs all tiles: candidates are sent once for each query block and queries once for each candidate block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.registry import llm_query, table

#: Rows of a block on either side; a task holds one block of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Candidate blocks whose best are merged at a time.
FAN = 16
#: Queries of a tile that are multiplied at a time.
STRIP = 256
#: Best pairs, with the tile they are of.
BEST = "query_id long, id long, score double, d int, q int, c int"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and bounds of the norms of the coded vectors and of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    slack = 1 + 1e-9
    return (codes.astype(np.int8), scale, np.sqrt((coded ** 2).sum(axis=1)) * slack,
            np.sqrt(((x - coded) ** 2).sum(axis=1)) * slack)


def tile(query_ids, queries, ids, vectors, k: int):
    """``(query id, id, score)`` of each query's ``k`` best in the tile, itself left out; ties to the smaller id."""
    q, q_scale, q_norm, q_error = quantise(queries)
    c, c_scale, c_norm, c_error = quantise(vectors)
    # int8 codes multiply exactly in single precision up to 1,024 dimensions, in double beyond.
    kind = np.float32 if q.shape[1] <= 1024 else np.float64
    right = c.T.astype(kind)
    for start in range(0, len(q), STRIP):
        rows = slice(start, start + STRIP)
        score = (q[rows].astype(kind) @ right) * q_scale[rows, None] * c_scale
        bound = (q_error[rows, None] * c_norm + q_norm[rows, None] * c_error + q_error[rows, None] * c_error)
        bound += 1e-9 * (np.abs(score) + q_norm[rows, None] * c_norm)
        own = query_ids[rows, None] == ids
        sure = np.isfinite(score) & np.isfinite(bound)  # beyond the range of doubles nothing is discarded
        low = np.where(sure & ~own, score - bound, -np.inf)
        high = np.where(own, -np.inf, np.where(sure, score + bound, np.inf))
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        for i, at in enumerate(range(start, min(start + STRIP, len(q)))):
            kept = np.flatnonzero((high[i] >= least[i]) & ~own[i])
            exact = (vectors[kept] * queries[at]).sum(axis=1)
            best = heapq.nsmallest(k, zip((-exact).tolist(), ids[kept].tolist()))
            for score_, id_ in best:
                yield query_ids[at], id_, -score_


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``(id, v)`` of vectors that are not null, empty or zero and whose components are all finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(id).cast("long").alias("id"), v.alias("v"), finite.alias("ok"),
                           F.exists(v, lambda x: x != 0).alias("some"))
            .where("id IS NOT NULL AND ok AND some").select("id", "v"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: each query's ``k`` candidates of largest inner product, in double precision,
    without rows of the query's own id; equal scores in order of ids.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do null ids;
    vectors only meet others of their length.  A query id that is repeated is one query (its smallest vector, by
    component); a candidate that is repeated takes a place each time.  With fewer than ``k`` candidates all are returned, and none from an empty
    table.  Other columns are not read.
    """
    left = usable(queries, id, vector).groupBy("id").agg(F.min("v").alias("v"))
    right = usable(candidates, id, vector)
    n_left, n_right = left.count(), right.count()
    q_blocks, c_blocks = max(1, -(-n_left // QUERY_BLOCK)), max(1, -(-n_right // CANDIDATE_BLOCK))

    def block(n):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = left.select("id", "v", F.size("v").alias("d"), block(q_blocks).alias("q"), every(c_blocks).alias("c"))
    right = right.select("id", "v", F.size("v").alias("d"), block(c_blocks).alias("c"), every(q_blocks).alias("q"))

    def join(group: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(one) and len(other):
            rows = tile(one["id"].to_numpy(), np.stack(one["v"].to_numpy()).astype(np.float64),
                        other["id"].to_numpy(), np.stack(other["v"].to_numpy()).astype(np.float64), k)
        out = pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        return out.assign(d=group[0], q=group[1], c=group[2])

    best = left.groupBy("d", "q", "c").cogroup(right.groupBy("d", "q", "c")).applyInPandas(join, BEST)

    def merge(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, part in rows.groupby("query_id", sort=False):
            nearest = heapq.nsmallest(k, zip((-part["score"]).tolist(), part["id"].tolist()))
            out += [(query, id_, -far, *group, rank) for rank, (far, id_) in enumerate(nearest, 1)]
        return pd.DataFrame(out, columns=["query_id", "id", "score", "d", "q", "c", "rank"])

    blocks = c_blocks
    while True:
        blocks = -(-blocks // FAN)
        best = best.withColumn("c", F.floor(F.col("c") / FAN).cast("int")).groupBy("d", "q", "c").applyInPandas(
            merge, BEST + ", rank int")
        if blocks == 1:
            return best.select("query_id", "rank", F.col("id").alias(id), "score")
        best = best.drop("rank")


@llm_query("op4_block_matrix_neighbours")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector's 20 nearest among all others."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors.where("vec_id % 20 = 0"), vectors, k=20)
