"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries are quantised to integers, and every different vector is one row of the fit.  With the centred rows ``X`` the
bidiagonalisation alternates products ``X v`` and ``X' u`` until the largest singular values have settled; the
singular value decomposition of the small bidiagonal matrix gives components and deviations.

Right vectors (as long as a row) are on the driver, and each new one is orthogonalised against all before.  Left vectors
have an entry for each row of the fit and stay distributed: each is ``X w`` for a ``w`` on the driver, so a task computes its
part of them again from its rows, and no state has to survive a lost executor.  One pass over the rows gives a
step's ``X v``, its products with all left vectors and ``X' u``; where the new left vector isn't orthogonal to the
others to working precision, it is corrected and the pass repeated.

Rows of the fit lie as blocks of integers in the shared folder.  A pass sends a few hundred sums to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.session import scratch_folder

#: Steps of an entry: entries are rounded down to its multiples (fixed value).
STEPS = 256
#: Rows of a block, and bytes of blocks that a task holds at a time.
BLOCK_ROWS, HELD_BYTES = 2048, 4 << 20
#: Left and right vectors are orthogonal, and singular values settled, to this share of what they are.
PRECISION = 1e-14


@dataclass
class Fit:
    """Components (columns, unit length) by falling variance, of vectors of one length."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    #: Largest absolute entry of the whitened rows' covariance minus the identity.
    identity_error: float


def quantised(vectors: DataFrame, vector: str) -> DataFrame:
    """Adds ``x``, the vector's entries in whole steps; rows with null vectors, null or non-finite entries go."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & finite).withColumn("x", F.transform(v, lambda c: F.floor(c * STEPS)))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(block binary)``: different vectors of ``x`` as blocks of 64-bit integers."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = batch.column("x").slice(start, BLOCK_ROWS)
                flat = np.asarray(x.flatten()).astype("<i8")
                yield record_batch(block=pa.array([flat.tobytes()], pa.binary()))

    return rows.where(F.size("x") == size).select("x").distinct().mapInArrow(run, "block binary")


def summed(held: DataFrame, size: int, length: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``work(rows)``, a vector of ``length`` numbers."""

    def run(batches):
        sums, some = np.zeros(length), False
        for batch in bounded(batches, "block", HELD_BYTES):
            for block in batch.column("block"):
                sums += work(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, size))
                some = True
        if some:
            yield record_batch(i=pa.array(range(length), pa.int32()), v=pa.array(sums))

    out = np.zeros(length)
    for i, v in held.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], size: int, wanted: int,
                  scale: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values, falling, and right singular vectors of ``X``.

    ``product(w, W)`` gives ``(X W)'(X w)``, the square of the length of ``X w``, and ``X' X w``.  ``scale`` is about
    the length of all of ``X``; what is below ``PRECISION`` of it counts as zero.
    """
    zero = PRECISION * scale
    v = np.random.default_rng(seed).standard_normal(size)
    v /= np.linalg.norm(v)
    right, left = [v], np.zeros((size, 0))  # left vectors are X @ left
    alphas, betas = [], []
    beta, out = 0.0, (np.zeros(0), np.zeros((size, 0)))
    while True:
        w = right[-1] - (beta * left[:, -1] if betas else 0.0)
        for _ in range(4):
            along, square, back = product(w, left)
            alpha = float(np.sqrt(square))
            if not len(along) or np.abs(along).max() <= PRECISION * max(alpha, zero):
                break
            w = w - left @ along
        if alpha <= zero:
            alphas.append(0.0)
            v, beta = np.zeros(size), 0.0
        else:
            alphas.append(alpha)
            left = np.column_stack([left, w / alpha])
            v = back / alpha - alpha * right[-1]
            basis = np.column_stack(right)
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
            beta = float(np.linalg.norm(v))
        k = len(alphas)
        # X @ right = left @ small, where small is upper bidiagonal.
        small = np.diag(alphas) + np.diag(betas, 1)
        lefts, values, rights = np.linalg.svd(small)
        out = values[:wanted], (np.column_stack(right) @ rights.T)[:, :wanted]
        ended = beta <= zero or k == size
        if ended or k > wanted and np.all(beta * np.abs(lefts[-1, :wanted]) <= PRECISION * values[0]):
            return out
        right.append(v / beta)
        betas.append(beta)


def fit(rows: DataFrame, size: int, wanted: int) -> Fit:
    """Components of the different vectors ``x`` of length ``size`` in ``rows``, at most ``wanted``: those of variance zero are left out."""
    nothing = Fit(0, np.zeros(size, object), np.zeros((size, 0)), np.zeros(0), 0.0, 0.0)
    if size == 0:
        return nothing
    spark = rows.sparkSession
    path = scratch_folder(spark, "vector-blocks")
    blocks(rows, size).write.parquet(path)
    held = spark.read.schema("block binary").parquet(path)
    # Sums as whole numbers: exact, whatever the order.
    found = held.mapInArrow(lambda batches: whole_sums(batches, size), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v")).collect()
    sums = {i: int(v) for i, v in found}
    n = sums.pop(-1, 0)
    exact = np.array([sums.get(i, 0) for i in range(size)], object)
    if n == 0:
        return nothing
    mean = np.array([s / n for s in exact], float)
    squares = float(summed(held, size, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0])

    def product(w, left):
        k = left.shape[1]

        def work(x):
            centred = x - mean
            p = centred @ w
            return np.concatenate([(centred @ left).T @ p, [p @ p], centred.T @ p])

        out = summed(held, size, k + 1 + size, work)
        return out[:k], out[k], out[k + 1:]

    values, components = bidiagonalise(product, size, min(wanted, size), np.sqrt(squares)) if squares > 0 else (
        np.zeros(0), np.zeros((size, 0)))
    some = values ** 2 > PRECISION * squares
    variances, components = values[some] ** 2 / n, components[:, some]
    k = len(variances)

    def covariance(x):
        z = (x - mean) @ components / np.sqrt(variances)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    error = 0.0
    if k:
        out = summed(held, size, k * k + k, covariance)
        middle = out[k * k:] / n
        error = float(np.abs(out[:k * k].reshape(k, k) / n - np.outer(middle, middle) - np.eye(k)).max())
    return Fit(n, exact, components, variances, squares / n, error)


def whole_sums(batches, size: int):
    """Rows (as -1) and sums by dimension of the blocks, as whole numbers."""
    import decimal
    totals, n = [0] * size, 0
    for batch in bounded(batches, "block", HELD_BYTES):
        for block in batch.column("block"):
            x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, size)
            safe = not len(x) or max(int(x.max()), -int(x.min())) * len(x) < 1 << 62
            part = x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()
            totals = [a + b for a, b in zip(totals, part)]
            n += len(x)
    names = list(range(size)) + [-1]
    yield record_batch(i=pa.array(names, pa.int32()), v=pa.array([decimal.Decimal(t) for t in [*totals, n]], pa.decimal128(38, 0)))


def whiten(vectors: DataFrame, wanted: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of every row and component.

    Entries count in whole steps of 1/256, rounded down.  ``n`` different vectors make the fit; ``deviation`` is the
    sum over dimensions of ``(n x - S)^2`` with the sums ``S`` of the fit, as a whole number (null beyond 38 digits); ``whitened`` is the
    centred vector along the component, over the component's standard deviation; ``explained`` is the component's share of all variance.

    Null vectors and vectors with null or non-finite entries are left out.  The length that most vectors have (of
    equals, the larger) is fitted; vectors of other lengths are left out.  Repeated rows and ids, and null ids,
    have results each, and count once in the fit where their vectors are equal.  Components without variance
    aren't returned, so an empty table, and one whose vectors are all equal, give no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v").select("id", "x")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    size = common or 0
    found = fit(rows, size, wanted)
    final = spark.sparkContext.broadcast(found)

    def run(batches):
        import decimal
        f = final.value
        mean = np.array([s / f.n for s in f.sums], float) if f.n else np.zeros(size)
        k = len(f.variances)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                if not k:
                    continue
                x = np.asarray(batch.column("x").flatten()).reshape(-1, size)
                z = (x - mean) @ f.components / np.sqrt(f.variances)
                most = f.n * max(int(x.max()), -int(x.min())) + max(abs(s) for s in f.sums)
                if most ** 2 * size < 1 << 63:
                    far = ((f.n * x - f.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    far = ((f.n * x.astype(object) - f.sums) ** 2).sum(axis=1).tolist()
                far = [decimal.Decimal(v) if v < 10 ** 38 else None for v in far]
                times = np.repeat(np.arange(len(x)), k)
                yield record_batch(
                    id=batch.column("id").take(pa.array(times)), component=pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    deviation=pa.array(far, pa.decimal128(38, 0)).take(pa.array(times)), whitened=pa.array(z.ravel()))

    kind = rows.schema["id"].dataType.simpleString()
    share = [float(e / found.trace) for e in found.variances]
    out = rows.where(F.size("x") == size).mapInArrow(run, f"id {kind}, component int, deviation decimal(38,0), whitened double")
    return out.select(F.col("id").alias(id), "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(F.lit(share).cast("array<double>"), F.col("component") - 1).alias("explained"),
                      F.lit(found.identity_error).alias("identity_error"))


@llm_query("op13_vector_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Four whitened components of every vector."""
    return whiten(table(spark, folder, "embeddings"), wanted=4).withColumn("deviation", F.col("deviation").try_cast("long"))
