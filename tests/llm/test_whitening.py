import numpy as np
import pytest

from riskframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x long, v string, component int, block binary, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, b"", 3) for i, v in rows], SCHEMA)


def plain(rows, wanted=4):
    """Every row's whitened values, deviations, shares by the covariance's own eigenvectors."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in ok]
    size = max(set(lengths), key=lambda d: (lengths.count(d), d))
    ok = [(i, v) for i, v in ok if len(v) == size]
    x = np.floor(256 * np.array([np.array(v, np.float32) for _, v in ok], float)).astype(np.int64)
    own = np.unique(x, axis=0)
    n, sums = len(own), own.sum(axis=0)
    values, parts = np.linalg.eigh(np.cov(own.T, bias=True))
    values, parts = values[::-1], parts[:, ::-1]
    keep = values[:wanted] > 1e-9 * max(values.sum(), 1e-30)
    z = (x - sums / n) @ parts[:, :wanted][:, keep] / np.sqrt(values[:wanted][keep])
    return [i for i, _ in ok], n, ((n * x - sums) ** 2).sum(axis=1), z, values[:wanted][keep] / values.sum()


def compare(spark, rows, wanted=4):
    ids, n, far, z, shares = plain(rows, wanted)
    out = whitening.whiten(vectors(spark, rows).repartition(3), wanted).collect()
    assert len(out) == z.size and all(r.n == n for r in out)
    for k in range(z.shape[1]):
        mine = sorted((str(r.vec_id), int(r.deviation), r.whitened) for r in out if r.component == k + 1)
        off = [max(abs(m[2] - w[2]) for m, w in zip(mine, sorted(zip(map(str, ids), far.tolist(), (s * z[:, k]).tolist())))) for s in (1, -1)]
        assert min(off) < 1e-8
        assert [m[:2] for m in mine] == sorted(zip(map(str, ids), far.tolist()))
        assert all(np.isclose(r.explained, shares[k], rtol=1e-10) for r in out if r.component == k + 1)
    assert all(r.identity_error < 1e-9 for r in out)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 0.3
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(points)]
    rows += rows[:40] + [(i, rows[7][1]) for i in range(1000, 1500)]  # one vector on most rows
    rows += [(None, rows[3][1]), (1, None), (2, [float("nan")] * 12), (3, [None] * 12), (4, [float("inf")] + [0.0] * 11), (5, [1.0, 2.0]), (6, [])]
    compare(spark, rows)


def test_fewer_components_than_wanted(spark):
    rows = [(i, [float(i), 2.0 * i, -0.0, 5.0]) for i in range(9)]
    compare(spark, rows)  # a line: one component
    compare(spark, [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [7.0, 0.0])], wanted=1)


def test_nothing_to_fit(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(i, [float(i * 1_000_000_000), float(i % 3), 1.0]) for i in range(20)]
    _, n, _, _, _ = plain(rows)
    out = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows), 1).collect()}
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert out == {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


@pytest.mark.parametrize("rank,size", [(6, 6), (3, 8), (20, 30)])
def test_bidiagonalisation(rank, size):
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((200, rank)) @ rng.standard_normal((rank, size))

    def product(w, left):
        p = x @ w
        return (x @ left).T @ p, p @ p, x.T @ p

    values, right = whitening.bidiagonalise(product, size, 5, np.linalg.norm(x))
    want = np.linalg.svd(x)[1][:5]
    some = want > 1e-9
    assert np.allclose(values[:some.sum()], want[some], rtol=1e-12) and np.all(values[some.sum():] < 1e-9)
    assert np.allclose(np.linalg.norm(x @ right[:, :some.sum()], axis=0), want[some], rtol=1e-12)
