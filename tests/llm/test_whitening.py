"""Whitening against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], SCHEMA)


def dense(vectors, k):
    """Eigenvectors of the covariance of the distinct whole vectors."""
    x = np.floor(256 * np.array(vectors, float)).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, ids, vectors, k, atol=1e-7):
    n, deviation, white, shares = dense(vectors, k)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == len(ids) * k
    for c in range(k):
        own = np.array([by[i, c + 1].whitened for i in ids])
        assert min(np.abs(own - white[:, c]).max(), np.abs(own + white[:, c]).max()) < atol
        assert all(by[i, c + 1].n == n and by[i, c + 1].deviation == d and abs(by[i, c + 1].explained - shares[c]) < 1e-9 for i, d in zip(ids, deviation.tolist(), strict=True))
    assert max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize(("n", "d", "parts"), [(200, 6, 1), (300, 17, 5), (90, 40, 3), (1000, 5, 40)])
def test_random_vectors(spark, n, d, parts):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * np.linspace(0.2, 3, d)).tolist()
    vectors += vectors[:20]  # copies count once
    rows = whitening.whiten(frame(spark, vectors).repartition(parts), 4).collect()
    check(rows, range(len(vectors)), vectors, 4)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    held = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(queries.op13_whitening(spark, sf).collect(), [r.vec_id for r in held], [r.embedding for r in held], 4)


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 32, 33):
        left, right = np.linalg.qr(rng.standard_normal((3 * d, d)))[0], np.linalg.qr(rng.standard_normal((d, d)))[0]
        lengths = np.sort(10.0 ** rng.uniform(-3, 3, d))[::-1]
        v, found = whitening.jacobi(np.linalg.qr((left * lengths) @ right.T, mode="r"))
        assert np.allclose(found, lengths, rtol=1e-8) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        assert np.allclose(np.abs((v * right).sum(0)), 1, atol=1e-6)


def test_blocks_stacked_give_the_triangle_of_all_rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 7))
    r = None
    for part in np.array_split(x, 23):
        r = whitening.stacked(r, part)
    assert np.allclose(r.T @ r, x.T @ x) and r.shape == (7, 7)


def test_odd_vectors(spark):
    good = [[1.0, 2.0], [1.5, -2.0], [0.25, 0.0], [0.25, 0.0], [-0.0, 3.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]
    rows = whitening.whiten(frame(spark, good + bad), 4).collect()
    check(rows, range(5), good, 2)
    assert whitening.whiten(frame(spark, bad[:5]), 4).count() == 0 and whitening.whiten(frame(spark, good).where("false"), 4).count() == 0
    null_ids = whitening.whiten(frame(spark, good).withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(null_ids) == 10 and all(r.vec_id is None and r.whitened is not None for r in null_ids)


def test_components_without_deviation(spark):
    rows = whitening.whiten(frame(spark, [[1.0, 5.0, 2.0], [2.0, 5.0, 4.0], [4.0, 5.0, 8.0]]), 4).collect()
    first = [r for r in rows if r.component == 1]
    assert len(rows) == 9 and all(abs(r.explained - 1) < 1e-12 and r.whitened is not None and r.identity_error < 1e-12 for r in first)
    assert all(r.whitened is None and r.explained == 0 for r in rows if r.component > 1)
    one = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3), 4).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error is None for r in one)


def test_large_entries_and_deviations(spark):
    vectors = [[1e6, -1e6], [2e6, 5.5], [1e300, 0.0]]
    rows = {r.vec_id: r for r in whitening.whiten(frame(spark, vectors[:2]), 1).collect()}
    assert rows[0].deviation == (2 * 256_000_000 - 768_000_000) ** 2 + (2 * -256_000_000 - (1408 - 256_000_000)) ** 2
    assert all(r.deviation is None for r in whitening.whiten(frame(spark, vectors), 1).collect() if r.vec_id == 2)
    assert whitening.whole(np.array([1e300, -1e300, 0.5, -0.001, -0.0])).tolist() == [2**63 - 1, -(2**63), 128, -1, 0]


def test_float_vectors(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((50, 3)).astype(np.float32).tolist()
    rows = frame(spark, vectors).withColumn("embedding", F.col("embedding").cast("array<float>"))
    check(whitening.whiten(rows, 4).collect(), range(50), vectors, 3)
