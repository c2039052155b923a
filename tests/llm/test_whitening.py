import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F


from amperia.llm.whitening import extent, op11_whitening, primes, remaindered, scatter, usable

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def x_of(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def vectors(seed, n, dims, spread=1.0):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(n, dims)) @ r.normal(size=(dims, dims)) * spread + r.normal(size=dims) * 10
    return [(k, [float(c) for c in v], 0) for k, v in enumerate(mixed.astype(np.float32))]


def check(spark, rows, kept=None):
    """Results against whole numbers and the definition: covariance of centred x, projections onto unit eigenvectors."""
    got = {}
    for r in op11_whitening(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    use = [r for r in rows if kept is None or r[0] in kept]
    assert set(got) == {r[0] for r in use}
    x = np.array([x_of(r[1]) for r in use], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = n * x - s
    assert all(v.n == n and v.deviation == int((c[i] ** 2).sum()) for i, r in enumerate(use) for v in got[r[0]].values())
    centred = np.array([[float(Fraction(int(v), n)) for v in row] for row in c])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, len(e))
    assert all(sorted(v) == list(range(1, k + 1)) for v in got.values())
    w = np.array([[got[r[0]][j].whitened for j in range(1, k + 1)] for r in use])
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    for j in range(k):  # up to the sign, the same one for all rows
        assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-6
    first = next(iter(got.values()))
    assert all(abs(first[j + 1].explained - e[j] / e.sum()) <= 1e-9 for j in range(k))
    errors = {v.identity_error for rows_ in got.values() for v in rows_.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize(("n", "dims"), [(400, 40), (50, 7), (3, 2)])
def test_same_as_exact_covariance(spark, n, dims):
    check(spark, vectors(n, n, dims))


def test_bad_vectors_leave(spark):
    rows = vectors(5, 60, 6)
    bad = [(100, None, 1), (101, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (102, [float("nan")] + [0.0] * 5, 1), (103, [float("-inf")] + [0.0] * 5, 1), (104, [], 1), (105, [1.0, 2.0], 1)]
    check(spark, rows + bad, kept={r[0] for r in rows})


def test_scatter_is_exact_for_large_numbers_and_many_rows(spark):
    """Far beyond what doubles hold, in blocks of a few rows."""
    
    r = np.random.default_rng(1)
    for size in (10, 1 << 40, (1 << 63) - 1):
        y = [[int(v) for v in row] for row in r.integers(-size, size, size=(100, 5), endpoint=size < 1 << 62)]
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(y)], "vec_id long, y array<long>").repartition(3)
        dims, n, most = extent(rows)
        ones = np.array([[1, *v] for v in y], dtype=object)
        assert (scatter(rows, dims, n, most, 7) == ones.T @ ones).all()


def test_remainders_give_numbers_of_either_sign():
    for bound in (1, 10**9, 10**40):
        p = primes(2 * bound)
        numbers = np.array([bound, -bound, 0, 1, -1, bound // 3], dtype=object)
        assert (remaindered([(numbers % q).astype(np.int64) for q in p], p) == numbers).all()
        assert all(q < 1 << 21 and all(q % d for d in range(2, 1500)) for q in p) and len(set(p)) == len(p)


def test_nothing_varies(spark):
    got = op11_whitening(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in (1, 1, None)], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(3, 0, None, 0.0, 0.0)] * 6
    assert sorted(str(r.vec_id) for r in got) == ["1"] * 4 + ["None"] * 2


def test_a_dimension_without_variance(spark):
    rows = [(k, [float(k), 5.0, float(k % 3)], 0) for k in range(30)]
    got = op11_whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got if r.whitened is None} == {3} and all(r.identity_error < 1e-9 for r in got)


def test_deviation_beyond_a_long_is_null(spark):
    got = op11_whitening(spark.createDataFrame([(k, [float(k) * 1e14, float(k % 2)], 0) for k in range(6)], SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and all(abs(r.identity_error) < 1e-4 for r in got)


def test_empty_and_clashing_columns(spark):
    assert op11_whitening(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(vectors(9, 20, 3), SCHEMA)
    for c in ("y", "n", "at", "v", "modulus", "component", "deviation", "dims"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert op11_whitening(df).count() == 60


def test_whole_test_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    check(spark, rows)
    assert usable(df).count() == len(rows)
