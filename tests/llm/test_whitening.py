import math

import numpy as np
import pytest

from spark_explore.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(4)


def draw(n=400, dim=50, seed=0):
    rng = np.random.default_rng(seed)
    scale = 2.0 ** -np.linspace(0, 6, dim)
    v = (rng.normal(size=(n, dim)) * scale) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + rng.normal(size=dim)
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(v)]


ODD = [(900, None), (901, []), (902, [1.0]), (903, [None] * 50), (904, [math.nan] * 50), (905, [math.inf] * 50), (906, [1e30] * 50)]


def expected(rows, k=32):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in rows], np.float64)
    mean = x.mean(0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return x, (x - mean) @ vectors / np.sqrt(values), values


@pytest.mark.parametrize("copies", [0, 200])
def test_whitening_equals_dense_eigenvectors(spark, copies):
    rows = draw()
    rows += [(1000 + i, rows[3][1]) for i in range(copies)] + [(None, rows[0][1])]
    x, white, values = expected(rows)
    got = whitening.whiten(table(spark, rows + ODD)).toPandas()
    assert len(got) == len(rows) * 32 and set(got["n"]) == {len(rows)} and got["identity_error"].nunique() == 1
    assert got["identity_error"].max() < 1e-9
    total = [sum(int(c) for c in column) for column in x.T]
    for at in (0, 3, 17):
        own = got[got.vec_id == rows[at][0]].sort_values("component")
        assert list(own.component) == list(range(1, 33))
        deviation = sum((len(rows) * int(c) - s) ** 2 for c, s in zip(x[at], total))
        assert set(own.deviation) == {deviation}
        assert np.allclose(np.abs(own.whitened), np.abs(white[at]), rtol=1e-6, atol=1e-7)
        assert np.allclose(own.explained, values / np.trace(np.cov(x.T, bias=True)), rtol=1e-9)


def test_jacobi_davidson_solves_larger_and_clustered_problems():
    rng = np.random.default_rng(5)
    dim = 600
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for spectrum in (1 / (1 + np.arange(dim)), np.append(np.full(20, 5.0), np.linspace(4, 0, dim - 20)), np.append([1e6, 1e6, 3], np.full(dim - 3, 1e-3))):
        matrix = (basis * spectrum) @ basis.T
        calls = []

        def multiply(block, matrix=matrix, calls=calls):
            calls.append(block.shape[1])
            return matrix @ block

        values, vectors = whitening.jacobi_davidson(multiply, dim, 8, 1.0)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], rtol=1e-10)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * values[0]
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-10)
        assert len(calls) < 400


def test_minres_reaches_the_solution_in_full_steps():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    right = rng.normal(size=(12, 3))
    assert np.allclose(a @ whitening.minres(lambda v: a @ v, right, 14), right, atol=1e-6)
    assert not whitening.minres(lambda v: a @ v, np.zeros((12, 2)), 3).any()


def test_few_rows_and_no_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, ODD[:2])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    got = whitening.whiten(table(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0])])).collect()
    assert [r["component"] for r in got] == [1, 1, 1] and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_deviations_are_exact_or_null():
    x = np.array([[2.0**40, 0.0], [0.0, 1.0]])
    assert whitening._deviations(x, 2, [2**40, 1]).to_pylist() == [None, None]
    assert whitening._deviations(np.array([[3.0, 1.0]]), 10**6, [10, 20]).to_pylist() == [(3 * 10**6 - 10) ** 2 + (10**6 - 20) ** 2]
