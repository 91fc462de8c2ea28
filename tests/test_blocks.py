"""Distributed linear algebra against numpy: tall matrices over several tasks, square ones in blocks that don't divide them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.operators import blocks


def tall(spark, x, parts=5):
    return spark.createDataFrame([(i, r.tolist(), float(i % 3)) for i, r in enumerate(x)], "id long, x array<double>, y double").repartition(parts)


def back(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_tall(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 2)  # several levels of combining
    x = np.random.default_rng(1).standard_normal((40, 6)) * [1, 10, 1e-3, 1, 5, 2]
    rows = tall(spark, x)
    assert np.allclose(blocks.gram_matrix(rows, "x", 6), x.T @ x)
    q, r = blocks.tall_qr(rows, "x", 6)
    got = back(q, "q")
    assert np.allclose(got @ r, x) and np.allclose(got.T @ got, np.eye(6), atol=1e-12) and (np.diag(r) > 0).all() and np.allclose(r, np.triu(r)) and "y" in q.columns
    u, s, vt = blocks.tall_svd(rows, "x", 6)
    assert np.allclose(back(u, "u") * s @ vt, x) and np.allclose(s, np.linalg.svd(x, compute_uv=False))
    y = np.arange(40) % 3.0
    assert np.allclose(blocks.least_squares(rows, "x", "y", 6), np.linalg.lstsq(x, y, rcond=None)[0])
    w, v = blocks.axes_of(rows, "x", 6)
    assert np.allclose(v * w @ v.T, x.T @ x) and (np.diff(w) <= 0).all()


def test_tall_edges(spark):
    few = tall(spark, np.ones((2, 3)))
    assert np.allclose(blocks.triangle(few, "x", 3)[1:], 0)
    with pytest.raises(errors.SingularMatrix):
        blocks.tall_qr(few, "x", 3)
    u, s, _ = blocks.tall_svd(few, "x", 3)
    assert np.allclose(s, [6**0.5, 0, 0]) and np.allclose(np.abs(back(u, "u"))[:, 0], 0.5**0.5)
    assert (blocks.gram_matrix(few.where("false"), "x", 3) == 0).all()
    with pytest.raises(errors.DimensionMismatch):
        blocks.gram_matrix(few, "x", 5000)


def cells(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_blocked(spark):
    n, b = 5, 2
    x = np.random.default_rng(2).standard_normal((n, n)) + 5 * np.eye(n)
    x[0, 4] = x[3, 1] = 0
    a = cells(spark, x)
    low, up = (dense(p, (n, n)) for p in blocks.lu(a, n, b))
    assert np.allclose(low @ up, x) and np.allclose(np.diag(low), 1) and np.allclose(low, np.tril(low)) and np.allclose(up, np.triu(up))
    y = np.arange(2 * n, dtype=float).reshape(n, 2)
    assert np.allclose(dense(blocks.solve(a, cells(spark, y), n, b), (n, 2)), np.linalg.solve(x, y))
    one = spark.createDataFrame([(i, 1.0) for i in range(n)], "i long, v double")
    assert np.allclose([r.v for r in blocks.solve(a, one, n, b).orderBy("i").collect()], np.linalg.solve(x, np.ones(n)))


def test_blocked_factors(spark):
    n, b = 3, 2
    x = np.array([[4.0, 2, 0], [2, 5, 3], [0, 3, 6]])
    a = cells(spark, x)
    assert np.allclose(dense(blocks.cholesky(a, n, b), (n, n)), np.linalg.cholesky(x))
    assert np.allclose(dense(blocks.inverse(a, n, b), (n, n)), np.linalg.inv(x)) and abs(blocks.determinant(a, n, b) - np.linalg.det(x)) < 1e-9
    low, up = (dense(p, (2, 2)) for p in blocks.lu(cells(spark, np.array([[4.0, 3], [6, 3]])), 2, 1))
    assert (low[1, 0], up[0, 0], up[1, 1]) == (1.5, 4, -1.5)


def test_no_pivot(spark):
    a = cells(spark, np.array([[0.0, 1], [1, 0]]))
    with pytest.raises(errors.SingularMatrix):
        blocks.lu(a, 2, 1)
    with pytest.raises(errors.MatrixNotPositiveDefinite):
        blocks.cholesky(cells(spark, np.array([[1.0, 2], [2, 1]])), 2, 1)
    with pytest.raises(errors.MatrixNotPositiveDefinite):
        blocks.cholesky(cells(spark, np.array([[4.0, 9], [2, 5]])), 2, 1)
    assert blocks.as_cells(a, np.eye(2)).where(F.col("v") == 1).count() == 2


@pytest.mark.parametrize("b", [1, 2, 4])
def test_exchange(spark, b):
    a = cells(spark, np.array([[0.0, 1], [1, 0]]))
    assert blocks.determinant(a, 2, b) == -1
    assert np.allclose(dense(blocks.inverse(a, 2, b), (2, 2)), [[0, 1], [1, 0]])
    small = cells(spark, np.array([[1e-20, 1.0], [1, 1]]))
    y = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    assert np.allclose([r.v for r in blocks.solve(small, y, 2, b).orderBy("i").collect()], [1, 1])
    singular = cells(spark, np.array([[1.0, 2, 3], [2, 4, 6], [1, 0, 1]]))
    assert blocks.determinant(singular, 3, b) == 0
    with pytest.raises(errors.SingularMatrix):
        blocks.inverse(singular, 3, b)
    assert blocks.determinant(singular.where("false"), 0, b) == 1


@pytest.mark.parametrize(("n", "b", "fan"), [(7, 2, 2), (9, 3, 32), (6, 6, 2)])
def test_pivots(spark, monkeypatch, n, b, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, n))
    x[np.arange(n), np.arange(n)] = 0  # every leading pivot is 0 or an accident
    x[0] *= 1e-8
    a = cells(spark, x)
    low, up, order = blocks.pivoted_lu(a, n, b)
    low, up = dense(low, (n, n)), dense(up, (n, n))
    assert sorted(order) == list(range(n)) and np.allclose(low, np.tril(low)) and np.allclose(np.diag(low), 1) and np.allclose(up, np.triu(up))
    assert np.allclose(low @ up, x[order], atol=1e-12) and np.abs(low).max() < 2**n
    y = rng.standard_normal((n, 3))
    assert np.allclose(dense(blocks.solve(a, cells(spark, y), n, b), (n, 3)), np.linalg.solve(x, y), rtol=1e-6)
    assert np.isclose(blocks.determinant(a, n, b), np.linalg.det(x)) and np.allclose(dense(blocks.inverse(a, n, b), (n, n)), np.linalg.inv(x), rtol=1e-6)


def test_tables_are_removed(spark):
    import os

    from tessera.operators.order import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    blocks.determinant(cells(spark, np.eye(6)[::-1]), 6, 2)
    assert len(set(os.listdir(folder)) - before) <= 2  # L and U


def test_large_determinant(spark):
    big = cells(spark, np.diag([1e200, 1e200, 1e-8]))
    assert blocks.determinant(big, 3, 2) == float("inf") and np.isclose(blocks.determinant(cells(spark, np.diag([1e200, 1e-8, 1e120])), 3, 2), 1e200 * 1e112)


@pytest.mark.parametrize("b", [1, 3, 16])
def test_product(spark, monkeypatch, b):
    monkeypatch.setattr(blocks, "HELD", 40)
    rng = np.random.default_rng(b)
    x, y = np.where(rng.random((7, 5)) < 0.5, rng.standard_normal((7, 5)), 0), rng.standard_normal((5, 8))
    x[2] = 0
    got = blocks.product(cells(spark, x), cells(spark, y), 7, 8, b)
    assert np.allclose(dense(got, (7, 8)), x @ y) and got.groupBy("i", "j").count().where("count > 1").isEmpty()
    assert blocks.product(cells(spark, x).where("false"), cells(spark, y), 7, 8, b).count() == 0


def test_products_of_thin_matrices(spark, monkeypatch):
    # 90 rows of 3: the grid is as large as the tasks and the matrix ask for, not as the product of 8100 cells
    monkeypatch.setattr(blocks, "HELD", 100)
    x = np.random.default_rng(4).standard_normal((90, 3))
    a, c = cells(spark, x), cells(spark, x.T)
    got = blocks.product(a, c, 90, 90, 4)
    assert got.rdd.getNumPartitions() == 9 and np.allclose(dense(got, (90, 90)), x @ x.T) and got.count() == 8100


@pytest.mark.parametrize("b", [2, 4])
def test_product_by_rows(spark, b):
    x = np.random.default_rng(b).standard_normal((9, 3))
    fold = lambda z, i, j: np.stack([z.sum(axis=1), np.diagonal(z) if i == j else np.zeros(len(z))], axis=1)
    got = blocks.product_by_rows(cells(spark, x), cells(spark, x.T), 9, 9, fold, ["total", "own"], b).orderBy("i").collect()
    assert [r.i for r in got] == list(range(9))
    assert np.allclose([r.total for r in got], (x @ x.T).sum(axis=1)) and np.allclose([r.own for r in got], (x * x).sum(axis=1))


def test_rows_of_the_product_have_vectors(spark, tmp_path):
    rows = [(0, [1.0] + [0.0] * 63), (2, [3.0] + [0.0] * 63), (3, None), (700, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    from tessera import registry

    got = registry.product_of_rows(spark, str(tmp_path)).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, 4, 1), (2, 12, 9), (700, 0, 0)]
