"""Whitening against NumPy and exact whole numbers."""

import numpy as np
import pytest

from tessera.llm import queries, whitening
from tessera.llm.whitening import Moments, fit, merged, symmetric_eigen, updated, whiten


def empty(d):
    return Moments(0, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))


@pytest.mark.parametrize("d", [1, 2, 3, 7, 24])
def test_eigen(d):
    rng = np.random.default_rng(d)
    cases = [np.cov(rng.standard_normal((d, 3 * d + 2))).reshape(d, d), np.zeros((d, d)), np.eye(d), np.ones((d, d)), np.diag(np.arange(d, dtype=float)), np.diag(10.0 ** -np.arange(d))]
    low = rng.standard_normal((d, max(1, d // 2)))
    for v in [*cases, low @ low.T]:
        w, q = symmetric_eigen(v)
        size = max(np.abs(v).max() * d, 1e-300)
        assert np.allclose(w, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size, rtol=0)
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-13 and np.abs(v @ q - q * w).max() < 1e-13 * size
    with pytest.raises(ValueError):
        symmetric_eigen(np.full((d, d), np.nan))


def test_moments_are_those_of_single_updates():
    rng = np.random.default_rng(1)
    x = rng.integers(10**6 - 300, 10**6 + 300, (200, 5))
    one = empty(5)
    for row in x:  # Welford's rule, row by row
        n = one.n + 1
        mean = one.mean + (row - one.mean) / n
        one = Moments(n, one.sums + row, mean, one.scatter + np.outer(row - one.mean, row - mean))
    whole = updated(updated(empty(5), x[:70]), x[70:])
    both = merged(updated(empty(5), x[:3]), updated(empty(5), x[3:]))
    centred = x - x.mean(axis=0)
    for m in (one, whole, both):
        assert m.n == 200 and (m.sums == x.sum(axis=0)).all()
        assert np.allclose(m.scatter, centred.T @ centred, rtol=1e-10, atol=1e-4)
    # deviations far below the offset survive
    near = 10**15 + rng.integers(0, 2, (50, 3))
    assert np.allclose(updated(empty(3), near).covariance, np.cov(near.T - 10**15, bias=True), atol=1e-12)


def brute(rows, components):
    size = {}
    ok = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    for _, v in ok:
        size[len(v)] = size.get(len(v), 0) + 1
    d = max(size, key=lambda k: (size[k], k))
    ok = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in ok if len(v) == d]
    x = np.array(sorted({tuple(v) for _, v in ok}))
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True).reshape(d, d)
    w, q = np.linalg.eigh(v)
    w, q = w[::-1][:components], q[:, ::-1][:, :components]
    return ok, n, s, w / np.trace(v), lambda y: (y - s / n) @ q / np.sqrt(w)


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += rows[:40] * 3 + [(i, rows[5][1]) for i in range(1000, 1200)] + [(500, [0.0] * 20), (None, rows[1][1])]
    rows += [(600, None), (601, []), (602, [1.0] * 19), (603, [float("nan")] * 20), (604, [None, *[1.0] * 19]), (605, [float("inf")] * 20)]
    table = spark.createDataFrame([(*r, 7, "w") for r in rows], "vec_id long, embedding array<double>, deviation int, Whitened string").repartition(7)
    fitted = fit(table)
    ok, n, s, shares, project = brute(rows, 16)
    assert fitted.moments.n == n and (fitted.moments.sums == s).all() and 0 <= fitted.identity_error < 1e-10
    assert np.allclose(fitted.explained, shares, rtol=1e-9)
    got = whiten(table, fitted)
    assert got.columns == ["vec_id", "embedding", "deviation_in", "Whitened_in", "deviation", "whitened"]
    got = got.collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in got) == sorted(i if i is not None else -1 for i, _ in ok)
    signs = None
    for r in got:
        y = np.array([int(np.floor(64 * c)) + 1000000 for c in r.embedding])
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, s, strict=True))
        want = project(y)
        signs = np.sign(np.array(r.whitened) * want) if signs is None else signs
        assert np.allclose(np.array(r.whitened) * signs, want, atol=1e-8)


def test_edges(spark):
    def run(rows):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return (f := fit(table)), whiten(table, f).orderBy("vec_id").collect()

    assert run([]) == (None, []) and run([(1, None), (2, [])]) == (None, [])
    f, rows = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])  # one vector: nothing to whiten
    assert f.moments.n == 1 and f.identity_error is None and f.explained == [None, None] and [(r.deviation, r.whitened) for r in rows] == [(0, [None, None])] * 2
    f, rows = run([(1, [0.0, 0.0]), (2, [1.0, 1.0])])  # one direction
    assert f.moments.n == 2 and f.identity_error < 1e-12 and np.allclose(f.explained, [1, 0])
    assert [r.deviation for r in rows] == [2 * 64**2] * 2 and [r.whitened[1] for r in rows] == [None, None] and abs(rows[0].whitened[0] + rows[1].whitened[0]) < 1e-12
    f, rows = run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])  # past a long
    assert [r.deviation for r in rows][:2] == [None, None] and all(np.isfinite(x) for r in rows for x in r.whitened if x is not None)


def test_registered(spark):
    rows = queries.op13_whitening(spark, "/root/testdata/sf0.001").toPandas()
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    ok, n, s, shares, project = brute([(r.vec_id, None if r.embedding is None else list(map(float, r.embedding))) for r in source.itertuples()], 16)
    assert len(rows) == 16 * len(ok) and set(rows.n) == {n} and rows.identity_error.max() < 1e-4
    x = dict(ok)
    for vec_id, g in rows.groupby("vec_id"):
        g = g.sort_values("component")
        assert g.component.tolist() == list(range(1, 17)) and np.allclose(g.explained, shares, rtol=1e-9)
        assert np.allclose(np.abs(g.whitened), np.abs(project(np.array(x[vec_id]))), atol=1e-7)
