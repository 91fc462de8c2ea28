"""Interpolation from tables, convolution of tables, Krylov iteration, roots, draws and differentiation against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import errors, registry
from tessera.functions import draws, roots
from tessera.operators import interp, krylov, linalg, signal
from tessera.plans.tensor import Tensor, gradients


def table(spark, xs, names="idx long, v double"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], names).repartition(3)


@pytest.mark.parametrize("kind", ["linear", "nearest"])
@pytest.mark.parametrize("bounds", ["clamp", "fill", "extrapolate"])
def test_interpolate(spark, kind, bounds):
    rng = np.random.default_rng(1)
    xs = np.unique(rng.integers(-50, 50, 40)).astype(float)
    ys = rng.standard_normal(len(xs))
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys, strict=True)] + [(None, 1.0), (float("nan"), 2.0), (99.0, None)], "x double, y double").repartition(4)
    at = [*rng.uniform(-60, 60, 150), *xs, *[xs[3] + 0.25] * 60, (xs[0] + xs[1]) / 2]
    points = spark.createDataFrame([(i, float(a), "p") for i, a in enumerate(at)] + [(-1, None, "n"), (-2, float("nan"), "n")], "id long, x double, y string").repartition(5)
    got = {r.id: r.y for r in interp.interpolate(points, knots, kind=kind, bounds=bounds, fill=7.0).collect()}
    assert len(got) == len(at) + 2 and got[-1] is None and math.isnan(got[-2])
    for i, a in enumerate(at):
        k = min(max(int((xs <= a).sum()), 1), len(xs) - 1)
        x0, y0, x1, y1 = xs[k - 1], ys[k - 1], xs[k], ys[k]
        want = y0 + (a - x0) * (y1 - y0) / (x1 - x0) if kind == "linear" else (y0 if a - x0 <= x1 - a else y1)
        if a < xs[0] or a > xs[-1]:
            end = ys[0] if a < xs[0] else ys[-1]
            want = {"clamp": end, "fill": 7.0, "extrapolate": want if kind == "linear" else end}[bounds]
        assert got[i] == pytest.approx(want, abs=1e-9), a


def test_interpolate_edges(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    points = spark.createDataFrame([(0.5,), (1.0,)], "x double")
    assert sorted(r.y for r in interp.interpolate(points, knots, bounds="raise").collect()) == [2, 3]
    assert interp.interpolate(points.where("false"), knots).count() == 0
    with pytest.raises(Exception, match="IndexOutOfBounds"):
        interp.interpolate(spark.createDataFrame([(1.5,)], "x double"), knots, bounds="raise").collect()
    for few in (knots.limit(1), knots.union(knots)):
        with pytest.raises(errors.DimensionMismatch):
            interp.interpolate(points, few)


@pytest.mark.parametrize(("short", "direct", "n", "m"), [(1 << 14, 256, 50, 7), (1 << 14, 256, 1, 1), (16, 4, 9, 40), (16, 4, 12, 12), (3, 2, 12, 7)])
def test_convolve_tables(spark, monkeypatch, short, direct, n, m):
    monkeypatch.setattr(signal, "SHORT", short)
    monkeypatch.setattr(signal, "DIRECT", direct)
    rng = np.random.default_rng(n)
    x, y = rng.standard_normal(n), rng.standard_normal(m)
    for mode in ("full", "same", "valid"):
        got = [r.v for r in signal.convolve_tables(table(spark, x), table(spark, y), mode=mode).orderBy("idx").collect()]
        assert np.allclose(got, np.convolve(x, y, mode), atol=1e-12) and len(got) == len(np.convolve(x, y, mode))
    got = [r.v for r in signal.correlate_tables(table(spark, x), table(spark, y)).orderBy("idx").collect()]
    assert np.allclose(got, np.correlate(x, y, "full"), atol=1e-12)


def test_long_kernels_go_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(signal, "_by_transforms", None)  # of two long vectors alone
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal(90_000), rng.standard_normal(20_000)
    rows = spark.range(90_000).select(F.col("id").alias("idx"))
    a, b = (rows.where(F.col("idx") < len(v)).mapInPandas(lambda ts, v=v: (t.assign(v=v[t.idx]) for t in ts), "idx long, v double") for v in (x, y))
    got = np.array([r.v for r in signal.convolve_tables(a, b, mode="valid").orderBy("idx").collect()])
    at = np.array([0, 1, 35_000, 70_000])
    assert len(got) == 70_001 and np.allclose(got[at], [x[k : k + 20_000] @ y[::-1] for k in at], atol=1e-9)


def test_convolve_edges(spark):
    a = table(spark, [1, None, 2])
    assert [r.v for r in signal.convolve_tables(a, table(spark, [1, 1]), n=4).orderBy("idx").collect()] == [1, 1, 2, 2, 0]
    with pytest.raises(errors.DimensionMismatch):
        signal.convolve_tables(a, a.where("false"))


@pytest.mark.parametrize("lane", [4, 8])
def test_transform_of_any_length(spark, lane):
    rng = np.random.default_rng(lane)
    series = {n: rng.standard_normal(n) + 1j * rng.standard_normal(n) for n in (1, 4, 13, 22, 31, 64)}
    rows = spark.createDataFrame([(n, k, float(z.real), float(z.imag)) for n, x in series.items() for k, z in enumerate(x)], "key long, idx long, re double, im double")
    for inverse in (False, True):
        got = {n: np.zeros(n, complex) for n in series}
        for r in linalg.fft(rows, inverse, lane=lane).collect():
            got[r.key][r.idx] = r.re + 1j * r.im
        for n, x in series.items():
            assert np.allclose(got[n], np.fft.ifft(x) if inverse else np.fft.fft(x), atol=1e-10), n


def cells(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v], "i long, j long, v double")


@pytest.mark.parametrize("symmetric", [True, False])
def test_krylov(spark, symmetric):
    rng = np.random.default_rng(4)
    n = 30
    x = np.where(rng.random((n, n)) < 0.3, rng.standard_normal((n, n)), 0)
    x = x + x.T if symmetric else x
    x += np.diag(np.linspace(0, 6, n))
    a = cells(spark, x)
    w, z = krylov.eigs(a, n, 3, symmetric, steps=14, tolerance=1e-8)
    want = np.linalg.eigvals(x)
    want = want[np.argsort(-np.abs(want))][:3]
    assert np.allclose(np.sort_complex(w), np.sort_complex(want), atol=1e-6) and (not symmetric or np.isrealobj(w))
    assert (krylov.residuals(a, w, z) < 1e-6).all()
    rows = z.orderBy("i").collect()
    v = np.array([r.re for r in rows]) + 1j * np.array([r.im for r in rows])
    assert np.allclose(x @ v, v * w, atol=1e-6) and np.allclose(np.linalg.norm(v, axis=0), 1)


def test_krylov_stops_when_found(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(krylov, "_times_vector", lambda a, b, k, f=krylov._times_vector: (taken.append(a.inputFiles()), f(a, b, k))[1])
    x = np.diag([50.0, -40.0, *np.linspace(0, 1, 28)])
    w, z = krylov.eigs(cells(spark, x), 30, 2, True, tolerance=1e-7)
    assert np.allclose(w, [50, -40]) and len(taken) < 20 and len(z.first().re) == 2
    assert all(files for files in taken)  # a written table, not its making, is read in each step


def test_krylov_edges(spark):
    w, _ = krylov.eigs(cells(spark, np.eye(5)), 5, 3, True)
    assert np.allclose(w, 1)
    w, _ = krylov.eigs(cells(spark, np.array([[0.0, -2], [2, 0]])), 2, 2)
    assert np.allclose(w, [2j, -2j])
    w, _ = krylov.eigs(cells(spark, np.eye(3)).where("false"), 3, 2)
    assert np.allclose(w, 0)
    with pytest.raises(errors.DimensionMismatch):
        krylov.eigs(cells(spark, np.eye(3)), 3, 4)


def test_roots(spark):
    polynomials = [[1, 0, 1], [1, -3, 2], [2, -4, 2], [1, 0, 0, -1], [1, 0, 0], [5], [], [1, -6, 11, -6], [1e-8, 1, 1e8], list(np.poly([1, 2, 3, 4, 5, -7.5])), [1, 2, 3, 4, 5]]
    rows = spark.createDataFrame([(k, [float(c) for c in p]) for k, p in enumerate(polynomials)] + [(99, None), (98, [1.0, None])], "k long, p array<double>")
    got = {r.k: (r.z, r.x) for r in rows.select("k", roots.complex_roots(F.col("p")).alias("z"), roots.roots(F.col("p")).alias("x")).collect()}
    assert got[99] == got[98] == (None, None) and got[0][1] == [] and got[5] == got[6] == ([], [])
    for k, p in enumerate(polynomials):
        want = np.roots(p) if p else np.array([])
        z = np.array([x.re + 1j * x.im for x in got[k][0]])
        near = 1e-4 if k == 2 else 1e-6 * max([1.0, *np.abs(want)])
        assert len(z) == len(want) and all(np.abs(z - w).min() < near and np.abs(want - y).min() < near for w, y in zip(want, z, strict=True))
    assert got[1][1] == pytest.approx([2, 1]) and got[7][1] == pytest.approx([3, 2, 1]) and got[9][1] == pytest.approx([5, 4, 3, 2, 1, -7.5])
    with pytest.raises(Exception, match="SingularMatrix"):
        rows.select(roots.complex_roots(F.array(F.lit(0.0), F.lit(1.0)))).collect()
    assert "Python" not in rows.select(roots.roots(F.col("p")))._jdf.queryExecution().toString()


def test_roots_of_squares(spark):
    # from the formula a double root is exact, which steps towards it are not
    rows = spark.createDataFrame([([1.0, -6.0, 9.0],), ([1.0, 0.0, 0.0],), ([1.0, 0.0, 4.0],), ([1.0, -1e9, 1.0],)], "p array<double>")
    got = [[(z.re, z.im) for z in r.z] for r in rows.select(roots.complex_roots(F.col("p")).alias("z")).collect()]
    assert got[:3] == [[(3, 0), (3, 0)], [(0, 0), (0, 0)], [(0, 2), (0, -2)]]
    assert got[3][0][0] == pytest.approx(1e9) and got[3][1][0] == pytest.approx(1e-9, rel=1e-12)


def test_root_queries_are_dealt_out(spark, tmp_path):
    spark.range(9000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("poly_roots", "complex_roots"):
        assert registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 4  # of one file


def test_generator(spark):
    # published test vectors of the generator: counter and key all 0, and all ones
    r = spark.range(1).select(draws.words(0, F.lit(0)).alias("w"), draws.words((1 << 64) - 1, F.lit(-1), 0xFFFFFFFF).alias("x")).first()
    assert [r.w[k] for k in range(4)] == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]

    def plain(seed, index, stream=0):
        c, k = [index & 0xFFFFFFFF, index >> 32 & 0xFFFFFFFF, stream, 0], [seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF]
        for _ in range(10):
            p, q = 0xD2511F53 * c[0], 0xCD9E8D57 * c[2]
            c = [q >> 32 ^ c[1] ^ k[0], q & 0xFFFFFFFF, p >> 32 ^ c[3] ^ k[1], p & 0xFFFFFFFF]
            k = [k[0] + 0x9E3779B9 & 0xFFFFFFFF, k[1] + 0xBB67AE85 & 0xFFFFFFFF]
        return c

    rows = spark.createDataFrame([(i,) for i in (0, 1, 2**31, 2**40 + 7, -5)], "i long").select("i", draws.words(2**45 + 9, F.col("i"), 3).alias("w")).collect()
    for r in rows:
        assert [r.w[k] for k in range(4)] == plain(2**45 + 9, r.i, 3)


def test_draws(spark):
    n = 20_000

    def drawn(parts):
        i = F.col("id")
        columns = {"u": draws.uniform(7, i, -1, 3), "z": draws.normal(7, i, 2, 3), "r": draws.randint(7, i, -2, 4), "e": draws.exponential(7, i, 0.5), "p": draws.poisson(7, i, 3.5), "q": draws.poisson(7, i, 5000.0), "o": draws.poisson(7, i, 0.0), "m": draws.poisson(7, i, 12.0)}
        return spark.range(0, n, 1, parts).select("id", *(c.alias(k) for k, c in columns.items())).toPandas().sort_values("id").reset_index(drop=True)

    x = drawn(1)
    assert x.equals(drawn(7))
    near = lambda a, b, s: abs(a - b) < 5 * s / math.sqrt(n)
    assert near(x.u.mean(), 1, 4 / math.sqrt(12)) and x.u.between(-1, 3).all() and near(x.z.mean(), 2, 3) and abs(x.z.std() - 3) < 0.1
    assert sorted(x.r.unique()) == list(range(-2, 4)) and near(x.e.mean(), 2, 2) and (x.e >= 0).all() and (x.o == 0).all()
    for k, mean in (("p", 3.5), ("q", 5000.0), ("m", 12.0)):
        assert near(x[k].mean(), mean, math.sqrt(mean)) and abs(x[k].var() / mean - 1) < 0.06
    for k, mean in (("p", 3.5), ("m", 12.0)):
        for c in range(3, 16):
            want = math.exp(c * math.log(mean) - mean - math.lgamma(c + 1))
            assert near((x[k] == c).mean(), want, math.sqrt(want))


def test_gradients(spark):
    rng = np.random.default_rng(2)
    x, y, t = rng.standard_normal((5, 6)), rng.standard_normal((5, 3)), np.abs(rng.standard_normal((5, 4)))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(x, y, t, strict=True)], "x array<double>, y array<double>, t array<double>").repartition(2)
    weights = [rng.standard_normal((3, 4)), rng.standard_normal(4), rng.standard_normal((2, 1)), rng.standard_normal((4, 4))]

    def loss(w):
        a, b, c, d = w
        h = (Tensor.column("x", 2, 3).mul(c) @ a + b).tanh()  # 2 by 4, by two broadcasts
        g = (Tensor.column("y", 3) @ a).sigmoid()
        both = h * g  # a product of two inputs' branches
        first = (both @ d).relu().sum() * 0.5
        return first + (g @ d).softmax().cross_entropy_loss(Tensor.column("t", 4)) + (g * g).mse_loss(Tensor.column("t", 4))

    tensors = [Tensor.weight(w) for w in weights]
    total, got = gradients(df, loss(tensors), tensors)

    def plain(ws):
        a, b, c, d = ws
        out = 0.0
        for i in range(5):
            h = np.tanh((x[i].reshape(2, 3) * c) @ a + b)
            g = 1 / (1 + np.exp(-(y[i] @ a)))
            s = np.exp(g @ d)
            out += 0.5 * np.maximum((h * g) @ d, 0).sum() - (t[i] * np.log(s / s.sum())).sum() + ((g * g - t[i]) ** 2).mean()
        return out

    assert total == pytest.approx(plain(weights))
    for k, w in enumerate(weights):
        for at in np.ndindex(*w.shape):
            up, down = ([v.copy() for v in weights] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert got[k][at] == pytest.approx((plain(up) - plain(down)) / 2e-5, abs=1e-6)
    total, got = gradients(df.where("false"), loss(tensors), tensors)
    assert total == 0 and all((g == 0).all() for g in got)
    with pytest.raises(errors.DimensionMismatch):
        Tensor.column("x", 2, 3) @ Tensor.weight(np.eye(2))
