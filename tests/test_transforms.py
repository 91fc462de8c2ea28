"""Transforms of lanes that are split, and polynomials in array columns, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linalg


@pytest.mark.parametrize("inverse", [False, True])
def test_split_lanes(spark, inverse):
    rng = np.random.default_rng(1)
    series = {k: rng.standard_normal(n) + 1j * rng.standard_normal(n) for k, n in {1: 60, 2: 64, 3: 7, 4: 1, 5: 60, 6: 13, None: 35}.items()}
    rows = [(k, i, float(z.real), float(z.imag)) for k, x in series.items() for i, z in enumerate(x)]
    got = linalg.fft(spark.createDataFrame(rows, "key long, idx long, re double, im double").repartition(4), inverse, lane=10).collect()
    for k, x in series.items():
        own = sorted((r.idx, complex(r.re, r.im)) for r in got if r.key == k)
        assert [i for i, _ in own] == list(range(len(x))) and np.allclose([z for _, z in own], (np.fft.ifft if inverse else np.fft.fft)(x))


def test_lanes_across_batches(spark):
    # lanes are met cell by cell, in batches that end within them, and cells left out at their ends are not sent
    rng = np.random.default_rng(5)
    series = {k: rng.standard_normal(n) for k, n in enumerate((29, 30, 3, 29, 16, 1))}
    rows = spark.createDataFrame([(k, i, float(v), 0.0) for k, x in series.items() for i, v in enumerate(x)], "key long, idx long, re double, im double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        turned = linalg.fft(rows, lane=6)
        got = turned.collect()
        padded = linalg._of_powers(rows.where("key < 2").withColumn("size", F.lit(64).cast("long")), ["key", "size"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in turned._jdf.queryExecution().toString()
    for k, x in series.items():
        own = sorted((r.idx, complex(r.re, r.im)) for r in got if r.key == k)
        assert [i for i, _ in own] == list(range(len(x))) and np.allclose([z for _, z in own], np.fft.fft(x))
    for k in (0, 1):
        own = sorted((r.idx, complex(r.re, r.im)) for r in padded if r.key == k)
        assert len(own) == 64 and np.allclose([z for _, z in own], np.fft.fft(series[k], 64))


def test_arrays_of_several_sizes(spark):
    held = {k: np.random.default_rng(k).standard_normal(shape) for k, shape in {1: (2, 2), 2: (4, 4), 3: (1, 5)}.items()}
    cells = spark.createDataFrame([(k, *p, float(v), 0.0) for k, x in held.items() for p, v in np.ndenumerate(x)], "k long, i long, j long, re double, im double")
    back = {(r.k, r.i, r.j): r.re for r in linalg.fftn(linalg.fftn(cells, ["i", "j"], by=["k"]), ["i", "j"], inverse=True, by=["k"]).collect()}
    assert len(back) == 25 and all(abs(back[k, *p] - v) < 1e-12 for k, x in held.items() for p, v in np.ndenumerate(x))


def test_arrays_of_axes(spark):
    x = np.random.default_rng(2).standard_normal((3, 4, 5))
    cells = spark.createDataFrame([(*p, float(v), 0.0) for p, v in np.ndenumerate(x)], "i long, j long, k long, re double, im double")
    there = linalg.fftn(cells, ["i", "j", "k"])
    got = {(r.i, r.j, r.k): complex(r.re, r.im) for r in there.collect()}
    assert np.allclose([got[p] for p in np.ndindex(x.shape)], np.fft.fftn(x).ravel())
    back = {(r.i, r.j, r.k): r.re for r in linalg.fftn(there, ["i", "j", "k"], inverse=True).collect()}
    assert np.allclose([back[p] for p in np.ndindex(x.shape)], x.ravel())
    lanes = cells.where("i = 0 and j < 2").select("j", F.col("k").alias("idx"), F.col("re").alias("v"))
    waves = {(r.j, r.k): complex(r.re, r.im) for r in linalg.dft(lanes, 5, ["j"]).collect()}
    assert np.allclose([waves[p] for p in np.ndindex(2, 5)], np.fft.fft(x[0, :2], axis=1).ravel())


def test_polynomials(spark):
    cases = [([1.0, 2.0, -2.0], [1.0, 0.0]), ([1.0], [3.0, 2.0, 1.0]), ([2.0, 0.0, 0.0], [1.0, -2.0]), ([], [1.0])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k long, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select("k", linalg.polyadd(a, b).alias("add"), linalg.polysub(a, b).alias("sub"), linalg.polymul(a, b).alias("mul"), linalg.polyder(b).alias("der"), linalg.polyder(b, 2).alias("der2"), linalg.polyint(b, 2, 4.0).alias("int"), linalg.roots(a).alias("roots")).orderBy("k").collect()
    for (x, y), r in zip(cases[:3], got, strict=False):
        assert r["mul"] == np.convolve(x, y).tolist()
        n = max(len(x), len(y))
        x_, y_ = [0.0] * (n - len(x)) + x, [0.0] * (n - len(y)) + y
        assert r["add"] == [p + q for p, q in zip(x_, y_, strict=True)] and r["sub"] == [p - q for p, q in zip(x_, y_, strict=True)]
        assert r["der"] == (np.polyder(np.array(y)).tolist() or [0.0]) and np.allclose(r["int"], np.polyint(np.array(y), 2, k=[4.0, 4.0]))
        assert r["der2"] == (np.polyder(np.array(y), 2).tolist() or [0.0])
    assert got[3]["mul"] == [] and got[3]["roots"] == [] and got[3]["add"] == [1.0]
    assert np.allclose(got[0]["roots"], [math.sqrt(3) - 1, -math.sqrt(3) - 1]) and got[1]["roots"] == []
    with pytest.raises(Exception, match="leading coefficient"):
        rows.select(linalg.roots(F.array(F.lit(0.0), F.lit(1.0)))).collect()
