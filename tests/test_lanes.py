"""Lanes that lie in several partitions and blocks: sorting, differences, types."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import elementwise as ew
from tessera.operators import arrays, order


@pytest.fixture
def lanes(spark):
    rng = random.Random(5)
    held = {(1, "x"): [rng.randint(0, 9) for _ in range(300)], (1, None): [4] * 50, (2, "x"): [3.5], (None, "y"): [rng.random() for _ in range(20)]}
    rows = [(p, q, i, float(v)) for (p, q), vs in held.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    return held, spark.createDataFrame(rows, "p int, q string, idx long, v double").repartition(5)


def collected(df, at):
    out = {}
    for r in df.orderBy(at).collect():
        out.setdefault((r.p, r.q), []).append(r)
    return out


def test_sorted_lanes(spark, lanes):
    held, a = lanes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collected(arrays.sort(a, "idx", ["p", "q"]), "idx")
        args = collected(arrays.argsort(a, "idx", ["p", "q"]), "k")
        assert order.in_lanes(a, ["p", "q"], ["v", "idx"], "k").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(held) == set(args)
    for k, vs in held.items():
        want = sorted(range(len(vs)), key=lambda i: (vs[i], i))
        assert [(r.idx, r.v) for r in got[k]] == [(n, vs[i]) for n, i in enumerate(want)]
        assert [(r.k, r.idx) for r in args[k]] == list(enumerate(want))
    one = arrays.sort(a.where("p = 1 and q = 'x'").select("idx", "v"), "idx", []).orderBy("idx").collect()
    assert [r.v for r in one] == sorted(held[1, "x"]) and [r.idx for r in one] == list(range(300))
    assert arrays.sort(a.where("false"), "idx", ["p", "q"]).count() == 0


@pytest.mark.parametrize("block", [1 << 12, 7, 1])
def test_neighbours(spark, lanes, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", block)
    held, a = lanes
    for n in (1, 2, 3):
        got = collected(arrays.diff(a, "idx", ["p", "q"], n), "idx")
        for k, vs in held.items():
            for _ in range(n):
                vs = [y - x for x, y in zip(vs, vs[1:], strict=False)]
            assert [r.idx for r in got.get(k, [])] == list(range(len(vs))) and [r.v for r in got.get(k, [])] == pytest.approx(vs, abs=1e-12)
    got = collected(arrays.gradient(a, "idx", ["p", "q"]), "idx")
    for k, vs in held.items():
        n = len(vs) - 1
        want = [None] if n == 0 else [vs[1] - vs[0], *((vs[i + 1] - vs[i - 1]) / 2 for i in range(1, n)), vs[n] - vs[n - 1]]
        assert [r.v for r in got[k]] == want
    a = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, 7.0)], "idx long, v double")
    assert [r.v for r in arrays.gradient(a, "idx", []).orderBy("idx").collect()] == [None, 1.0, None, 4.0]
    assert [r.v for r in arrays.diff(a, "idx", []).orderBy("idx").collect()] == [None, None, 4.0]
    plan = arrays.diff(a, "idx", [])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_whole_numbers(spark):
    big = 2**53
    a = spark.createDataFrame([("a", big + 1), ("a", 5), ("b", -3), ("b", None), ("c", None), ("b", -big - 1), ("d", 0), ("d", big * 512)], "k string, v long")
    r = {x.k: x for x in arrays.reduce_(a, ["sum", "prod", "min", "max", "mean", "count", "mean_trunc"], ["k"]).collect()}
    assert (r["a"]["sum"], r["a"]["max"], r["a"]["min"], r["a"]["prod"]) == (big + 6, big + 1, 5, 5 * (big + 1))
    assert (r["b"]["sum"], r["b"]["prod"], r["b"]["mean_trunc"]) == (-big - 4, 3 * (big + 1), -(big + 4) // 2)
    assert (r["c"]["sum"], r["c"]["prod"], r["c"]["count"]) == (None, 1, 0) and r["d"]["prod"] == 0
    whole = arrays.reduce_(a.where("k = 'a'"), ["max", "prod"]).first()
    assert (whole["max"], whole["prod"]) == (big + 1, 5 * (big + 1))
    with pytest.raises(Exception, match="exceeds a long"):
        arrays.reduce_(spark.createDataFrame([(big,), (big,)], "v long"), ["prod"]).collect()
    c = a.where("k = 'a'").select(ew.clip(F.col("v"), 6, 2**62).alias("c"), ew.floor(F.col("v")).alias("f"), ew.ceil(F.col("v")).alias("g")).collect()
    assert sorted(tuple(x) for x in c) == [(6, 5, 5), (big + 1, big + 1, big + 1)]
    d = spark.createDataFrame([(-1e-20,), (-0.5,), (2.5,), (float("inf"),), (float("nan"),), (None,), (1e300,), (-3.0,)], "v double").select(ew.floor(F.col("v")).alias("f"), ew.ceil(F.col("v")).alias("g"), ew.clip(F.col("v"), -1, 2.5).alias("c")).collect()
    assert repr([tuple(x) for x in d]) == repr([(-1.0, 0.0, -1e-20), (-1.0, 0.0, -0.5), (2.0, 3.0, 2.5), (float("inf"), float("inf"), 2.5), (float("nan"),) * 3, (None, None, None), (1e300, 1e300, 2.5), (-3.0, -3.0, -1.0)])


def test_squeeze(spark):
    a = spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double")
    assert arrays.squeeze(a, "j").collect() == [(0, 1.0)]
    with pytest.raises(Exception, match="DimensionMismatch"):
        arrays.squeeze(a.withColumn("j", F.lit(1)), "j").collect()
