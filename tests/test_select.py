"""Order statistics against sorted lists, with lanes that are narrowed over several rounds."""

import math
import random

import pytest

from tessera import errors
from tessera.operators import arrays, select


def rank_key(x):
    return (math.isnan(x), x)


@pytest.mark.parametrize(("limit", "bits", "heavy"), [(1 << 16, 16, 1 << 12), (3, 16, 4)])
def test_median(spark, monkeypatch, limit, bits, heavy):
    for name, v in (("LIMIT", limit), ("BITS", bits), ("HEAVY", heavy)):
        monkeypatch.setattr(select, name, v)
    rng = random.Random(limit)
    special = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, math.inf, -math.inf, 1.5, 1.5000000000000002]
    lanes = {"a": [rng.gauss(0, 1) for _ in range(101)], "b": [2.5] * 40 + [1.0] * 40, "c": [7.0], "d": special * 3 + [math.nan], None: [rng.choice(special) for _ in range(30)], "e": []}
    rows = [(k, v) for k, vs in lanes.items() for v in vs] + [("a", None), ("e", None)]
    rng.shuffle(rows)
    a = spark.createDataFrame(rows, "lane string, v double").repartition(3)
    got = {r.lane: r.median for r in select.median(a, ["lane"]).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, m in got.items():
        vs = sorted(lanes[k], key=rank_key)
        want = vs[len(vs) // 2] if len(vs) % 2 else (vs[len(vs) // 2 - 1] + vs[len(vs) // 2]) / 2
        assert m == want or (math.isnan(m) and math.isnan(want)), k
    assert select.median(a.where("lane = 'b'")).first().median == 1.75
    assert select.median(a.where("false")).first().median is None
    r = arrays.reduce_(a.where("lane = 'a'"), ["median", "count"], ["lane"]).first()
    assert r["median"] == sorted(lanes["a"])[50] and r["count"] == 101


@pytest.mark.parametrize("limit", [1 << 16, 2])
@pytest.mark.parametrize("kind", ["double", "long"])
def test_partition(spark, monkeypatch, limit, kind):
    monkeypatch.setattr(select, "LIMIT", limit)
    values = [5, 3, 3, 9, 1, 3, 7, 3, 2**60 + 1, -(2**60) - 1, 2**60] if kind == "long" else [5.0, 3.0, 3.0, 9.0, 1.0, math.nan, 3.0, -0.0, 0.0, 3.0, -math.inf]
    a = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], f"idx long, v {kind}").repartition(3)
    order = sorted(range(len(values)), key=lambda i: (*rank_key(values[i]), i))
    for k in (0, 3, 4, len(values) - 1):
        got = [r.idx for r in select.argpartition(a, k).orderBy("k").collect()]
        assert got == [*sorted(order[:k]), order[k], *sorted(order[k + 1 :])]
    parted = [r.v for r in select.partition(a, 4).orderBy("idx").collect()]
    assert len(parted) == len(values) and repr(parted[4]) in {repr(values[order[4]]), repr(-values[order[4]])}
    for k in (-1, len(values)):
        with pytest.raises(errors.IndexOutOfBounds):
            select.partition(a, k)


def test_ranks(spark):
    a = spark.createDataFrame([("x", i % 5) for i in range(50)], "lane string, v int")
    r = select.order_statistics(a, ["lane"], lambda n: [n - n, n - 1, n, n / 2]).orderBy("t").collect()
    assert [(x.t, x["rank"], x.v, x.below, x.n) for x in r] == [(0, 0, 0, 0, 10), (1, 49, 4, 40, 10), (3, 25, 2, 20, 10)]
