"""Rules at the edges: 64-bit integers, nan and infinities, null lanes, empty arrays, places and slices, large means."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import elementwise as ew
from tessera.operators import arrays as ar
from tessera.operators import create
from tessera.sources import load, read_csv, save, write_csv

NAN, INF = math.nan, math.inf
BIG = 2**53


def column(spark, kind, xs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"k long, x {kind}").select("k", f(F.col("x")).alias("y")).orderBy("k")
    return [r.y for r in rows.collect()]


def same(a, b):
    return all((x is None and y is None) or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b, strict=True))


def test_longs_are_compared_as_longs(spark):
    pairs = [(BIG, BIG + 1), (BIG + 1, BIG), (BIG, BIG), (-BIG - 1, -BIG), (2**63 - 1, 2**63 - 2), (None, 1)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k long, a long, b long")
    a, b = F.col("a"), F.col("b")
    fs = {"eq": ew.equal, "ne": ew.not_equal, "gt": ew.greater, "ge": ew.greater_equal, "lt": ew.less, "le": ew.less_equal, "mx": ew.maximum, "mn": ew.minimum}
    got = rows.select(*(f(a, b).alias(n) for n, f in fs.items())).collect()
    want = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "mx": max, "mn": min}
    for n, f in want.items():
        assert [r[n] for r in got] == [None if x is None else f(x, y) for x, y in pairs], n
    assert column(spark, "long", [BIG, BIG + 1], lambda x: ew.replace(x, BIG, -1)) == [-1, BIG + 1]


def test_floor_and_ceil(spark):
    xs = [NAN, INF, -INF, 1e300, -1e300, 2.5, -2.5, -0.5, float(BIG), None]
    assert same(column(spark, "double", xs, ew.floor), [NAN, INF, -INF, 1e300, -1e300, 2.0, -3.0, -1.0, float(BIG), None])
    assert same(column(spark, "double", xs, ew.ceil), [NAN, INF, -INF, 1e300, -1e300, 3.0, -2.0, 0.0, float(BIG), None])


def test_division_by_both_zeros(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, -0.0), (2, -1.0, -0.0), (3, 0.0, -0.0), (4, 6.0, -2.0)], "k long, a double, b double")
    assert same([r.d for r in rows.select("k", ew.div(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()], [INF, -INF, INF, NAN, -3.0])


def test_astype(spark):
    assert column(spark, "double", [2.9, -2.9, NAN, INF, 1e300, None], lambda x: ew.astype(x, "long")) == [2, -2, None, None, None, None]


@pytest.mark.parametrize("lam", [0.0, 0.5, 800.0, 25_000.0])
def test_poisson(spark, lam):
    got = create.poisson(spark, 3000, 5, lam).agg(F.avg("v"), F.var_pop("v"), F.min("v"), F.count_distinct("v")).first()
    assert abs(got[0] - lam) <= 5 * math.sqrt(lam / 3000) and abs(got[1] - lam) <= 0.15 * lam and got[2] >= 0 and (got[3] > 50 or lam < 100)


def test_softmax_of_null_lanes_and_whole_arrays(spark):
    rows = spark.createDataFrame([(None, 0, 1.0), (None, 1, 1.0), ("a", 0, 1000.0), ("a", 1, 0.0)], "lane string, idx long, v double")
    got = {(r.lane, r.idx): r.v for r in ar.softmax(rows, ["lane"]).collect()}
    assert got == {(None, 0): 0.5, (None, 1): 0.5, ("a", 0): 1.0, ("a", 1): 0.0}
    whole = [r.v for r in ar.softmax(rows.where("lane is null").drop("lane")).collect()]
    assert whole == [0.5, 0.5] and ar.softmax(rows.where("false")).count() == 0


def test_argmax_of_the_least_long(spark):
    least = -(2**63)
    rows = spark.createDataFrame([("a", 0, least), ("a", 1, least), ("b", 0, least), ("b", 3, 5), ("b", 2, 5)], "lane string, idx long, v long")
    assert sorted(map(tuple, ar.argmax(rows.withColumn("v", F.col("v")), "idx", ["lane"]).collect())) == [("a", 0), ("b", 2)]


def vec(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "idx long, v double").withColumn("k", F.lit(0))


def values(df):
    return [r.v for r in df.orderBy("idx").collect()]


def test_differences_of_null_cells_leave_no_gap(spark):
    assert values(ar.diff(vec(spark, [1.0, None, 4.0, 6.0]), "idx", ["k"])) == [None, None, 2.0]
    assert values(ar.diff(vec(spark, [1.0]), "idx", ["k"])) == []


def test_convolution_of_lanes_of_any_length(spark):
    rows = spark.createDataFrame([("a", i, float(i + 1)) for i in range(5)] + [("b", i, 1.0) for i in range(2)] + [(None, 0, 2.0)], "lane string, idx long, v double")

    def got(mode):
        out = {}
        for r in ar.convolve(rows, [0.0, 1.0, 0.5], mode=mode, by=["lane"]).orderBy("idx").collect():
            out.setdefault(r.lane, []).append(r.v)
        return out

    # as numpy.convolve gives them
    assert got("full") == {"a": [0, 1, 2.5, 4, 5.5, 7, 2.5], "b": [0, 1, 1.5, 0.5], None: [0, 2, 1]}
    assert got("same") == {"a": [1, 2.5, 4, 5.5, 7], "b": [0, 1, 1.5], None: [0, 2, 1]}
    assert got("valid") == {"a": [2.5, 4, 5.5], "b": [1, 1.5], None: [0, 2, 1]}


def mat(spark, rows):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "i long, j long, v double")


def test_places(spark):
    a, axes, shape = mat(spark, [[1, 2], [3, 4]]), ["i", "j"], (2, 2)
    assert ar.get(a, axes, shape, (1, 0)).collect()[0].v == 3
    assert sorted(r.v for r in ar.set_(a, axes, shape, (1, 0), 9.0).collect()) == [1, 2, 4, 9]
    for place, error in (((2, 0), errors.IndexOutOfBounds), ((-1, 0), errors.IndexOutOfBounds), ((0,), errors.RankMismatch)):
        for f in (lambda p: ar.get(a, axes, shape, p), lambda p: ar.set_(a, axes, shape, p, 0.0)):
            with pytest.raises(error):
                f(place)


def test_slices(spark):
    a, axes, shape = mat(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]]), ["i", "j"], (3, 3)
    assert sorted(map(tuple, ar.slices(a, axes, shape, [1, (0, 99, 2)]).collect())) == [(0, 4.0), (1, 6.0)]
    assert sorted(map(tuple, ar.slices(a, axes, shape, [(1, 3), 0]).collect())) == [(0, 4.0), (1, 7.0)]
    assert ar.slices(a, axes, shape, [None, None]).count() == 9
    assert ar.slice_shape(shape, [1, (0, 3, 2)]) == (2,) and ar.slice_shape(shape, [None, (2, 2)]) == (3, 0)
    with pytest.raises(errors.IndexOutOfBounds):
        ar.slice_shape(shape, [None, (0, 4)])
    for parts, error in (([3, None], errors.IndexOutOfBounds), ([(3, 3), None], errors.IndexOutOfBounds), ([(0, 1, 0), None], errors.DimensionMismatch), ([None], errors.RankMismatch)):
        with pytest.raises(error):
            ar.slices(a, axes, shape, parts)


def test_kept_axes_and_shapes(spark):
    a = mat(spark, [[2, 1], [1, 1]])
    assert sorted(map(tuple, ar.reduce_(a, ["sum"], ["j"], keep=["i"]).select("i", "j", "sum").collect())) == [(0, 0, 3.0), (0, 1, 2.0)]
    assert ar.are_broadcastable((2, 1), (1, 3)) and not ar.are_broadcastable((2,), (3,))


def test_shuffle_moves_whole_slices(spark):
    a = mat(spark, [[i, -i] for i in range(50)])
    got = {(r.i, r.j): r.v for r in create.shuffle(a, "i", 50, 3).collect()}
    order = [got[i, 0] for i in range(50)]
    assert sorted(order) == list(range(50)) != order and all(got[i, 1] == -got[i, 0] for i in range(50))
    assert got == {(r.i, r.j): r.v for r in create.shuffle(a.repartition(3), "i", 50, 3).collect()}


def test_choice_with_replacement(spark):
    got = [r.v for r in create.choice(vec(spark, [1.0, 2.0, 3.0]), 200, 4, replace=True).collect()]
    assert len(got) == 200 and set(got) == {1.0, 2.0, 3.0}


def test_class_losses(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.9, 0.1]), ([0.0, 1.0], [0.5, 0.5])], "y array<double>, p array<double>")
    assert abs(rows.agg(ar.loss("cce").alias("x")).first().x + (math.log(0.9) + math.log(0.5)) / 2) < 1e-12


def test_empty_arrays_keep_their_shape(spark, tmp_path):
    save(mat(spark, [[1]]).where("false"), str(tmp_path / "none"), (0, 4))
    a, shape = load(spark, str(tmp_path / "none"))
    assert shape == (0, 4) and a.count() == 0 and a.columns == ["i", "j", "v"]
    write_csv(vec(spark, [1.0, 2.5]).drop("k"), str(tmp_path / "vector"), 2)
    assert list(map(tuple, read_csv(spark, str(tmp_path / "vector"), 2).collect())) == [(1.0, 2.5)]
