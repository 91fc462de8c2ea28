"""Small fixtures with known results: files, streams, IEEE rules, shapes, errors."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import elementwise as ew
from tessera.operators import arrays as ar
from tessera.operators import create, graph, linalg
from tessera.sources import load, read_csv, save, write_csv
from tessera.streaming import windowed

NAN, INF = math.nan, math.inf


def vec(spark, values):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "idx long, v double")


def values(df):
    return [r.v for r in df.orderBy("idx").collect()]


def mat(spark, rows):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "i long, j long, v double")


def same(a, b):
    return all((math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b, strict=True))


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1.0, 2.0\n\n3.0, 4.0\n5.0,\n")
    rows = read_csv(spark, str(tmp_path / "in.csv"), 2).collect()
    assert sorted(map(tuple, rows)) == [(1.0, 2.0), (3.0, 4.0), (5.0, None)]
    write_csv(mat(spark, [[1, 2], [3, 4]]), str(tmp_path / "out"), 2)
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), 2).collect())) == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_csv(spark, str(tmp_path / "bad.csv"), 2).collect()


def test_saving(spark, tmp_path):
    save(mat(spark, [[2, 1], [1, 1]]), str(tmp_path / "a"), (2, 2))
    a, shape = load(spark, str(tmp_path / "a"))
    assert shape == (2, 2) and sorted(map(tuple, a.collect())) == [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]


def test_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 3}:10:00", "a" if k % 2 else "b", float(k)) for k in range(12)]
    table = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed(table).collect()))


def test_ieee(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 1.0), (1.0, NAN), (NAN, NAN), (2.0, 3.0)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a double, b double")
    a, b = F.col("a"), F.col("b")
    got = rows.select("k", ew.div(a, b).alias("d"), ew.log(a).alias("l"), ew.equal(a, b).alias("eq"), ew.not_equal(a, b).alias("ne"), ew.greater(a, b).alias("gt"), ew.greater_equal(a, b).alias("ge"), ew.less(a, b).alias("lt"), ew.less_equal(a, b).alias("le"),
        ew.maximum(a, b).alias("mx"), ew.minimum(a, b).alias("mn"), ew.sign(a).alias("s"), ew.relu(a).alias("r"), ew.clip(a, 0, 1).alias("c")).orderBy("k").collect()
    column = lambda c: [r[c] for r in got]
    assert same(column("d"), [INF, -INF, NAN, NAN, NAN, NAN, 2 / 3])
    assert same(column("l"), [0.0, NAN, -INF, NAN, 0.0, NAN, math.log(2)])
    for c, f in {"eq": float.__eq__, "ne": float.__ne__, "gt": float.__gt__, "ge": float.__ge__, "lt": float.__lt__, "le": float.__le__}.items():
        assert column(c) == [f(x, y) for x, y in pairs], c
    assert same(column("mx"), [1.0, 0.0, 0.0, 1.0, 1.0, NAN, 3.0]) and same(column("mn"), [0.0, -1.0, 0.0, 1.0, 1.0, NAN, 2.0])
    assert column("s") == [1.0, -1.0, 0.0, 0.0, 1.0, 0.0, 1.0] and column("r") == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0]
    assert same(column("c"), [1.0, 0.0, 0.0, NAN, 1.0, NAN, 1.0])


def test_vectors(spark):
    x = vec(spark, [1, 2, 4, 7, 0]).withColumn("k", F.lit(0))
    assert values(ar.diff(x, "idx", ["k"])) == [1, 2, 3, -7] and values(ar.diff(x, "idx", ["k"], 2)) == [1, 1, -10]
    assert values(ar.gradient(vec(spark, [1, 2, 4]).withColumn("k", F.lit(0)), "idx", ["k"])) == [1, 1.5, 2]
    a = vec(spark, [1, 2, 3])
    assert values(ar.convolve(a, [0, 1, 0.5], 3)) == [0, 1, 2.5, 4, 1.5]
    assert values(ar.convolve(a, [0, 1, 0.5], 3, "same")) == [1, 2.5, 4] and values(ar.convolve(a, [0, 1, 0.5], 3, "valid")) == [2.5]
    assert [(r.bin, r.n) for r in ar.bincount(vec(spark, [0, 1, 1, 3, 2])).orderBy("bin").collect()] == [(0, 1), (1, 2), (2, 1), (3, 1)]
    assert values(ar.sort1d(vec(spark, [3, 1, 4, 2]))) == [1, 2, 3, 4] and values(ar.hstack([(a, 3), (a, 3)])) == [1, 2, 3] * 2
    assert sorted(map(tuple, ar.vstack([(a, 3), (a, 3)]).select("i", "j", "v").collect())) == [(i, j, j + 1.0) for i in range(2) for j in range(3)]
    r = ar.reduce_(vec(spark, [1, 2, 3, 4, 5]), ["sum", "prod", "var", "std", "median"]).first()
    assert (r["sum"], r["prod"], r["var"], r["median"]) == (15, 120, 2, 3) and abs(r["std"] - math.sqrt(2)) < 1e-12
    assert ar.argmax(vec(spark, [1, 5, 5]), "idx").first()[0] == 1 and ar.search(vec(spark, [4, 4]), 4).first()[0] == 0
    assert ar.reduce_(vec(spark, []), ["prod", "count"]).first() == (1.0, 0)


def test_solving(spark):
    a = mat(spark, [[2, 1], [1, 1]]).withColumn("m", F.lit(0).cast("long"))
    b = spark.createDataFrame([(0, 0, 5.0), (0, 1, 3.0)], "m long, i long, v double")
    assert [round(r.v, 9) for r in linalg.solve(a, b, 2).orderBy("i").collect()] == [2, 1]
    out = {(r.part, r.i, r.j): r.v for r in linalg.dense(mat(spark, [[4, 3], [6, 3]]).withColumn("m", F.lit(0).cast("long")), "lu", 2, 2).collect()}
    assert (out["l", 1, 0], out["u", 0, 0], out["u", 1, 1]) == (1.5, 4, -1.5)


def test_interpolation(spark):
    x = vec(spark, [0.4, 0.5, 0.6, 1.5, 2.5, -1])
    at = lambda *how: values(x.withColumn("v", ar.interp1d([(0, 0), (1, 2), (2, 0)], F.col("v"), *how)))
    assert at()[1:] == [1, 1.2, 1, 0, 0] and at("nearest")[:3] == [0, 0, 2] and at("linear", "fill", 9.0)[-2:] == [9, 9] and at("linear", "extrapolate")[-2:] == [-1, -2]
    with pytest.raises(Exception, match="IndexOutOfBounds"):
        at("linear", "raise")


def test_shapes_and_errors(spark):
    assert ar.broadcast_shape((1, 3, 1), (2, 1, 4)) == (2, 3, 4) and ar.broadcast_shape((0,), (1,)) == (0,)
    with pytest.raises(errors.ShapeMismatch):
        ar.broadcast_shape((2,), (3,))
    with pytest.raises(errors.DimensionMismatch):
        ar.reshape(create.full(spark, (2, 3), 1), ["i0", "i1"], (2, 3), (4,))
    with pytest.raises(errors.IndexOutOfBounds):
        ar.take(vec(spark, [1]), "idx", [1], 1)
    with pytest.raises(errors.DimensionMismatch):
        create.choice(vec(spark, [1, 2]), 3, 0)
    assert values(create.arange(spark, 3, 0, -1)) == [3, 2, 1] and create.arange(spark, 1, 1).count() == 0 and values(create.linspace(spark, 0, 1, 5)) == [0, 0.25, 0.5, 0.75, 1]
    assert sorted(r.v for r in create.choice(vec(spark, range(5)), 5, 1).collect()) == [0, 1, 2, 3, 4]
    draws = create.normal(spark, 1000, 42).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(draws[0]) < 0.2 and abs(draws[1] - 1) < 0.2
    mean = create.poisson(spark, 2000, 42, 3.0).agg(F.avg("v")).first()[0]
    assert abs(mean - 3) < 0.3
    kept = spark.range(4000).select(ew.dropout(F.lit(1.0), 0.25, 7).alias("v")).agg(F.avg("v"), F.count_if(F.col("v") == 0)).first()
    assert abs(kept[0] - 1) < 0.1 and 800 < kept[1] < 1200


def test_collections(spark):
    a = F.array(*map(F.lit, (3, 34, 4, 12, 5)))
    r = spark.range(1).select(graph.subset_sum(a, 9), graph.subset_sum(a, 30), graph.pop(a), graph.dequeue(a), graph.peek(a), graph.front(a), graph.push(a, F.lit(1)), graph.prepend(a, F.lit(1)), graph.remove_first(a, F.lit(4)), graph.remove_first(a, F.lit(9))).first()
    assert tuple(r) == (True, False, [3, 34, 4, 12], [34, 4, 12, 5], 5, 3, [3, 34, 4, 12, 5, 1], [1, 3, 34, 4, 12, 5], [3, 34, 12, 5], [3, 34, 4, 12, 5])
