"""The registered queries over the driver's tables, and the SQL that gives the same rows.

Sums of floating-point numbers depend on the order of addition, so such results are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import elementwise as ew
from .operators import arrays as ar
from .functions import draws
from .operators import blocks, create, graph, interp, krylov, linalg, select, signal
from .operators.order import fixed, in_lanes, ordinal, shared_folder
from .plans import Sequential, Sgd
from .plans.tensor import Tensor, gradients
from .streaming import windowed

#: Rows of a task of _spread().
SPREAD = 2000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out to about a task for each SPREAD of them: a small file holds many rows, and what is computed of each may be long."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(most, -(-rows.count() // SPREAD))), *by)


def _c(x: str) -> F.Column:
    return F.col(x)


def _prices(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").select(_c("o_orderkey").alias("idx"), _c("o_custkey").alias("lane"), _c("o_totalprice").alias("v"))


def _lanes(s: SparkSession, d: str) -> DataFrame:
    """Events as one lane per user, numbered by time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(s, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), _c("value").alias("v"))


_LANES = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)"


def _grid(s: SparkSession, d: str) -> DataFrame:
    """The embeddings as a matrix of _n rows and 64 columns."""
    cells = _t(s, d, "embeddings").select(_c("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return cells.select("i", _c("j").cast("long").alias("j"), _c("v").cast("double").alias("v"))


def _n(s: SparkSession, d: str) -> int:
    return _t(s, d, "embeddings").count()


_GRID = "(SELECT vec_id AS i, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_ROWS = "(SELECT count(*) FROM embeddings)"


@query("""SELECT l_returnflag, count(*) AS n, round(sum(x), 2) AS total, round(avg(x), 4) AS mean, round(var_pop(x), 2) AS variance, round(stddev_pop(x), 4) AS deviation
FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS x FROM lineitem WHERE l_quantity > 25) GROUP BY l_returnflag""")
def flagship(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "lineitem").where(ew.greater(_c("l_quantity"), F.lit(25))).select("l_returnflag", ew.mul(_c("l_extendedprice"), ew.sub(F.lit(1), _c("l_discount"))).alias("v"))
    r = ar.reduce_(rows, ["count", "sum", "mean", "var", "std"], ["l_returnflag"])
    return r.select("l_returnflag", _c("count").alias("n"), F.round("sum", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("var", 2).alias("variance"), F.round("std", 4).alias("deviation"))


@query("""SELECT o_orderkey, o_totalprice + o_custkey AS a, o_totalprice - o_custkey AS s, o_totalprice * 2.5 AS m, round(o_totalprice / (o_custkey % 3), 6) AS d, -o_totalprice AS n,
abs(o_totalprice - 200000) AS ab FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT o_orderkey, o_totalprice + o_custkey, o_totalprice - o_custkey, o_totalprice * 2.5, CASE WHEN o_totalprice > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END, -o_totalprice, abs(o_totalprice - 200000) FROM orders WHERE o_custkey % 3 = 0""")
def elementwise_arithmetic(s: SparkSession, d: str) -> DataFrame:
    x, y = _c("o_totalprice"), _c("o_custkey")
    return _t(s, d, "orders").select(
        "o_orderkey", ew.add(x, y).alias("a"), ew.sub(x, y).alias("s"), ew.mul(x, F.lit(2.5)).alias("m"), F.round(ew.div(x, y % 3), 6).alias("d"), ew.neg(x).alias("n"), ew.abs_(x - 200000).alias("ab")
    )


@query("""SELECT o_orderkey, round(exp(x), 6) AS e, round(CASE WHEN x - 1 = 0 THEN CAST('-inf' AS DOUBLE) WHEN x - 1 < 0 THEN CAST('nan' AS DOUBLE) ELSE ln(x - 1) END, 6) AS l, round(log2(x + 1), 6) AS l2, round(log10(x + 1), 6) AS l10,
round(sqrt(x), 6) AS q, round(pow(x, 1.5), 6) AS p, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 4) AS t, round(asin(x / 10), 6) AS ai, round(acos(x / 10), 6) AS ac, round(atan(x), 6) AS at, round(sinh(x), 4) AS sh, round(cosh(x), 4) AS ch, round(tanh(x), 6) AS th
FROM (SELECT o_orderkey, o_totalprice / 100000 AS x FROM orders)""")
def elementwise_math(s: SparkSession, d: str) -> DataFrame:
    x = _c("x")
    f = {"e": ew.exp(x), "l": ew.log(x - 1), "l2": ew.log2(x + 1), "l10": ew.log10(x + 1), "q": ew.sqrt(x), "p": ew.pow_(x, 1.5), "s": ew.sin(x), "c": ew.cos(x), "ai": ew.arcsin(x / 10), "ac": ew.arccos(x / 10), "at": ew.arctan(x), "th": ew.tanh(x)}
    g = {"t": ew.tan(x), "sh": ew.sinh(x), "ch": ew.cosh(x)}
    rows = _t(s, d, "orders").select("o_orderkey", (_c("o_totalprice") / 100000).alias("x"))
    return rows.select("o_orderkey", *(F.round(v, 6).alias(k) for k, v in f.items()), *(F.round(v, 4).alias(k) for k, v in g.items()))


@query("""SELECT c_custkey, round(c_acctbal) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CAST(sign(c_acctbal + 0.0) AS DOUBLE) AS s, greatest(c_acctbal, 1000.0) AS mx, least(c_acctbal, 1000.0) AS mn,
least(greatest(c_acctbal, 0.0), 5000.0) AS cl, CAST(trunc(c_acctbal) AS BIGINT) AS t FROM customer""")
def elementwise_rounding(s: SparkSession, d: str) -> DataFrame:
    x = _c("c_acctbal")
    return _t(s, d, "customer").select(
        "c_custkey", ew.round_(x).alias("r"), ew.floor(x).alias("f"), ew.ceil(x).alias("c"), ew.sign(x).alias("s"), ew.maximum(x, F.lit(1000.0)).alias("mx"), ew.minimum(x, F.lit(1000.0)).alias("mn"),
        ew.clip(x, 0, 5000).alias("cl"), ew.astype(x, "long").alias("t"),
    )


@query("""SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size > 25 AS gt, p_size >= 25 AS ge, p_size < 25 AS lt, p_size <= 25 AS le, p_size > 10 AND p_size < 40 AS a, p_size < 10 OR p_size > 40 AS o,
(p_size > 10) <> (p_size > 40) AS x, NOT p_size > 10 AS n, p_size & 12 AS ba, p_size | 12 AS bo, xor(p_size, 12) AS bx FROM part""")
def elementwise_logic(s: SparkSession, d: str) -> DataFrame:
    x, k = _c("p_size"), F.lit
    gt = lambda n: ew.greater(x, k(n))
    return _t(s, d, "part").select(
        "p_partkey", ew.equal(x, k(10)).alias("eq"), ew.not_equal(x, k(10)).alias("ne"), gt(25).alias("gt"), ew.greater_equal(x, k(25)).alias("ge"), ew.less(x, k(25)).alias("lt"), ew.less_equal(x, k(25)).alias("le"),
        ew.logical_and(gt(10), ew.less(x, k(40))).alias("a"), ew.logical_or(ew.less(x, k(10)), gt(40)).alias("o"), ew.logical_xor(gt(10), gt(40)).alias("x"), ew.logical_not(gt(10)).alias("n"),
        ew.bitwise_and(x, k(12)).alias("ba"), ew.bitwise_or(x, k(12)).alias("bo"), ew.bitwise_xor(x, k(12)).alias("bx"),
    )


@query("""SELECT vec_id, k, re, im, -im AS conj, round(atan2(im, re), 9) AS angle, round(sqrt(re ** 2 + im ** 2), 9) AS size, round(re ** 2 - im ** 2, 9) AS square, re + re AS twice
FROM (SELECT vec_id, k, embedding[2 * k + 1]::DOUBLE AS re, embedding[2 * k + 2]::DOUBLE AS im FROM embeddings, range(32) AS t(k))""")
def complex_parts(s: SparkSession, d: str) -> DataFrame:
    c = _c("c")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")), lambda k: F.struct(k.alias("k"), ew.complex_(F.get("embedding", 2 * k), F.get("embedding", 2 * k + 1)).alias("c")))
    rows = _t(s, d, "embeddings").select("vec_id", F.inline(pairs))
    return rows.select(
        "vec_id", "k", ew.real(c).alias("re"), ew.imag(c).alias("im"), ew.imag(ew.conj(c)).alias("conj"), F.round(ew.angle(c), 9).alias("angle"), F.round(ew.magnitude(c), 9).alias("size"),
        F.round(ew.real(ew.complex_mul(c, c)), 9).alias("square"), ew.real(ew.complex_add(c, c)).alias("twice"),
    )


@query("""SELECT event_id, greatest(x, 0) AS relu, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(tanh(x), 9) AS tanh, CASE WHEN x > 0 THEN x ELSE 0.01 * x END AS leaky, round(ln(1 + exp(x)), 9) AS softplus
FROM (SELECT event_id, value / 100 - 0.5 AS x FROM events)""")
def activations(s: SparkSession, d: str) -> DataFrame:
    x = _c("x")
    rows = _t(s, d, "events").select("event_id", (_c("value") / 100 - 0.5).alias("x"))
    return rows.select("event_id", ew.relu(x).alias("relu"), F.round(ew.sigmoid(x), 9).alias("sigmoid"), F.round(ew.tanh(x), 9).alias("tanh"), ew.leaky_relu(x).alias("leaky"), F.round(ew.softplus(x), 9).alias("softplus"))


@query("""SELECT o_orderkey AS idx, CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0.0 END AS chosen, CASE WHEN o_totalprice > 300000 THEN 300000.0 ELSE o_totalprice END AS replaced FROM orders""")
def where_and_replace(s: SparkSession, d: str) -> DataFrame:
    v = _c("v")
    return _prices(s, d).select("idx", ew.where(v > 100000, v, F.lit(0.0)).alias("chosen"), ew.replace_where(v, v > 300000, F.lit(300000.0)).alias("replaced"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS v FROM orders WHERE o_totalprice > 200000")
def boolean_mask(s: SparkSession, d: str) -> DataFrame:
    a = _t(s, d, "orders").select("o_orderkey", _c("o_totalprice").alias("v"))
    return ar.boolean_mask(a, _c("v") > 200000, ["o_orderkey"])


@query(f"""SELECT k.pos AS i, a.j, a.v FROM {_GRID} a JOIN (VALUES (0, 3), (1, 0), (2, 3)) AS k(pos, i) ON a.i = k.i""")
def take(s: SparkSession, d: str) -> DataFrame:
    return ar.take(_grid(s, d), "i", [3, 0, 3], _n(s, d))


@query(f"SELECT CAST((i - 1) / 2 AS BIGINT) AS i, j, v FROM {_GRID} WHERE i >= 1 AND (i - 1) % 2 = 0")
def slice_rows(s: SparkSession, d: str) -> DataFrame:
    return ar.slice_(_grid(s, d), "i", 1, _n(s, d), 2)


@query(f"SELECT CAST(j // 3 AS BIGINT) AS j, v FROM {_GRID} WHERE i = 5 AND j % 3 = 0")
def slices(s: SparkSession, d: str) -> DataFrame:
    return ar.slices(_grid(s, d), ["i", "j"], (_n(s, d), 64), [5, (0, 999, 3)])


@query(f"SELECT v FROM {_GRID} WHERE i = 7 AND j = 9")
def get(s: SparkSession, d: str) -> DataFrame:
    return ar.get(_grid(s, d), ["i", "j"], (_n(s, d), 64), (7, 9))


@query(f"SELECT i, j, CASE WHEN i = 7 AND j = 9 THEN 2.5 ELSE v END AS v FROM {_GRID}")
def set_cell(s: SparkSession, d: str) -> DataFrame:
    return ar.set_(_grid(s, d), ["i", "j"], (_n(s, d), 64), (7, 9), 2.5)


@query("SELECT event_id AS idx FROM events WHERE value > 90")
def find(s: SparkSession, d: str) -> DataFrame:
    return ar.find(_t(s, d, "events").select(_c("event_id").alias("idx"), _c("value").alias("v")), _c("v") > 90)


@query("SELECT l_orderkey AS idx FROM lineitem WHERE l_discount <> 0")
def nonzero(s: SparkSession, d: str) -> DataFrame:
    return ar.nonzero(_t(s, d, "lineitem").select(_c("l_orderkey").alias("idx"), _c("l_discount").alias("v")), ["idx"])


@query("""SELECT p_partkey AS idx, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_size = 7) THEN -1.0 WHEN p_partkey = (SELECT max(p_partkey) FROM part WHERE p_size = 8) THEN -2.0 ELSE CAST(p_size AS DOUBLE) END AS v FROM part""")
def replace_first_and_last(s: SparkSession, d: str) -> DataFrame:
    a = _t(s, d, "part").select(_c("p_partkey").alias("idx"), _c("p_size").cast("double").alias("v"))
    return ar.replace_end(ar.replace_end(a, 7.0, -1.0), 8.0, -2.0, last=True)


@query("SELECT min(p_partkey) AS idx FROM part WHERE p_size = 7")
def linear_search(s: SparkSession, d: str) -> DataFrame:
    return ar.search(_t(s, d, "part").select(_c("p_partkey").alias("idx"), _c("p_size").alias("v")), 7)


@query("""SELECT count(v) AS count, round(sum(v), 2) AS sum, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(var_pop(v) / 1e6, 4) AS var, round(stddev_pop(v), 6) AS std, median(v) AS median FROM (SELECT o_totalprice AS v FROM orders)""")
def reduce_all(s: SparkSession, d: str) -> DataFrame:
    r = ar.reduce_(_prices(s, d), ["count", "sum", "mean", "min", "max", "var", "std", "median"])
    return r.select("count", F.round("sum", 2).alias("sum"), F.round("mean", 6).alias("mean"), "min", "max", F.round(_c("var") / 1e6, 4).alias("var"), F.round("std", 6).alias("std"), "median")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum, round(avg(l_quantity), 9) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS std, median(l_quantity) AS median
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def reduce_axis(s: SparkSession, d: str) -> DataFrame:
    r = ar.reduce_(_t(s, d, "lineitem").withColumn("v", _c("l_quantity")), ["sum", "mean", "min", "max", "var", "std", "median"], ["l_returnflag", "l_linestatus"])
    return r.select("l_returnflag", "l_linestatus", F.round("sum", 2).alias("sum"), F.round("mean", 9).alias("mean"), "min", "max", F.round("var", 6).alias("var"), F.round("std", 6).alias("std"), "median")


@query("SELECT l_returnflag, round(product(1 + l_discount / 1e6), 6) AS prod FROM lineitem GROUP BY l_returnflag")
def product(s: SparkSession, d: str) -> DataFrame:
    r = ar.reduce_(_t(s, d, "lineitem"), ["prod"], ["l_returnflag"], 1 + _c("l_discount") / 1e6)
    return r.select("l_returnflag", F.round("prod", 6).alias("prod"))


@query("SELECT lane, arg_min(idx, struct_pack(a := -v, b := idx)) AS argmax FROM (SELECT o_orderkey AS idx, o_custkey AS lane, o_totalprice AS v FROM orders) GROUP BY lane")
def argmax(s: SparkSession, d: str) -> DataFrame:
    return ar.argmax(_prices(s, d), "idx", ["lane"])


@query(f"SELECT CAST(0 AS BIGINT) AS i, j, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean FROM {_GRID} GROUP BY j")
def reduce_keeping_the_axis(s: SparkSession, d: str) -> DataFrame:
    return ar.reduce_(_grid(s, d), ["sum", "mean"], ["j"], keep=["i"]).select("i", "j", F.round("sum", 6).alias("sum"), F.round("mean", 6).alias("mean"))


@query("SELECT lane, arg_min(idx, struct_pack(a := v, b := idx)) AS argmin FROM (SELECT o_orderkey AS idx, o_custkey AS lane, o_totalprice AS v FROM orders) GROUP BY lane")
def argmin(s: SparkSession, d: str) -> DataFrame:
    return ar.argmin(_prices(s, d), "idx", ["lane"])


@query("SELECT bin, count(p_size) AS n FROM (SELECT unnest(range(0, (SELECT max(p_size) + 1 FROM part))) AS bin) LEFT JOIN part ON p_size = bin GROUP BY bin")
def bincount(s: SparkSession, d: str) -> DataFrame:
    return ar.bincount(_t(s, d, "part").select(_c("p_size").alias("v")))


def _custkeys(s: SparkSession, d: str, status: str) -> DataFrame:
    return _t(s, d, "orders").where(_c("o_orderstatus") == status).select(_c("o_custkey").alias("v"))


_F, _O = ("SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'O'")


@query(f"SELECT DISTINCT v FROM ({_F})")
def unique(s: SparkSession, d: str) -> DataFrame:
    return ar.unique(_custkeys(s, d, "F"))


@query(f"{_F} INTERSECT {_O}")
def intersect1d(s: SparkSession, d: str) -> DataFrame:
    return ar.intersect1d(_custkeys(s, d, "F"), _custkeys(s, d, "O"))


@query(f"{_F} UNION {_O}")
def union1d(s: SparkSession, d: str) -> DataFrame:
    return ar.union1d(_custkeys(s, d, "F"), _custkeys(s, d, "O"))


@query(f"{_F} EXCEPT {_O}")
def setdiff1d(s: SparkSession, d: str) -> DataFrame:
    return ar.setdiff1d(_custkeys(s, d, "F"), _custkeys(s, d, "O"))


@query(f"({_F} EXCEPT {_O}) UNION ({_O} EXCEPT {_F})")
def setxor1d(s: SparkSession, d: str) -> DataFrame:
    return ar.setxor1d(_custkeys(s, d, "F"), _custkeys(s, d, "O"))


@query(f"SELECT c_custkey AS v, c_custkey IN ({_F}) AS found FROM customer")
def in1d(s: SparkSession, d: str) -> DataFrame:
    return ar.in1d(_t(s, d, "customer").select(_c("c_custkey").alias("v")), _custkeys(s, d, "F"))


@query("SELECT o_custkey AS lane, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS idx, o_totalprice AS v FROM orders")
def sort_axis(s: SparkSession, d: str) -> DataFrame:
    return ar.sort(_prices(s, d), "idx", ["lane"])


@query("SELECT row_number() OVER (ORDER BY o_totalprice) - 1 AS idx, o_totalprice AS v FROM orders")
def sort1d(s: SparkSession, d: str) -> DataFrame:
    return ar.sort1d(_prices(s, d).select("idx", "v"))


@query("SELECT o_custkey AS lane, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS k, o_orderkey AS idx FROM orders")
def argsort(s: SparkSession, d: str) -> DataFrame:
    return ar.argsort(_prices(s, d), "idx", ["lane"])


@query("SELECT o_orderkey AS idx, o_totalprice AS v FROM orders ORDER BY v, idx LIMIT 100")
def partition_smallest(s: SparkSession, d: str) -> DataFrame:
    return ar.smallest(_prices(s, d).select("idx", "v"), 100)


@query(f"SELECT user_id, idx, round(n2, 9) AS v FROM (SELECT user_id, idx, lead(v, 2) OVER w - 2 * lead(v) OVER w + v AS n2 FROM {_LANES} WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE n2 IS NOT NULL")
def diff_second(s: SparkSession, d: str) -> DataFrame:
    return ar.diff(_lanes(s, d), "idx", ["user_id"], 2).select("user_id", "idx", F.round("v", 9).alias("v"))


@query(f"""SELECT user_id, idx, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 9) AS v
FROM (SELECT user_id, idx, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM {_LANES} WINDOW w AS (PARTITION BY user_id ORDER BY idx))""")
def gradient(s: SparkSession, d: str) -> DataFrame:
    return ar.gradient(_lanes(s, d), "idx", ["user_id"]).select("user_id", "idx", F.round("v", 9).alias("v"))


@query(f"SELECT user_id, idx + j AS idx, round(sum(v * x), 6) AS v FROM {_LANES}, (VALUES (0, 1.0), (1, 2.0), (2, 0.5)) AS k(j, x) GROUP BY user_id, idx + j")
def convolve(s: SparkSession, d: str) -> DataFrame:
    return ar.convolve(_lanes(s, d), [1.0, 2.0, 0.5], by=["user_id"]).select("user_id", "idx", F.round("v", 6).alias("v"))


@query(f"SELECT user_id, idx + j AS idx, round(sum(v * x), 6) AS v FROM {_LANES}, (VALUES (0, 0.5), (1, 2.0), (2, 1.0)) AS k(j, x) GROUP BY user_id, idx + j")
def correlate(s: SparkSession, d: str) -> DataFrame:
    return ar.correlate(_lanes(s, d), [1.0, 2.0, 0.5], by=["user_id"]).select("user_id", "idx", F.round("v", 6).alias("v"))


@query("""SELECT event_id, round(CASE WHEN value < 10 THEN 0.0 WHEN value > 90 THEN 5.0 WHEN value < 50 THEN (value - 10) * 20.0 / 40 ELSE 20.0 + (value - 50) * -15.0 / 40 END, 9) AS linear,
CASE WHEN value < 10 THEN 0.0 WHEN value > 90 THEN 5.0 WHEN value < 50 THEN CASE WHEN value - 10 <= 50 - value THEN 0.0 ELSE 20.0 END ELSE CASE WHEN value - 50 <= 90 - value THEN 20.0 ELSE 5.0 END END AS nearest,
round(CASE WHEN value < 10 OR value > 90 THEN -1.0 WHEN value < 50 THEN (value - 10) * 20.0 / 40 ELSE 20.0 + (value - 50) * -15.0 / 40 END, 9) AS filled,
round(CASE WHEN value < 50 THEN (value - 10) * 20.0 / 40 ELSE 20.0 + (value - 50) * -15.0 / 40 END, 9) AS onward FROM events""")
def interp1d(s: SparkSession, d: str) -> DataFrame:
    knots, x = [(10, 0), (50, 20), (90, 5)], _c("value")
    return _t(s, d, "events").select(
        "event_id", F.round(ar.interp1d(knots, x), 9).alias("linear"), ar.interp1d(knots, x, "nearest").alias("nearest"), F.round(ar.interp1d(knots, x, "linear", "fill", -1.0), 9).alias("filled"),
        F.round(ar.interp1d(knots, x, "linear", "extrapolate"), 9).alias("onward"),
    )


def _ends(mode: str) -> str:
    first = "greatest(0, (n + 2 - greatest(n, 3)) // 2)" if mode == "same" else "(least(n, 3) - 1)"
    keep = f"p >= {first} AND p < {first} + " + ("greatest(n, 3)" if mode == "same" else "greatest(n, 3) - least(n, 3) + 1")
    return f"""WITH l AS (SELECT *, max(idx) OVER (PARTITION BY user_id) + 1 AS n FROM {_LANES}),
f AS (SELECT user_id, any_value(n) AS n, idx + j AS p, sum(v * x) AS v FROM l, (VALUES (0, 1.0), (1, 2.0), (2, 0.5)) AS k(j, x) GROUP BY user_id, idx + j)
SELECT user_id, CAST(p - {first} AS BIGINT) AS idx, round(v, 6) AS v FROM f WHERE {keep}"""


@query(_ends("same"))
def convolve_same(s: SparkSession, d: str) -> DataFrame:
    return ar.convolve(_lanes(s, d), [1.0, 2.0, 0.5], mode="same", by=["user_id"]).select("user_id", "idx", F.round("v", 6).alias("v"))


@query(_ends("valid"))
def convolve_valid(s: SparkSession, d: str) -> DataFrame:
    return ar.convolve(_lanes(s, d), [1.0, 2.0, 0.5], mode="valid", by=["user_id"]).select("user_id", "idx", F.round("v", 6).alias("v"))


@query(f"SELECT i, j, v / 2 AS v FROM {_GRID} UNION ALL SELECT i + {_ROWS}, j, v FROM {_GRID}")
def concatenate(s: SparkSession, d: str) -> DataFrame:
    a, n = _grid(s, d), _n(s, d)
    return ar.concatenate([(a.withColumn("v", _c("v") / 2), n), (a, n)], "i")


@query(f"SELECT i, j, v, 0 AS k FROM {_GRID} UNION ALL SELECT i, j, v, 1 FROM {_GRID}")
def stack(s: SparkSession, d: str) -> DataFrame:
    return ar.stack([_grid(s, d)] * 2, "k")


@query(f"SELECT i, j + 64 * r AS j, v FROM {_GRID}, range(3) AS t(r)")
def tile(s: SparkSession, d: str) -> DataFrame:
    return ar.tile(_grid(s, d), "j", 64, 3)


@query(f"SELECT i, j * 3 + r AS j, v FROM {_GRID}, range(3) AS t(r)")
def repeat(s: SparkSession, d: str) -> DataFrame:
    return ar.repeat(_grid(s, d), "j", 3)


@query(f"SELECT {_ROWS} - 1 - i AS i, (j + 62) % 64 AS j, v FROM {_GRID}")
def flip_and_roll(s: SparkSession, d: str) -> DataFrame:
    return ar.roll(ar.flip(_grid(s, d), "i", _n(s, d)), "j", 64, -2)


@query(f"SELECT i * 64 + j AS idx, v FROM {_GRID}")
def flatten(s: SparkSession, d: str) -> DataFrame:
    return ar.flatten(_grid(s, d), ["i", "j"], (_n(s, d), 64))


@query(f"SELECT i, j, CAST(0 AS BIGINT) AS k, v FROM {_GRID}")
def expand_dims(s: SparkSession, d: str) -> DataFrame:
    return ar.expand_dims(_grid(s, d), "k").select("i", "j", "k", "v")


@query(f"SELECT i, j, v FROM {_GRID}")
def squeeze(s: SparkSession, d: str) -> DataFrame:
    return ar.squeeze(ar.expand_dims(_grid(s, d), "k"), "k")


@query(f"SELECT j AS i, i AS j, v FROM {_GRID}")
def transpose(s: SparkSession, d: str) -> DataFrame:
    return ar.permute(_grid(s, d), ["i", "j"], ["j", "i"])


@query(f"SELECT row_number() OVER (ORDER BY i, j) - 1 AS idx, v FROM {_GRID} WHERE i * 64 + j NOT IN (1, 7, 24)")
def delete(s: SparkSession, d: str) -> DataFrame:
    return ar.delete(ar.flatten(_grid(s, d), ["i", "j"], (_n(s, d), 64)), [7, 1, 1, 24, 10**12])


@query(f"SELECT a.i, a.j, round(a.v - m.v, 7) + 0.0 AS v FROM {_GRID} a JOIN (SELECT j, avg(v) AS v FROM {_GRID} GROUP BY j) m USING (j)")
def broadcast_subtract(s: SparkSession, d: str) -> DataFrame:
    a = _grid(s, d)
    return ar.broadcast_binary(a, ar.reduce_(a, ["mean"], ["j"]).withColumnRenamed("mean", "v"), ["j"], ew.sub).withColumn("v", F.round("v", 7) + 0.0)


@query("SELECT i, round(i * 0.25 - 1, 9) AS a, round(i * 0.01, 9) AS l FROM range(100) AS t(i)")
def ranges(s: SparkSession, d: str) -> DataFrame:
    a, b = create.arange(s, -1.0, 24.0, 0.25), create.linspace(s, 0.0, 0.99, 100)
    return a.select(_c("idx").alias("i"), F.round("v", 9).alias("a")).join(b.select(_c("idx").alias("i"), F.round("v", 9).alias("l")), "i")


@query("SELECT CAST(i // 4 AS BIGINT) AS i0, CAST(i % 4 AS BIGINT) AS i1, 2.5 AS v FROM range(12) AS t(i)")
def full(s: SparkSession, d: str) -> DataFrame:
    return create.full(s, (3, 4), 2.5)


@query("SELECT i, CAST(i // 4 AS BIGINT) AS i0, CAST(i % 4 AS BIGINT) AS i1, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, CASE WHEN i // 4 = i % 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS eye FROM range(16) AS t(i)")
def constants(s: SparkSession, d: str) -> DataFrame:
    zero, one, eye = create.zeros(s, (4, 4)).withColumnRenamed("v", "zero"), create.ones(s, (4, 4)).withColumnRenamed("v", "one"), create.eye(s, 4).select(_c("i").alias("i0"), _c("j").alias("i1"), _c("v").alias("eye"))
    both = zero.join(one, ["i0", "i1"]).join(eye, ["i0", "i1"], "left")
    return both.select((_c("i0") * 4 + _c("i1")).alias("i"), "i0", "i1", "zero", "one", F.coalesce("eye", F.lit(0.0)).alias("eye"))


@query(f"SELECT count(*) AS n, count(DISTINCT i) AS rows, round(sum(v), 5) AS total FROM {_GRID}")
def shuffle_rows(s: SparkSession, d: str) -> DataFrame:
    a = create.shuffle(_grid(s, d), "i", _n(s, d), 42)
    return a.agg(F.count("*").alias("n"), F.count_distinct("i").alias("rows"), F.round(F.sum("v"), 5).alias("total"))


@query("SELECT CAST(0 AS BIGINT) AS wrong, CAST(100 AS BIGINT) AS n")
def choice(s: SparkSession, d: str) -> DataFrame:
    prices = _prices(s, d).select("idx", "v")
    numbered = ordinal(prices.withColumnRenamed("idx", "key"), ["key"], "idx").select("idx", "v")
    drawn = create.choice(prices, 50, 42).unionByName(create.choice(numbered, 50, 42, replace=True))
    return drawn.join(prices.select(_c("v").alias("p")).distinct(), _c("v") == _c("p"), "left").agg(F.count_if(_c("p").isNull()).alias("wrong"), F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size || ',1' AS pushed, CAST(p_size AS VARCHAR) AS popped, '2,' || p_size AS front, p_size AS last, CASE WHEN p_size = 3 THEN '4' ELSE p_size || ',4' END AS removed FROM part""")
def list_columns(s: SparkSession, d: str) -> DataFrame:
    one, n = F.array("p_size"), lambda k: F.lit(k).cast("int")
    two = graph.push(one, n(1))
    lists = {"pushed": two, "popped": graph.pop(two), "front": graph.prepend(one, n(2)), "removed": graph.remove_first(graph.push(one, n(4)), n(3))}
    return _t(s, d, "part").select("p_partkey", graph.peek(one).alias("last"), *(F.array_join(F.transform(a, lambda x: x.cast("string")), ",").alias(k) for k, a in lists.items()))


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/arrays-{uuid.uuid4().hex}"


@query("SELECT c_custkey::DOUBLE AS c0, c_acctbal AS c1 FROM customer")
def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "customer").select(_c("c_custkey").alias("i"), F.posexplode(F.array(_c("c_custkey").cast("double"), "c_acctbal")).alias("j", "v"))
    path = _folder(s)
    sources.write_csv(rows, path, 2)
    return sources.read_csv(s, path, 2)


@query(f"SELECT i, j, v FROM {_GRID}")
def save_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sources.save(_grid(s, d), path, (_n(s, d), 64))
    a, shape = sources.load(s, path)
    return ar.slices(a, ["i", "j"], shape, [None, None])


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 9) AS dot FROM embeddings")
def dot(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "embeddings").select("vec_id", F.round(linalg.dot(_c("embedding"), _c("embedding")), 9).alias("dot"))


@query("""WITH c AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i, b.i AS j, round(sum(a.x * b.x), 6) AS v FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i""")
def gram(s: SparkSession, d: str) -> DataFrame:
    return linalg.gram(_t(s, d, "embeddings"), "embedding", 64).select("i", "j", F.round("v", 6).alias("v"))


@query(f"SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {_GRID} a JOIN {_GRID} b USING (i) GROUP BY a.j, b.j")
def matmul(s: SparkSession, d: str) -> DataFrame:
    a = _grid(s, d)
    return linalg.matmul(ar.permute(a, ["i", "j"], ["j", "i"]), a).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"SELECT round(sqrt(sum(v * v)), 6) AS norm, round(sum(CASE WHEN i = j THEN v END), 6) AS trace FROM {_GRID}")
def norm_and_trace(s: SparkSession, d: str) -> DataFrame:
    a = _grid(s, d)
    return linalg.norm(a).select(F.round("norm", 6).alias("norm")).crossJoin(F.broadcast(linalg.trace(a).select(F.round("trace", 6).alias("trace"))))  # one row each


@query(f"SELECT i, count(*) AS n FROM {_GRID} WHERE v <> 0 GROUP BY i")
def sparse_rows(s: SparkSession, d: str) -> DataFrame:
    return linalg.row_pointers(_grid(s, d), _n(s, d))


@query(f"SELECT i, j, CASE WHEN v > 0.1 THEN v ELSE 0.0 END AS v FROM {_GRID}")
def sparse_round_trip(s: SparkSession, d: str) -> DataFrame:
    return linalg.to_dense(linalg.from_dense(_grid(s, d).where("v > 0.1")), _n(s, d), 64)


@query("SELECT event_id, round(((3 * x + 2) * x + 1) * x - 4, 9) AS p FROM (SELECT event_id, value / 100 AS x FROM events)")
def polyval(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", (_c("value") / 100).alias("x")).select("event_id", F.round(ew.polyval([3.0, 2.0, 1.0, -4.0], _c("x")), 9).alias("p"))


@query(f"""SELECT i, k, round(sum(v * cos(-2 * pi() * (k * j % 64) / 64)), 6) + 0.0 AS re, round(sum(v * sin(-2 * pi() * (k * j % 64) / 64)), 6) + 0.0 AS im FROM {_GRID}, range(64) AS t(k) GROUP BY i, k""")
def dft(s: SparkSession, d: str) -> DataFrame:
    a = _grid(s, d).withColumnRenamed("j", "idx")
    return linalg.dft(a, 64, ["i"]).select("i", "k", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query("""SELECT user_id, event_id, round(exp(value / 100 - m) / sum(exp(value / 100 - m)) OVER (PARTITION BY user_id), 9) AS v
FROM (SELECT *, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events)""")
def softmax(s: SparkSession, d: str) -> DataFrame:
    return ar.softmax(_t(s, d, "events").select("user_id", "event_id", (_c("value") / 100).alias("v")), ["user_id"]).select("user_id", "event_id", F.round("v", 9).alias("v"))


@query("SELECT event_id, round(exp(value / 100) / (SELECT sum(exp(value / 100)) FROM events) * 1e6, 6) AS v FROM events")
def softmax_whole(s: SparkSession, d: str) -> DataFrame:
    return ar.softmax(_t(s, d, "events").select("event_id", (_c("value") / 100).alias("v"))).select("event_id", F.round(_c("v") * 1e6, 6).alias("v"))


@query("SELECT round(avg(-ln(CASE WHEN toxic = 1 THEN 0.1 + 0.5 * quality ELSE 0.9 - 0.5 * quality END)), 9) AS cce FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL")
def class_loss(s: SparkSession, d: str) -> DataFrame:
    p, y = 0.1 + 0.5 * _c("quality"), _c("toxic").cast("double")
    rows = _t(s, d, "labels").where("toxic is not null and quality is not null").select(F.array(y, 1 - y).alias("y"), F.array(p, 1 - p).alias("p"))
    return rows.agg(F.round(ar.loss("cce"), 9).alias("cce"))


@query("""SELECT round(avg((y - p) ** 2), 9) AS mse, round(avg(abs(y - p)), 9) AS mae, round(avg(greatest(0, 1 - y * p)), 9) AS hinge, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS bce
FROM (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM (SELECT CAST(toxic AS DOUBLE) AS y, 0.1 + 0.5 * quality AS p FROM labels))""")
def losses(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "labels").select(_c("toxic").cast("double").alias("y"), (0.1 + 0.5 * _c("quality")).alias("p"))
    return rows.agg(*(F.round(ar.loss(k), 9).alias(k) for k in ("mse", "mae", "hinge", "bce")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_suppkey % 100 AS BIGINT) AS u, CAST(l_partkey % 97 AS BIGINT) AS v FROM lineitem),
w(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.v, w.depth + 1 FROM w JOIN e ON e.u = w.node WHERE w.depth < 40) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "lineitem").select((_c("l_suppkey") % 100).cast("long").alias("u"), (_c("l_partkey") % 97).cast("long").alias("v")).distinct()
    return graph.bfs(e, 1)


def _trade(s: SparkSession, d: str) -> DataFrame:
    """Suppliers and the parts they sell, part k as node -1 - k, linked both ways."""
    e = graph.distinct_edges(_t(s, d, "lineitem").select(_c("l_suppkey").cast("long").alias("u"), (-1 - _c("l_partkey").cast("long")).alias("v")))
    return e.unionByName(e.select(_c("v").alias("u"), _c("u").alias("v")))


_TRADE = "e AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS u, CAST(-1 - l_partkey AS BIGINT) AS v FROM lineitem), g AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)"


@query(f"""WITH RECURSIVE {_TRADE}, w(node, depth) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), 0 UNION
SELECT g.v, min(w.depth) + 1 FROM w JOIN g ON g.u = w.node WHERE g.v NOT IN (SELECT node FROM recurring.w) GROUP BY g.v) SELECT node, depth FROM w""")
def bfs_trade(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_trade(s, d), 1)


@query(f"WITH RECURSIVE {_TRADE}, w(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT g.v FROM w JOIN g ON g.u = w.node) SELECT node FROM w")
def reachable_trade(s: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_trade(s, d), 1)


@query("SELECT i AS target, i IN (0, 3, 4, 5, 7, 8, 9, 12) AS reachable FROM range(13) AS t(i)")
def subset_sum(s: SparkSession, d: str) -> DataFrame:
    sums = graph.subset_sums(F.array(F.lit(3), F.lit(4), F.lit(5)))
    return s.range(13).select(_c("id").alias("target"), F.array_contains(sums, _c("id")).alias("reachable"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 9) AS mean FROM events GROUP BY ALL""")
def windowed_events(s: SparkSession, d: str) -> DataFrame:
    return windowed(_t(s, d, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"), F.round("mean", 9).alias("mean"))


@query()
def random_draws(s: SparkSession, d: str) -> DataFrame:
    draws = {"uniform": create.uniform(s, 1000, 42), "normal": create.normal(s, 1000, 42), "randint": create.randint(s, 1000, 42, 0, 10), "exponential": create.exponential(s, 1000, 42), "poisson": create.poisson(s, 1000, 42, 3.0)}
    out = None
    for k, a in draws.items():
        r = a.select(F.lit(k).alias("kind"), "idx", _c("v").cast("double").alias("v"))
        out = r if out is None else out.unionByName(r)
    return out


@query()
def permutation(s: SparkSession, d: str) -> DataFrame:
    return create.permutation(s, 1000, 42)


#: Rows and columns of a block of the square matrices here, of 64 by 64.
_B = 32


def _cells_rounded(a: DataFrame, places: int = 6) -> DataFrame:
    return a.select("i", "j", (F.round("v", places) + 0.0).alias("v"))


def _products(s: SparkSession, d: str) -> DataFrame:
    """The 64 by 64 inner products of the columns of the embeddings."""
    return linalg.gram(_t(s, d, "embeddings"), "embedding", 64)


_PRODUCTS = f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM {_GRID} a JOIN {_GRID} b USING (i) GROUP BY a.j, b.j"
_UNIT = "SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) AS a(i), range(64) AS b(i)"


def _mean(s: SparkSession, d: str) -> DataFrame:
    return ar.reduce_(_grid(s, d), ["mean"], ["j"]).select("j", _c("mean").alias("u"))


def _near_unit(s: SparkSession, d: str) -> DataFrame:
    """The unit matrix and the product of the mean vector u with itself, I + u u'."""
    u, zero = _mean(s, d), F.lit(0).cast("long")
    product = linalg.matmul(u.select(_c("j").alias("i"), zero.alias("j"), _c("u").alias("v")), u.select(zero.alias("i"), "j", _c("u").alias("v")))
    return product.unionByName(create.eye(s, 64)).groupBy("i", "j").agg(F.sum("v").alias("v"))


_U = f"WITH u AS (SELECT j, avg(v) AS u FROM {_GRID} GROUP BY j), s AS (SELECT sum(u * u) AS s FROM u)"


@query(f"{_U} SELECT a.j AS i, b.j AS j, round(CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END - a.u * b.u / (1 + s), 9) + 0.0 AS v FROM u a, u b, s")
def linalg_inverse(s: SparkSession, d: str) -> DataFrame:
    return _cells_rounded(blocks.inverse(_near_unit(s, d), 64, _B), 9)


@query(f"{_U} SELECT round(1 + s, 9) AS determinant FROM s")
def linalg_determinant(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(blocks.determinant(_near_unit(s, d), 64, _B),)], "x double").select(F.round("x", 9).alias("determinant"))


@query(f"{_U}, y AS (SELECT j, k, u * j + k AS y FROM u, range(2) AS t(k)), p AS (SELECT k, sum(u.u * y) AS p FROM y JOIN u USING (j) GROUP BY k) SELECT j AS i, k AS j, round(y - u * p / (1 + s), 7) + 0.0 AS v FROM y JOIN u USING (j) JOIN p USING (k), s")
def linalg_solve(s: SparkSession, d: str) -> DataFrame:
    right = _mean(s, d).withColumn("k", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    right = right.select(_c("j").alias("i"), _c("k").alias("j"), (_c("u") * _c("j") + _c("k")).alias("v"))
    return _cells_rounded(blocks.solve(_near_unit(s, d), right, 64, _B), 7)


@query(f"{_PRODUCTS}")
def lu_product(s: SparkSession, d: str) -> DataFrame:
    return _cells_rounded(linalg.matmul(*blocks.lu(_products(s, d), 64, _B)), 4)


@query(f"{_PRODUCTS}")
def cholesky_product(s: SparkSession, d: str) -> DataFrame:
    low = blocks.cholesky(_products(s, d), 64, _B)
    return _cells_rounded(linalg.matmul(low, ar.permute(low, ["i", "j"], ["j", "i"])), 4)


@query(_UNIT)
def inverse_product(s: SparkSession, d: str) -> DataFrame:
    a = _products(s, d)
    return _cells_rounded(linalg.matmul(a, blocks.inverse(a, 64, _B)))


@query(_UNIT)
def linalg_qr(s: SparkSession, d: str) -> DataFrame:
    """The columns of Q are of length 1 and at right angles."""
    q, _ = blocks.tall_qr(_t(s, d, "embeddings"), "embedding", 64)
    return _cells_rounded(linalg.gram(q, "q", 64))


def _as_grid(rows: DataFrame, array: str) -> DataFrame:
    return rows.select(_c("vec_id").alias("i"), F.posexplode(array).alias("j", "v")).select("i", _c("j").cast("long").alias("j"), (F.round("v", 5) + 0.0).alias("v"))


@query(f"SELECT i, j, round(v, 5) + 0.0 AS v FROM {_GRID}")
def qr_product(s: SparkSession, d: str) -> DataFrame:
    q, r = blocks.tall_qr(_t(s, d, "embeddings"), "embedding", 64)
    return _as_grid(blocks.times(q, "q", r, "back"), "back")


@query(f"SELECT i, j, round(v, 5) + 0.0 AS v FROM {_GRID}")
def svd_product(s: SparkSession, d: str) -> DataFrame:
    u, sizes, vt = blocks.tall_svd(_t(s, d, "embeddings"), "embedding", 64)
    return _as_grid(blocks.times(u, "u", sizes[:, None] * vt, "back"), "back")


@query(f"SELECT CAST(64 AS BIGINT) AS n, round(sum(v * v), 4) AS squares FROM {_GRID}")
def linalg_svd(s: SparkSession, d: str) -> DataFrame:
    _, sizes, _ = blocks.tall_svd(_t(s, d, "embeddings"), "embedding", 64)
    return s.createDataFrame([(float(x),) for x in sizes], "x double").agg(F.count("*").alias("n"), F.round(F.sum(_c("x") * _c("x")), 4).alias("squares"))


@query(_PRODUCTS)
def eig_product(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "embeddings")
    w, v = blocks.axes_of(rows, "embedding", 64)
    return _cells_rounded(linalg.matmul(blocks.as_cells(rows, v * w), blocks.as_cells(rows, v.T)), 4)


@query(f"SELECT round(sum(v * v), 4) AS total FROM {_GRID}")
def eigvals_sum(s: SparkSession, d: str) -> DataFrame:
    w, _ = blocks.axes_of(_t(s, d, "embeddings"), "embedding", 64)
    return s.createDataFrame([(float(x),) for x in w], "x double").agg(F.round(F.sum("x"), 4).alias("total"))


@query("SELECT count(*) AS n, round(sum(x * y), 2) AS xy, round(sum(x * x), 2) AS xx FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)")
def least_squares(s: SparkSession, d: str) -> DataFrame:
    """The slope times the squares gives the products back."""
    rows = _t(s, d, "lineitem").select(F.array("l_quantity").alias("x"), _c("l_extendedprice").alias("y"))
    slope = float(blocks.least_squares(rows, "x", "y", 1)[0])
    sums = rows.agg(F.count("*").alias("n"), F.sum(_c("x")[0] * _c("x")[0]).alias("xx"))
    return sums.select("n", F.round(_c("xx") * slope, 2).alias("xy"), F.round("xx", 2).alias("xx"))


def _series(s: SparkSession, d: str) -> DataFrame:
    return _lanes(s, d).select(_c("user_id").alias("key"), "idx", _c("v").alias("re"), F.lit(0.0).alias("im"))


def _wave(*columns: str) -> list[F.Column]:
    return [*columns, *((F.round(x, 6) + 0.0).alias(x) for x in ("re", "im"))]


@query(f"""WITH a AS (SELECT user_id AS key, idx, v, count(*) OVER (PARTITION BY user_id) AS n FROM {_LANES})
SELECT b.key, b.idx, round(sum(a.v * cos(-2 * pi() * (a.idx * b.idx % a.n) / a.n)), 6) + 0.0 AS re, round(sum(a.v * sin(-2 * pi() * (a.idx * b.idx % a.n) / a.n)), 6) + 0.0 AS im FROM a JOIN a b USING (key) GROUP BY b.key, b.idx""")
def fft(s: SparkSession, d: str) -> DataFrame:
    return linalg.fft(_series(s, d)).select(*_wave("key", "idx"))


@query(f"SELECT user_id AS key, idx, round(v, 6) AS re, 0.0::DOUBLE AS im FROM {_LANES}")
def fft_round_trip(s: SparkSession, d: str) -> DataFrame:
    return linalg.fft(linalg.fft(_series(s, d)), inverse=True).select(*_wave("key", "idx"))


def _waves(s: SparkSession, d: str) -> DataFrame:
    """Each embedding as an array of 8 by 8 complex numbers."""
    return _grid(s, d).select("i", F.floor(_c("j") / 8).alias("p"), (_c("j") % 8).alias("q"), _c("v").alias("re"), (_c("v") / 2).alias("im"))


@query(f"""SELECT i, k AS p, l AS q, round(sum(v * cos(t) - v / 2 * sin(t)), 6) + 0.0 AS re, round(sum(v * sin(t) + v / 2 * cos(t)), 6) + 0.0 AS im
FROM (SELECT i, k, l, v, -2 * pi() * ((j // 8 * k + j % 8 * l) % 8) / 8 AS t FROM {_GRID}, range(8) AS x(k), range(8) AS y(l)) GROUP BY i, k, l""")
def fft2(s: SparkSession, d: str) -> DataFrame:
    return linalg.fftn(_waves(s, d), ["p", "q"], by=["i"]).select(*_wave("i", "p", "q"))


@query(f"SELECT i, j // 8 AS p, j % 8 AS q, round(v, 6) + 0.0 AS re, round(v / 2, 6) + 0.0 AS im FROM {_GRID}")
def fft2_round_trip(s: SparkSession, d: str) -> DataFrame:
    there = linalg.fftn(_waves(s, d), ["p", "q"], by=["i"])
    return linalg.fftn(there, ["p", "q"], inverse=True, by=["i"]).select(*_wave("i", "p", "q"))


@query(f"""SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM (SELECT i, j, v FROM {_GRID}) GROUP BY i, j""")
def fftn_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The whole matrix of embeddings there and back."""
    cells = _grid(s, d).select("i", "j", _c("v").alias("re"), F.lit(0.0).alias("im"))
    return linalg.fftn(linalg.fftn(cells, ["i", "j"]), ["i", "j"], inverse=True).select("i", "j", (F.round("re", 6) + 0.0).alias("v"))


@query("SELECT s_suppkey AS m, round(s_acctbal * 3 - s_nationkey * s_suppkey, 4) AS determinant FROM supplier")
def determinants(s: SparkSession, d: str) -> DataFrame:
    cells = F.array(F.array(_c("s_acctbal"), _c("s_nationkey").cast("double")), F.array(_c("s_suppkey").cast("double"), F.lit(3.0)))
    return _t(s, d, "supplier").select(_c("s_suppkey").alias("m"), F.round(linalg.small_determinant(cells, 2), 4).alias("determinant"))


@query(f"SELECT i, j, v FROM {_GRID} UNION ALL SELECT i + {_ROWS}, j, v * 2 FROM {_GRID}")
def vstack(s: SparkSession, d: str) -> DataFrame:
    a, n = _grid(s, d), _n(s, d)
    return ar.vstack([(a, n), (a.withColumn("v", _c("v") * 2), n)])


@query(f"SELECT i, j, v FROM {_GRID} UNION ALL SELECT i, j + 64, v * 2 FROM {_GRID}")
def hstack(s: SparkSession, d: str) -> DataFrame:
    a = _grid(s, d)
    return ar.hstack([(a, 64), (a.withColumn("v", _c("v") * 2), 64)])


@query(f"SELECT i, j, v, 0 AS k FROM {_GRID} UNION ALL SELECT i, j, v * 2, 1 FROM {_GRID}")
def dstack(s: SparkSession, d: str) -> DataFrame:
    a = _grid(s, d)
    return ar.dstack([a, a.withColumn("v", _c("v") * 2)])


@query(f"SELECT CAST((i * 64 + j) // 32 AS BIGINT) AS i0, CAST((i * 64 + j) % 32 AS BIGINT) AS i1, v FROM {_GRID}")
def reshape(s: SparkSession, d: str) -> DataFrame:
    n = _n(s, d)
    return ar.reshape(_grid(s, d), ["i", "j"], (n, 64), (2 * n, 32))


@query(f"SELECT r AS i, j, round(v, 7) + 0.0 AS v FROM (SELECT j, avg(v) AS v FROM {_GRID} GROUP BY j), range(3) AS t(r)")
def broadcast_to(s: SparkSession, d: str) -> DataFrame:
    return ar.broadcast_to(ar.reduce_(_grid(s, d), ["mean"], ["j"]).withColumnRenamed("mean", "v"), "i", 3).withColumn("v", F.round("v", 7) + 0.0)


@query(f"SELECT i * 64 + j AS idx FROM {_GRID} WHERE v <> 0")
def flatnonzero(s: SparkSession, d: str) -> DataFrame:
    return ar.flatnonzero(_grid(s, d), ["i", "j"], (_n(s, d), 64))


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN -1 ELSE p_size END AS v FROM part")
def replace(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", ew.replace(_c("p_size"), 7, -1).alias("v"))


@query("""SELECT vec_id, k, round((a * c + b * d) / (c * c + d * d), 6) + 0.0 AS re, round((b * c - a * d) / (c * c + d * d), 6) + 0.0 AS im, a - c AS dre, b - d AS dim
FROM (SELECT vec_id, k, embedding[4 * k + 1]::DOUBLE AS a, embedding[4 * k + 2]::DOUBLE AS b, embedding[4 * k + 3]::DOUBLE + 2 AS c, embedding[4 * k + 4]::DOUBLE AS d FROM embeddings, range(16) AS t(k))""")
def complex_quotients(s: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.get("embedding", k).cast("double")
    fours = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), lambda k: F.struct(k.alias("k"), ew.complex_(at(4 * k), at(4 * k + 1)).alias("x"), ew.complex_(at(4 * k + 2) + 2, at(4 * k + 3)).alias("y")))
    rows = _t(s, d, "embeddings").select("vec_id", F.inline(fours))
    q, m = ew.complex_div(_c("x"), _c("y")), ew.complex_sub(_c("x"), _c("y"))
    return rows.select("vec_id", "k", (F.round(ew.real(q), 6) + 0.0).alias("re"), (F.round(ew.imag(q), 6) + 0.0).alias("im"), ew.real(m).alias("dre"), ew.imag(m).alias("dim"))


_POLY = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * i)), 6) + 0.0 AS sum, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * (i - 2))), 6) + 0.0 AS difference,
round(list_sum(list_transform(range(1, 64), lambda i: a[i] * (64 - i) * i)), 5) + 0.0 AS derivative, round(list_sum(list_transform(range(1, 65), lambda i: a[i] / (65 - i) * i)) + 65 * 4.0, 6) + 0.0 AS integral FROM {_POLY}""")
def polynomials(s: SparkSession, d: str) -> DataFrame:
    """Each embedding as a polynomial: coefficient k of what is made of it times k + 1, summed."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    weighed = lambda p, w: F.aggregate(F.transform(p, lambda x, i: x * w(i)), F.lit(0.0), lambda t, x: t + x)
    ones, plain = F.transform(a, lambda x: x * 0.0), lambda i: (i + 1).cast("double")
    out = {"sum": (linalg.polyadd(a, ones), 6), "difference": (linalg.polysub(F.transform(a, lambda x, i: x * i), a), 6), "derivative": (linalg.polyder(a), 5), "integral": (linalg.polyint(a, k=4.0), 6)}
    weights = {"difference": lambda i: F.lit(1.0)}
    return _t(s, d, "embeddings").select("vec_id", *((F.round(weighed(p, weights.get(k, plain)), r) + 0.0).alias(k) for k, (p, r) in out.items()))


@query(f"""WITH p AS (SELECT vec_id, a[1:16] AS a, a[17:32] AS b FROM {_POLY}), t AS (SELECT vec_id, i, j, a[i + 1] * b[j + 1] AS x FROM p, range(16) AS r(i), range(16) AS q(j))
SELECT vec_id, i + j AS k, round(sum(x), 6) + 0.0 AS v FROM t GROUP BY vec_id, i + j""")
def poly_product(s: SparkSession, d: str) -> DataFrame:
    product = linalg.polymul(F.slice("embedding", 1, 16), F.slice("embedding", 17, 16))
    rows = _t(s, d, "embeddings").select("vec_id", F.posexplode(product).alias("k", "v"))
    return rows.select("vec_id", _c("k").cast("long").alias("k"), (F.round("v", 6) + 0.0).alias("v"))


@query("SELECT p_partkey, round(p_size / 2.0 + sqrt(p_size * p_size / 4.0 + 3), 6) AS high, round(p_size / 2.0 - sqrt(p_size * p_size / 4.0 + 3), 6) AS low FROM part")
def poly_roots(s: SparkSession, d: str) -> DataFrame:
    r = linalg.roots(F.array(F.lit(1.0), -_c("p_size").cast("double"), F.lit(-3.0)))
    rows = _spread(_t(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return rows.select("p_partkey", r.alias("r")).select("p_partkey", F.round(_c("r")[0], 6).alias("high"), F.round(_c("r")[1], 6).alias("low"))


@query("""SELECT l_orderkey, l_linenumber, x = x + 1 AS eq, x + 1 > x AS gt, x < x + 1 AS lt, greatest(x, x + 1) AS mx, least(x, x + 1) AS mn, CASE WHEN x = 9007199254740993 THEN -1 ELSE x END AS replaced
FROM (SELECT l_orderkey, l_linenumber, 9007199254740992 + l_orderkey AS x FROM lineitem)""")
def long_integers(s: SparkSession, d: str) -> DataFrame:
    x = _c("x")
    y = x + 1
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(2**53) + _c("l_orderkey")).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", ew.equal(x, y).alias("eq"), ew.greater(y, x).alias("gt"), ew.less(x, y).alias("lt"), ew.maximum(x, y).alias("mx"), ew.minimum(x, y).alias("mn"), ew.replace(x, 2**53 + 1, -1).alias("replaced"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 4 = 1 THEN CAST('inf' AS DOUBLE) WHEN event_id % 4 = 2 THEN 1e300 ELSE floor(value) END AS low,
CASE WHEN event_id % 4 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 4 = 1 THEN CAST('-inf' AS DOUBLE) WHEN event_id % 4 = 2 THEN -1e300 ELSE ceil(-value) + 0.0 END AS high FROM events""")
def floors_of_odd_numbers(s: SparkSession, d: str) -> DataFrame:
    k = _c("event_id") % 4
    odd = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(1e300)).otherwise(_c("value"))
    return _t(s, d, "events").select("event_id", ew.floor(odd).alias("low"), (ew.ceil(-odd) + 0.0).alias("high"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_suppkey % 100 AS BIGINT) AS u, CAST(l_partkey % 97 AS BIGINT) AS v FROM lineitem),
w(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.v FROM w JOIN e ON e.u = w.node) SELECT node FROM w""")
def reachable(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "lineitem").select((_c("l_suppkey") % 100).cast("long").alias("u"), (_c("l_partkey") % 97).cast("long").alias("v")).distinct()
    return graph.reachable(e, 1)


@query()
def train_dense(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "embeddings").select("vec_id", _c("embedding").cast("array<double>").alias("x"), F.array((_c("label") % 2).cast("double")).alias("y"))
    model = Sequential([64, 8, 1], ["tanh", "sigmoid"])
    model.fit(rows, Sgd(1.0), 3)
    return model.forward(rows).select("vec_id", "p")


def _moved(a: DataFrame) -> DataFrame:
    """A matrix of 64 rows with row i at place 7 i + 3 modulo 64, so that no pivot is where it was."""
    return a.withColumn("i", (_c("i") * 7 + 3) % 64)


_ODD = "(SELECT count(*) FROM range(64) a(i), range(64) b(j) WHERE i < j AND (7 * i + 3) % 64 > (7 * j + 3) % 64) % 2 = 1"


@query(f"{_U} SELECT round(CASE WHEN {_ODD} THEN -1 - s ELSE 1 + s END, 9) AS determinant FROM s")
def permuted_determinant(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(blocks.determinant(_moved(_near_unit(s, d)), 64, _B),)], "x double").select(F.round("x", 9).alias("determinant"))


@query(ORACLES["linalg_solve"])
def permuted_solve(s: SparkSession, d: str) -> DataFrame:
    right = _mean(s, d).withColumn("k", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    right = right.select(_c("j").alias("i"), _c("k").alias("j"), (_c("u") * _c("j") + _c("k")).alias("v"))
    return _cells_rounded(blocks.solve(_moved(_near_unit(s, d)), _moved(right), 64, _B), 7)


@query(f"SELECT a.i, round(sum(a.v * b.v), 4) + 0.0 AS total, round(sum(CASE WHEN a.i = b.i THEN a.v * b.v END), 4) AS own FROM {_GRID} a JOIN {_GRID} b USING (j) GROUP BY a.i")
def product_of_rows(s: SparkSession, d: str) -> DataFrame:
    """The embeddings times their transpose, in blocks; of each row of the product its sum and its diagonal cell."""
    a = _grid(s, d)
    n = a.agg(F.coalesce(F.max("i") + 1, F.lit(0))).first()[0]

    def fold(z: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.stack([z.sum(axis=1), np.diagonal(z) if i == j else np.zeros(len(z))], axis=1)

    sums = blocks.product_by_rows(a, ar.permute(a, ["i", "j"], ["j", "i"]), n, n, fold, ["total", "own"])
    return sums.join(a.where("j = 0").select("i"), "i", "left_semi").select("i", (F.round("total", 4) + 0.0).alias("total"), F.round("own", 4).alias("own"))


_RANKED = "SELECT o_orderkey AS idx, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders"
_PLACED = f"(SELECT row_number() OVER (ORDER BY CASE WHEN r < 700 THEN 0 WHEN r = 700 THEN 1 ELSE 2 END, idx) - 1 AS k, idx, v FROM ({_RANKED}))"


@query(f"SELECT k AS idx, v FROM {_PLACED}")
def partition(s: SparkSession, d: str) -> DataFrame:
    return select.partition(_prices(s, d).select("idx", "v"), 700)


@query(f"SELECT k, idx FROM {_PLACED}")
def argpartition(s: SparkSession, d: str) -> DataFrame:
    return select.argpartition(_prices(s, d).select("idx", "v"), 700)


@query("SELECT user_id, median(value) AS median FROM events GROUP BY user_id")
def median_of_lanes(s: SparkSession, d: str) -> DataFrame:
    return select.median(_t(s, d, "events").select("user_id", _c("value").alias("v")), ["user_id"])


def _items(s: SparkSession, d: str) -> DataFrame:
    """The prices of all line items as one vector."""
    return ordinal(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", _c("l_extendedprice").alias("v")), ["l_orderkey", "l_linenumber", "v"], "idx").select("idx", "v")


_ITEMS = "(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS idx, l_extendedprice AS v FROM lineitem)"


@query(f"SELECT idx, round(d, 4) + 0.0 AS v FROM (SELECT idx, lead(v) OVER (ORDER BY idx) - v AS d FROM {_ITEMS}) WHERE d IS NOT NULL")
def diff_of_one_lane(s: SparkSession, d: str) -> DataFrame:
    return ar.diff(_items(s, d), "idx", []).select("idx", (F.round("v", 4) + 0.0).alias("v"))


@query(f"""SELECT idx, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 4) + 0.0 AS v
FROM (SELECT idx, v, lag(v) OVER (ORDER BY idx) AS b, lead(v) OVER (ORDER BY idx) AS a FROM {_ITEMS})""")
def gradient_of_one_lane(s: SparkSession, d: str) -> DataFrame:
    return ar.gradient(_items(s, d), "idx", []).select("idx", (F.round("v", 4) + 0.0).alias("v"))


@query(f"SELECT row_number() OVER (ORDER BY v, idx) - 1 AS k, idx FROM {_ITEMS}")
def argsort_of_one_lane(s: SparkSession, d: str) -> DataFrame:
    return ar.argsort(_items(s, d), "idx", [])


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS k FROM lineitem")
def places_in_uneven_lanes(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    return in_lanes(rows, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_orderkey", "l_linenumber"], "k").drop("l_extendedprice")


def _interpolated(kind: str, low: str, high: str) -> str:
    between = "y0 + (x - x0) * (y1 - y0) / (x1 - x0)" if kind == "linear" else "CASE WHEN x - x0 <= x1 - x THEN y0 ELSE y1 END"
    return f"""WITH k AS (SELECT s_suppkey * 2.0::DOUBLE AS x0, s_acctbal AS y0, lead(s_suppkey * 2.0::DOUBLE) OVER w AS x1, lead(s_acctbal) OVER w AS y1, lag(s_suppkey * 2.0::DOUBLE) OVER w AS xb, lag(s_acctbal) OVER w AS yb FROM supplier WINDOW w AS (ORDER BY s_suppkey)),
e AS (SELECT min(x0) AS lo, max(x0) AS hi, min_by(y0, x0) AS y_lo, max_by(y0, x0) AS y_hi FROM k), f AS (SELECT x0 AS xf, y0 AS yf, x1 AS xg, y1 AS yg FROM k ORDER BY x0 LIMIT 1),
p AS (SELECT o_orderkey, floor(o_totalprice / 1000) - 20 + 0.25 * (o_orderkey % 4) AS x FROM orders)
SELECT p.o_orderkey, round(CASE WHEN x < lo THEN {low} WHEN x > hi THEN {high} WHEN x = x0 THEN y0 ELSE {between} END, 7) + 0.0 AS y FROM p ASOF LEFT JOIN k ON p.x >= k.x0, e, f"""


def _points(s: SparkSession, d: str, kind: str, bounds: str) -> DataFrame:
    knots = _t(s, d, "supplier").select((_c("s_suppkey") * 2.0).alias("x"), _c("s_acctbal").alias("y"))
    points = _t(s, d, "orders").select("o_orderkey", (F.floor(_c("o_totalprice") / 1000) - 20 + 0.25 * (_c("o_orderkey") % 4)).alias("x"))
    return interp.interpolate(points, knots, kind=kind, bounds=bounds, fill=-1.0).select("o_orderkey", (F.round("y", 7) + 0.0).alias("y"))


@query(_interpolated("linear", "y_lo", "y_hi"))
def interpolate_clamp(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d, "linear", "clamp")


@query(_interpolated("nearest", "-1.0", "-1.0"))
def interpolate_nearest(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d, "nearest", "fill")


@query(_interpolated("linear", "yf + (x - xf) * (yg - yf) / (xg - xf)", "yb + (x - xb) * (y0 - yb) / (x0 - xb)"))
def interpolate_extrapolate(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d, "linear", "extrapolate")


def _two_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prices = ordinal(_t(s, d, "orders").select("o_orderkey", (_c("o_totalprice") / 1e5).alias("v")), ["o_orderkey"], "idx").select("idx", "v")
    return prices, _t(s, d, "supplier").select(_c("s_suppkey").cast("long").alias("idx"), (_c("s_acctbal") / 1e4).alias("v"))


_BOTH = "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice / 1e5 AS v FROM orders), b AS (SELECT s_suppkey AS j, s_acctbal / 1e4 AS v FROM supplier), n AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m)"


@query(f"{_BOTH} SELECT a.i + b.j AS idx, round(sum(a.v * b.v), 6) + 0.0 AS v FROM a, b GROUP BY a.i + b.j")
def convolve_tables(s: SparkSession, d: str) -> DataFrame:
    a, b = _two_vectors(s, d)
    return signal.convolve_tables(a, b).select("idx", (F.round("v", 6) + 0.0).alias("v"))


@query(f"{_BOTH} SELECT a.i - b.j AS idx, round(sum(a.v * b.v), 6) + 0.0 AS v FROM a, b, n WHERE a.i - b.j BETWEEN 0 AND n - m GROUP BY a.i - b.j")
def correlate_tables(s: SparkSession, d: str) -> DataFrame:
    a, b = _two_vectors(s, d)
    return signal.correlate_tables(a, b, mode="valid").select("idx", (F.round("v", 6) + 0.0).alias("v"))


@query(ORACLES["fft"])
def fft_of_any_length(s: SparkSession, d: str) -> DataFrame:
    """Lanes of eight cells at most, so longer series of prime lengths go by the chirp."""
    return linalg.fft(_series(s, d), lane=8).select(*_wave("key", "idx"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT p AS i, q AS j, round(sum(v * cos(-2 * pi() * ((i * p % n) / n + (j * q % 64) / 64))), 5) + 0.0 AS re, round(sum(v * sin(-2 * pi() * ((i * p % n) / n + (j * q % 64) / 64))), 5) + 0.0 AS im
FROM {_GRID}, n, range(4) AS a(p), range(4) AS b(q) GROUP BY p, q""")
def fftn_low(s: SparkSession, d: str) -> DataFrame:
    """The transform of the whole matrix; of it the lowest frequencies."""
    cells = _grid(s, d).select("i", "j", _c("v").alias("re"), F.lit(0.0).alias("im"))
    return linalg.fftn(cells, ["i", "j"]).where("i < 4 and j < 4").select("i", "j", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


def _powers(steps: int) -> str:
    """The quantities B between suppliers and parts, and x = (B B')^steps 1."""
    out = "WITH t AS MATERIALIZED (SELECT l_suppkey AS u, l_partkey AS w, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL), x0 AS (SELECT DISTINCT u, 1.0::DOUBLE AS x FROM t)"
    for k in range(steps):
        out += f", y{k} AS MATERIALIZED (SELECT w, sum(v * x) AS y FROM t JOIN x{k} USING (u) GROUP BY w), x{k + 1} AS MATERIALIZED (SELECT u, sum(v * y) AS x FROM t JOIN y{k} USING (w) GROUP BY u)"
    return out


@query(f"""{_powers(10)}, l AS (SELECT sqrt(sum(a.x * b.x) / sum(a.x * a.x)) AS value FROM x9 a JOIN x10 b USING (u))
SELECT CAST(k AS INT) AS k, round((1 - 2 * k) * value, 3) AS value, true AS found FROM l, range(2) AS t(k)""")
def leading_eigenvalues(s: SparkSession, d: str) -> DataFrame:
    """Of the symmetric matrix of quantities between suppliers and parts, whose leading values are a pair of opposite sign; found: whether the residual is within 1e-6."""
    trade = _t(s, d, "lineitem").groupBy(_c("l_suppkey").cast("long").alias("u"), _c("l_partkey").cast("long").alias("w")).agg(F.sum("l_quantity").cast("double").alias("v"))
    trade = fixed(trade)
    suppliers, parts = trade.agg(F.max("u"), F.max("w")).first()
    n, place = suppliers + parts + 2, _c("w") + suppliers + 1
    one_way = trade.select(_c("u").alias("i"), place.alias("j"), "v")
    whole = one_way.unionByName(one_way.select(_c("j").alias("i"), _c("i").alias("j"), "v"))
    values, vectors = krylov.eigs(whole, n, 2, symmetric=True, tolerance=1e-7)
    off = krylov.residuals(whole, values, vectors)
    rows = sorted(((float(x), bool(r <= 1e-6 * abs(x))) for x, r in zip(values.real, off, strict=True)), reverse=True)
    return s.createDataFrame([(k, round(x, 3), ok) for k, (x, ok) in enumerate(rows)], "k int, value double, found boolean")


@query("SELECT p_partkey, CAST(k AS INT) AS k, 1.0::DOUBLE AS re, round((1 - 2 * k) * sqrt(p_size), 6) AS im FROM part, range(2) AS t(k)")
def complex_roots(s: SparkSession, d: str) -> DataFrame:
    """Of x^2 - 2 x + 1 + size: 1 and, turned both ways, i times the root of the size."""
    r = linalg.complex_roots(F.array(F.lit(1.0), F.lit(-2.0), _c("p_size") + F.lit(1.0)))
    rows = _spread(_t(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return rows.select("p_partkey", F.posexplode(r).alias("k", "z")).select("p_partkey", "k", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


def _generator(seed: int) -> str:
    """The rounds of the generator as common table expressions over the orders' keys."""
    out = "WITH r0 AS (SELECT o_orderkey AS id, o_orderkey & 4294967295 AS a, o_orderkey >> 32 AS b, 0::BIGINT AS c, 0::BIGINT AS d FROM orders)"
    x, y = seed & draws.MASK, seed >> 32
    for k in range(draws.ROUNDS):
        high, low = (lambda m, c: f"(({m} * ({c} >> 16) + (({m} * ({c} & 65535)) >> 16)) >> 16)"), (lambda m, c: f"(((({m} * ({c} >> 16) + (({m} * ({c} & 65535)) >> 16)) & 65535) << 16) | (({m} * ({c} & 65535)) & 65535))")
        m, n = draws.MULTIPLIERS
        out += f", r{k + 1} AS (SELECT id, xor(xor({high(n, 'c')}, b), {x}::BIGINT) AS a, {low(n, 'c')} AS b, xor(xor({high(m, 'a')}, d), {y}::BIGINT) AS c, {low(m, 'a')} AS d FROM r{k})"
        x, y = x + draws.STEPS[0] & draws.MASK, y + draws.STEPS[1] & draws.MASK
    return out + f", u AS (SELECT id, ((a >> 5) * 67108864 + (b >> 6)) / 9007199254740992.0::DOUBLE AS u, ((c >> 5) * 67108864 + (d >> 6)) / 9007199254740992.0::DOUBLE AS v FROM r{draws.ROUNDS})"


@query(f"{_generator(42)} SELECT id, round(2 + 3 * u, 9) AS uniform, round(sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v), 6) + 0.0 AS normal, CAST(floor(u * 10) AS BIGINT) - 5 AS whole, round(-ln(1 - u) / 0.5, 6) AS exponential FROM u")
def seeded_draws(s: SparkSession, d: str) -> DataFrame:
    i = _c("o_orderkey")
    return _t(s, d, "orders").select(
        i.alias("id"), F.round(draws.uniform(42, i, 2, 5), 9).alias("uniform"), (F.round(draws.normal(42, i), 6) + 0.0).alias("normal"), draws.randint(42, i, -5, 5).alias("whole"), F.round(draws.exponential(42, i, 0.5), 6).alias("exponential"),
    )


@query(f"""WITH z AS (SELECT i, 1 / (1 + exp(-sum(v * (0.1 * (j % 5 - 2))) - 0.25)) AS p FROM {_GRID} GROUP BY i), e AS (SELECT i, 2 * (p - label % 2) * p * (1 - p) AS e FROM z JOIN embeddings ON i = vec_id)
SELECT CAST(j AS INT) AS j, round(sum(e * v), 6) + 0.0 AS g FROM e JOIN {_GRID} USING (i) GROUP BY j UNION ALL SELECT 64, round(sum(e), 6) + 0.0 FROM e""")
def tensor_gradients(s: SparkSession, d: str) -> DataFrame:
    """The derivative of the squared error of a sigmoid unit over all embeddings, by its 64 weights and its constant (64)."""
    rows = _t(s, d, "embeddings").select("embedding", F.array((_c("label") % 2).cast("double")).alias("y"))
    w, b = Tensor.weight([[0.1 * (j % 5 - 2)] for j in range(64)]), Tensor.weight([0.25])
    _, (gw, gb) = gradients(rows, (Tensor.column("embedding", 64) @ w + b).sigmoid().mse_loss(Tensor.column("y", 1)), [w, b])
    return s.createDataFrame([(j, float(g)) for j, g in enumerate([*gw.ravel(), *gb])], "j int, g double").select("j", (F.round("g", 6) + 0.0).alias("g"))
