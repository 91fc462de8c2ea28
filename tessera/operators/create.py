"""Arrays from nothing: constants, ranges and random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..functions import draws


def full(spark: SparkSession, shape: tuple[int, ...], value: float) -> DataFrame:
    """Columns i0, i1, ... and v, in one range over the cells: no join of axes."""
    size = math.prod(shape)
    axes, stride = [], size
    for k, n in enumerate(shape):
        stride //= max(1, n)
        axes.append(F.pmod(F.floor(F.col("id") / stride), F.lit(n)).cast("long").alias(f"i{k}"))
    return spark.range(size).select(*axes, F.lit(float(value)).alias("v"))


def zeros(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    return full(spark, shape, 1.0)


def eye(spark: SparkSession, n: int) -> DataFrame:
    """The cells of the diagonal; the others are left out, as in all coordinate forms."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    """Half-open; each value is start + idx * step, so nothing drifts."""
    if step == 0:
        raise DimensionMismatch("step is 0")
    n = max(0, math.ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int) -> DataFrame:
    """num points, stop included."""
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return spark.range(num).select(F.col("id").alias("idx"), (F.lit(float(start)) + F.col("id") * F.lit(step)).alias("v"))


def _drawn(spark: SparkSession, n: int, drawn: Column) -> DataFrame:
    """n draws; each is fixed by the seed and its index, however the rows are partitioned."""
    return spark.range(n).select(F.col("id").alias("idx"), drawn.alias("v"))


def uniform(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return _drawn(spark, n, draws.uniform(seed, F.col("id")))


def normal(spark: SparkSession, n: int, seed: int, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    return _drawn(spark, n, draws.normal(seed, F.col("id"), mean, sd))


def randint(spark: SparkSession, n: int, seed: int, low: int, high: int) -> DataFrame:
    """From low to high, high excluded."""
    return _drawn(spark, n, draws.randint(seed, F.col("id"), low, high))


def exponential(spark: SparkSession, n: int, seed: int, scale: float = 1.0) -> DataFrame:
    return _drawn(spark, n, draws.exponential(seed, F.col("id"), 1.0 / scale))


def poisson(spark: SparkSession, n: int, seed: int, lam: float) -> DataFrame:
    return _drawn(spark, n, draws.poisson(seed, F.col("id"), lam))


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """0 to n - 1 in random order, by the order of seeded hashes."""
    from .order import ordinal

    keyed = spark.range(n).select(F.col("id").alias("v"), F.xxhash64(F.lit(seed), "id").alias("key"))
    return ordinal(keyed, ["key", "v"], "idx").select("idx", "v")


def shuffle(a: DataFrame, axis: str, size: int, seed: int) -> DataFrame:
    """An array with its positions along an axis in random order: whole slices move, each to its place in a permutation."""
    moved = permutation(a.sparkSession, size, seed).select(F.col("idx").alias(axis), F.col("v").alias("__to"))
    return a.join(moved, axis).withColumn(axis, F.col("__to")).select(*a.columns)


def choice(values: DataFrame, k: int, seed: int, replace: bool = False) -> DataFrame:
    """k values (idx, v): without replacement those of the smallest seeded hashes; with it, those at random places."""
    spark = values.sparkSession
    if not replace:
        out = values.orderBy(F.xxhash64(F.lit(seed), "idx"), "idx").limit(k)
        if out.count() < k:
            raise DimensionMismatch("fewer values than asked for")
        return out.select("v")
    n = values.count()
    drawn = spark.range(k).select(draws.randint(seed, F.col("id"), 0, n).alias("idx"))
    return drawn.join(values, "idx").select("v")
