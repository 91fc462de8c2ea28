"""Exact order statistics: medians and partitions of lanes of any length, without a sort of the lane.

Doubles become 64-bit numbers of the same order (-0 is 0, and nan is above all; nulls have no part); longs are their own.  A lane of more than
LIMIT cells is narrowed BITS at a time from the top: its cells are counted by the next bits, counts combine before the shuffle, and
the bits in which the wanted rank falls are kept.  What is left, LIMIT different values at most or one value repeated, is counted by value.
So no task holds a lane's different values, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexOutOfBounds
from .order import fixed, ordinal, release

#: Cells of a lane that one task may see.
LIMIT = 1 << 16
#: Bits that one round of narrowing fixes.
BITS = 16
#: Lanes that are broadcast at most.
HEAVY = 1 << 12

_TOP = -(1 << 63)


def keyed(a: DataFrame, keep: list[str], value: str = "v") -> DataFrame:
    """Columns keep, v and __u: 64 bits that as an unsigned number have the order of v.  Null cells are left out."""
    rows = a.where(F.col(value).isNotNull())
    if isinstance(a.schema[value].dataType, T.IntegralType):
        return rows.select(*keep, F.col(value).alias("v"), F.col(value).cast("long").bitwiseXOR(F.lit(_TOP)).alias("__u"))
    rows = rows.select(*keep, F.col(value).cast("double").alias("v"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").to_numpy() + 0.0
            u = np.where(np.isnan(x), np.nan, x).view(np.int64)
            u = np.where(u < 0, ~u, u ^ _TOP)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(u)], [*b.schema.names, "__u"])

    return rows.mapInArrow(bits, T.StructType([*rows.schema.fields, T.StructField("__u", T.LongType())]))


def _met(cells: DataFrame, targets: DataFrame, by: list[str], total: int) -> DataFrame:
    """Cells with the targets of their lane; lanes that hold more than one in HEAVY of all cells, so HEAVY at most, are broadcast."""
    if not by:
        return cells.crossJoin(F.broadcast(targets))  # one row for each rank
    own = targets.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    gone = [f"__{c}" for c in by]
    heavy = F.col("__n") * HEAVY > total
    here = cells.join(F.broadcast(own.where(heavy)), same).drop(*gone)
    there = cells.join(F.broadcast(own.where(heavy).select(*gone).distinct()), same, "left_anti").join(own.where(~heavy), same).drop(*gone)
    return here.unionByName(there)


def order_statistics(a: DataFrame, by: list[str], wanted: Callable[[Column], list[Column]], value: str = "v") -> DataFrame:
    """The cells of given ranks in each lane: by, t (which of the ranks), rank, v, u, below (cells of smaller value) and n (cells of that value).

    wanted makes ranks, from 0, of a lane's number of cells; ranks outside the lane have no row.
    """
    cells = fixed(keyed(a, by, value))
    lanes = cells.groupBy(*by).agg(F.count("*").alias("__n"))
    ranks = F.posexplode(F.array(*(k.cast("long") for k in wanted(F.col("__n"))))).alias("__t", "__k")
    start = lanes.select(*by, "__n", ranks).where("__k >= 0 and __k < __n")
    zero = F.lit(0).cast("long")
    targets = fixed(start.withColumns({"__rank": F.col("__k"), "__prefix": zero, "__done": F.lit(0), "__below": zero, "__alive": F.col("__n")}))
    total = lanes.agg(F.sum("__n")).first()[0] or 0
    state = [*by, "__n", "__t", "__rank", "__prefix", "__done", "__below", "__k"]
    inside = (F.col("__done") == 0) | (F.call_function("shiftrightunsigned", F.col("__u"), 64 - F.col("__done")) == F.col("__prefix"))
    lane = Window.partitionBy(*by, "__t")

    def picked(counts: DataFrame, order: str) -> DataFrame:
        before = F.sum("__c").over(lane.orderBy(order)) - F.col("__c")
        return counts.withColumn("__before", before).where("__before <= __k and __k < __before + __c")

    for done in range(0, 64, BITS):
        wide = targets.where(F.col("__alive") > LIMIT)
        if wide.isEmpty():
            break
        digit = F.call_function("shiftrightunsigned", F.col("__u"), F.lit(64 - BITS - done)).bitwiseAND(F.lit((1 << BITS) - 1))
        counts = _met(cells, wide, by, total).where(inside).groupBy(*state, digit.alias("__digit")).agg(F.count("*").alias("__c"))
        next_ = picked(counts, "__digit").withColumns({
            "__prefix": F.shiftleft("__prefix", BITS).bitwiseOR(F.col("__digit")), "__done": F.lit(done + BITS), "__below": F.col("__below") + F.col("__before"),
            "__k": F.col("__k") - F.col("__before"), "__alive": F.col("__c"),
        })
        old, targets = targets, fixed(targets.where(F.col("__alive") <= LIMIT).unionByName(next_.select(*targets.columns)))
        release(old)
    counts = _met(cells, targets, by, total).where(inside).groupBy(*state, "__u").agg(F.count("*").alias("__c"), F.min("v").alias("v"))
    out = picked(counts.withColumn("__first", F.col("__u").bitwiseXOR(F.lit(_TOP))), "__first")
    out = out.select(*by, F.col("__t").alias("t"), F.col("__rank").alias("rank"), "v", F.col("__u").alias("u"), (F.col("__below") + F.col("__before")).alias("below"), F.col("__c").alias("n"))
    out = fixed(out)
    release(cells, targets)
    return out


def median(a: DataFrame, by: list[str] | None = None, value: str = "v") -> DataFrame:
    """The middle value of each lane, or half the sum of the two in the middle; without cells null, if there are no lanes to name."""
    by = by or []
    middle = order_statistics(a, by, lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)], value)
    return middle.groupBy(*by).agg(F.avg(F.col("v").cast("double")).alias("median"))


def _parted(a: DataFrame, k: int, at: str) -> DataFrame:
    """The cells of a vector with __class: 0 before the cell of rank k by value and place, 1 that cell, 2 after it."""
    cell = order_statistics(a.select(at, "v"), [], lambda n: [F.lit(k)]).first()
    if cell is None:
        raise IndexOutOfBounds(f"rank {k}")
    cells = keyed(a.select(at, "v"), [at])
    same = F.col("__u") == cell.u
    place = order_statistics(cells.where(same).select(F.col(at).alias("v")), [], lambda n: [F.lit(k - cell.below)]).first().v
    u = F.col("__u").bitwiseXOR(F.lit(_TOP))
    less = (u < F.lit(cell.u ^ _TOP)) | (same & (F.col(at) < place))
    return cells.withColumn("__class", F.when(less, 0).when(same & (F.col(at) == place), 1).otherwise(2)).drop("__u")


def partition(a: DataFrame, k: int, at: str = "idx") -> DataFrame:
    """The vector with the cell of rank k at place k, all cells of lower rank before it, and all others after it, each part in its old order.

    Equal values rank by their places, nan last; null cells are left out.
    """
    return ordinal(_parted(a, k, at).withColumnRenamed(at, "__old"), ["__class", "__old"], at).select(at, "v")


def argpartition(a: DataFrame, k: int, at: str = "idx") -> DataFrame:
    """For each place of the parted vector (k) the place in the vector."""
    return ordinal(_parted(a, k, at), ["__class", at], "k").select("k", at)
