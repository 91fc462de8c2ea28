"""Interpolation between knots that are a table: an as-of join of points and knots along x."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionMismatch
from .order import fixed, haloed, ordinal, release

#: What a point takes from the last knot that is not above it: that knot, the one before and the one after.
_SEEN = ["x0", "y0", "xb", "yb", "xa", "ya"]


def _with_neighbours(knots: DataFrame) -> DataFrame:
    rows, w = haloed(ordinal(knots, ["x0"], "k"), "k", [], 1, 1)
    near = {f"{c}{s}": f(f"{c}0").over(w) for c in "xy" for s, f in (("b", F.lag), ("a", F.lead))}
    return rows.withColumns(near).where("__own").select(*_SEEN)


def interpolate(points: DataFrame, knots: DataFrame, x: str = "x", y: str = "y", kind: str = "linear", bounds: str = "clamp", fill: float = 0.0) -> DataFrame:
    """points with the column y at their x, between knots (x, y) in any order.

    kind: linear or nearest, whose ties go low.  bounds, for points outside the knots: clamp, fill, raise or extrapolate.  A null or nan point has
    a null or nan value.  Fewer than two knots, or two of one x, raise; knots with a null or nan are left out.

    Points and knots are range-partitioned together and sorted, each partition is passed once with the last knot in hand, and one row for
    each partition tells the next ones its last knot.
    """
    given = knots.select(F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0")).where("x0 is not null and not isnan(x0) and y0 is not null")
    given = fixed(given)
    n, different = given.agg(F.count("*"), F.count_distinct("x0")).first()
    if n < 2 or different < n:
        raise DimensionMismatch("two knots or more, of different x, are needed")
    known = fixed(_with_neighbours(given))
    first, second = given.orderBy("x0").limit(2).collect()
    last = given.orderBy(F.desc("x0")).first()
    release(given)

    row = F.struct(*(F.col(f"`{c}`") for c in points.columns if c != y))
    at = F.col(f"`{x}`").cast("double")
    asked = points.select(row.alias("row"), (at + 0.0).alias("at"), F.lit(1).alias("point"), F.xxhash64(*(F.col(f"`{f.name}`") for f in points.schema if not isinstance(f.dataType, T.MapType))).alias("salt"), *(F.lit(None).cast("double").alias(c) for c in _SEEN))
    there = known.select(F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.col("x0").alias("at"), F.lit(0).alias("point"), F.lit(0).cast("long").alias("salt"), *_SEEN)
    inside = asked.where("at is not null and not isnan(at)")
    # the salt parts points that share an x
    placed = inside.unionByName(there).repartitionByRange("at", "point", "salt").sortWithinPartitions("at", "point", "salt").withColumn("part", F.spark_partition_id())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            is_knot = b.column("point").to_numpy() == 0
            seen = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _SEEN])
            place = np.maximum.accumulate(np.where(is_knot, np.arange(b.num_rows), -1))
            out = seen[:, np.maximum(place, 0)]
            before = place < 0
            out[:, before] = np.nan if held is None else held[:, None]
            missing = before if held is None else np.zeros(b.num_rows, bool)
            held = out[:, -1].copy() if not missing[-1] else None
            columns = {c: b.column(c) for c in b.schema.names}
            for c, z in zip(_SEEN, out, strict=True):
                columns[c] = pa.array(z, mask=missing | np.isnan(z))
            yield pa.RecordBatch.from_pydict(columns)

    held = fixed(placed.mapInArrow(passed, placed.schema))
    own = held.where("point = 0").groupBy("part").agg(F.max_by(F.struct(*_SEEN), "at").alias("own"))
    # one row for each partition
    parts = held.select("part").distinct().join(own, "part", "left")
    carried = F.broadcast(parts.select("part", F.last("own", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")))
    s = {c: F.when(F.col("x0").isNull(), F.col(f"carried.{c}")).otherwise(F.col(c)) for c in _SEEN}
    found = held.where("point = 1").join(carried, "part").select("row", "at", *(z.alias(c) for c, z in s.items()))

    t, c = F.col("at"), F.col
    line = lambda x0, y0, x1, y1: y0 + (t - x0) * (y1 - y0) / (x1 - x0)
    between = line(c("x0"), c("y0"), c("xa"), c("ya")) if kind == "linear" else F.when(t - c("x0") <= c("xa") - t, c("y0")).otherwise(c("ya"))
    ends = {
        "clamp": (F.lit(first.y0), F.lit(last.y0)), "fill": (F.lit(float(fill)),) * 2, "raise": (F.raise_error(F.lit("IndexOutOfBounds")).cast("double"),) * 2,
        "extrapolate": (line(*(F.lit(z) for z in (first.x0, first.y0, second.x0, second.y0))), line(c("xb"), c("yb"), c("x0"), c("y0"))) if kind == "linear" else (F.lit(first.y0), F.lit(last.y0)),
    }[bounds]
    value = F.when(t < first.x0, ends[0]).when(t > last.x0, ends[1]).when(t == c("x0"), c("y0")).otherwise(between)
    out = found.select("row.*", value.alias(y))
    rest = asked.where("at is null or isnan(at)").select("row.*", F.col("at").alias(y))
    return out.unionByName(rest)
