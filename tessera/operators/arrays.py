"""Shape, selection, reduction, set, order and window operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionMismatch, IndexOutOfBounds, RankMismatch, ShapeMismatch
from .order import haloed, in_lanes, ordinal
from .select import median

def v() -> Column:
    return F.col("v")


# shapes


def broadcast_shape(*shapes: tuple[int, ...]) -> tuple[int, ...]:
    """The common shape, aligned at the right; an axis of size 1 gives way to any other, 0 too."""
    out: list[int] = []
    for k in range(1, max(map(len, shapes), default=0) + 1):
        sizes = {s[-k] for s in shapes if len(s) >= k} - {1}
        if len(sizes) > 1:
            raise ShapeMismatch(f"cannot broadcast {shapes}")
        out.insert(0, sizes.pop() if sizes else 1)
    return tuple(out)


def are_broadcastable(*shapes: tuple[int, ...]) -> bool:
    try:
        broadcast_shape(*shapes)
    except ShapeMismatch:
        return False
    return True


def broadcast_binary(a: DataFrame, b: DataFrame, on: list[str], f) -> DataFrame:  # noqa: ANN001
    """f of two arrays that share the axes `on`; axes that only one has are kept."""
    axes = [c for c in a.columns if c != "v"] + [c for c in b.columns if c != "v" and c not in a.columns]
    x, y = a.withColumnRenamed("v", "x"), b.withColumnRenamed("v", "y")
    return (x.join(y, on) if on else x.crossJoin(y)).select(*axes, f(F.col("x"), F.col("y")).alias("v"))


def reshape(a: DataFrame, axes: list[str], shape: tuple[int, ...], to: tuple[int, ...]) -> DataFrame:
    """Row-major; a projection without a shuffle.  New axes are i0, i1, ..."""
    if math.prod(shape) != math.prod(to):
        raise DimensionMismatch(f"{shape} has not the size of {to}")
    flat = F.lit(0).cast("long")
    for c, n in zip(axes, shape, strict=True):
        flat = flat * n + F.col(c)
    out, stride = [], math.prod(to)
    for k, n in enumerate(to):
        stride //= max(1, n)
        out.append(F.pmod(F.floor(flat / stride), F.lit(n)).cast("long").alias(f"i{k}"))
    return a.select(*out, "v")


def flatten(a: DataFrame, axes: list[str], shape: tuple[int, ...]) -> DataFrame:
    return reshape(a, axes, shape, (math.prod(shape),)).withColumnRenamed("i0", "idx")


def permute(a: DataFrame, axes: list[str], to: list[str]) -> DataFrame:
    """Renames axis columns: axes[k] becomes to[k].  Transposes, swaps and moves are cases of it."""
    if sorted(axes) != sorted(to):
        raise DimensionMismatch(f"{to} is no permutation of {axes}")
    return a.select(*(F.col(x).alias(y) for x, y in zip(axes, to, strict=True)), "v")


def expand_dims(a: DataFrame, axis: str) -> DataFrame:
    return a.withColumn(axis, F.lit(0).cast("long"))


def squeeze(a: DataFrame, axis: str) -> DataFrame:
    """a without an axis of size 1; a place other than 0 on it raises where it is read."""
    first = F.when(F.col(axis) == 0, v()).otherwise(F.raise_error(F.lit(f"DimensionMismatch: axis {axis} is longer than 1")).cast(a.schema["v"].dataType))
    return a.withColumn("v", first).drop(axis)


def concatenate(parts: list[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """Arrays with their sizes along the axis, one after another."""
    out, at = None, 0
    for a, n in parts:
        moved = a.withColumn(axis, F.col(axis) + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    if out is None:
        raise DimensionMismatch("nothing to concatenate")
    return out


def stack(parts: list[DataFrame], axis: str) -> DataFrame:
    return concatenate([(a.withColumn(axis, F.lit(0).cast("long")), 1) for a in parts], axis)


def vstack(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices with their row counts, one below another; vectors (idx, v) are rows."""
    if parts and "idx" in parts[0][0].columns:
        return stack([a.select(F.col("idx").alias("j"), "v") for a, _ in parts], "i")
    return concatenate(parts, "i")


def hstack(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices with their column counts side by side, vectors with their lengths end to end."""
    return concatenate(parts, "idx" if parts and "idx" in parts[0][0].columns else "j")


def dstack(parts: list[DataFrame]) -> DataFrame:
    """Matrices along a third axis k."""
    return stack(parts, "k")


def broadcast_to(a: DataFrame, axis: str, size: int) -> DataFrame:
    """An array without the axis, repeated along it."""
    return a.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))) if size > 0 else expand_dims(a, axis).where("false")


def tile(a: DataFrame, axis: str, size: int, times: int) -> DataFrame:
    return a.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) + F.col("__r") * size).drop("__r") if times > 0 else a.where("false")


def repeat(a: DataFrame, axis: str, times: int) -> DataFrame:
    return a.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) * times + F.col("__r")).drop("__r") if times > 0 else a.where("false")


def flip(a: DataFrame, axis: str, size: int) -> DataFrame:
    return a.withColumn(axis, F.lit(size - 1) - F.col(axis))


def roll(a: DataFrame, axis: str, size: int, shift: int) -> DataFrame:
    return a.withColumn(axis, F.pmod(F.col(axis) + shift, F.lit(size))) if size else a


def delete(a: DataFrame, positions: list[int]) -> DataFrame:
    """A vector without some positions, numbered anew; positions out of range and repeats are passed over."""
    gone = sorted({p for p in positions if p >= 0})
    before = F.size(F.filter(F.array(*(F.lit(p) for p in gone)).cast("array<long>"), lambda p: p < F.col("idx"))) if gone else F.lit(0)
    return a.where(~F.col("idx").isin(gone)).withColumn("idx", F.col("idx") - before) if gone else a


# selection


def slice_(a: DataFrame, axis: str, start: int, stop: int, step: int = 1) -> DataFrame:
    if step <= 0:
        raise DimensionMismatch("step must be above 0")
    at = F.col(axis) - start
    return a.where((F.col(axis) >= start) & (F.col(axis) < stop) & (at % step == 0)).withColumn(axis, F.floor(at / step))


def _ends(part: tuple[int, ...], n: int) -> tuple[int, int, int]:
    """start, stop, step of a range along an axis of n; the stop is clamped, a start past the axis is an error."""
    start, stop, step = (*part, 1)[:3]
    if step <= 0:
        raise DimensionMismatch("step must be above 0")
    if not 0 <= start < n:
        raise IndexOutOfBounds(f"{start} of {n}")
    return start, min(stop, n), step


def _position(part: int, n: int) -> int:
    if not 0 <= part < n:
        raise IndexOutOfBounds(f"{part} of {n}")
    return part


def slices(a: DataFrame, axes: list[str], shape: tuple[int, ...], parts: list[int | tuple[int, ...] | None]) -> DataFrame:
    """A part for each axis: None keeps it, a number takes one position and drops the axis, (start, stop) or (start, stop, step) a range."""
    if not len(axes) == len(shape) == len(parts):
        raise RankMismatch(f"{parts} for {axes}")
    for axis, n, part in zip(axes, shape, parts, strict=True):
        if isinstance(part, int):
            a = a.where(F.col(axis) == _position(part, n)).drop(axis)
        elif part is not None:
            a = slice_(a, axis, *_ends(part, n))
    return a


def slice_shape(shape: tuple[int, ...], parts: list[int | tuple[int, ...] | None]) -> tuple[int, ...]:
    """The shape that `slices` gives; here a stop past the axis is an error."""
    if len(shape) != len(parts):
        raise RankMismatch(f"{parts} for {shape}")
    out = []
    for n, part in zip(shape, parts, strict=True):
        if isinstance(part, int):
            _position(part, n)
        elif part is None:
            out.append(n)
        else:
            start, stop, step = _ends(part, n)
            if part[1] > n:
                raise IndexOutOfBounds(f"{part[1]} of {n}")
            out.append(max(0, -(-(stop - start) // step)))
    return tuple(out)


def _at(axes: list[str], shape: tuple[int, ...], place: tuple[int, ...]) -> Column:
    if not len(axes) == len(shape) == len(place):
        raise RankMismatch(f"{place} for {axes}")
    out = F.lit(True)
    for axis, n, k in zip(axes, shape, place, strict=True):
        out = out & (F.col(axis) == _position(k, n))
    return out


def get(a: DataFrame, axes: list[str], shape: tuple[int, ...], place: tuple[int, ...]) -> DataFrame:
    """The cell at a place, one row v; the filter reaches the scan."""
    return a.where(_at(axes, shape, place)).select("v")


def set_(a: DataFrame, axes: list[str], shape: tuple[int, ...], place: tuple[int, ...], value: float) -> DataFrame:
    """The array with another value at a place."""
    return a.withColumn("v", F.when(_at(axes, shape, place), F.lit(value)).otherwise(v()))


def boolean_mask(a: DataFrame, mask: Column, order: list[str]) -> DataFrame:
    """The cells where mask is true, numbered in the order of the axes."""
    return ordinal(a.where(mask), order, "idx").select("idx", "v")


def take(a: DataFrame, axis: str, positions: list[int], size: int) -> DataFrame:
    """Cells at the positions, which may repeat, in their order."""
    if any(not 0 <= p < size for p in positions):
        raise IndexOutOfBounds(f"{positions} of {size}")
    wanted = a.sparkSession.createDataFrame([(p, k) for k, p in enumerate(positions)], f"{axis} long, __k long")
    return a.join(wanted, axis).withColumn(axis, F.col("__k")).drop("__k")


def find(a: DataFrame, predicate: Column, at: str = "idx") -> DataFrame:
    return a.where(predicate).select(at)


def nonzero(a: DataFrame, axes: list[str]) -> DataFrame:
    return a.where((v() != 0) | F.isnan(v())).select(*axes)


def flatnonzero(a: DataFrame, axes: list[str], shape: tuple[int, ...]) -> DataFrame:
    return nonzero(flatten(a, axes, shape), ["idx"])


def replace_end(a: DataFrame, old: float, new: float, at: str = "idx", last: bool = False) -> DataFrame:
    """Replaces the first or last cell that equals old."""
    place = a.where(v() == old).agg((F.max if last else F.min)(at).alias("__m"))
    return a.crossJoin(F.broadcast(place)).withColumn("v", F.when(F.col(at) == F.col("__m"), F.lit(new)).otherwise(v())).drop("__m")


def search(a: DataFrame, target: float, at: str = "idx") -> DataFrame:
    """The first place of a value, null if there is none; the rule of all three searches of sorted or unsorted vectors."""
    return a.where(v() == target).agg(F.min(at).alias(at))


# reductions: by=[] reduces all cells, else the axes in `by` are kept


def _numbers(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


#: Aggregates by name.  Extremes leave nan out; variance and deviation are of the population; an empty product is 1.
REDUCTIONS = {
    "sum": F.sum, "mean": F.avg, "min": lambda x: F.min(_numbers(x)), "max": lambda x: F.max(_numbers(x)), "prod": lambda x: F.coalesce(F.product(x), F.lit(1.0)), "var": F.var_pop, "std": F.stddev_pop,
    "count": F.count,
}

#: Those of whole numbers, which keep their type: a sum past a long raises.  mean_trunc is the sum over the count, cut towards 0.
WHOLE = {"sum": F.sum, "min": F.min, "max": F.max, "mean_trunc": lambda x: F.expr("div(sum(__x), count(__x))")}


def reduce_(a: DataFrame, how: list[str], by: list[str] | None = None, value: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep: axes that are reduced and stay with size 1, as position 0.

    Whole numbers are summed, multiplied and compared as longs, all else as doubles.  median is exact (see `select`).
    """
    by = by or []
    a = a.withColumn("__x", v() if value is None else value)
    whole = isinstance(a.schema["__x"].dataType, T.IntegralType)
    own = a.withColumn("__x", F.col("__x").cast("long" if whole else "double"))
    x = F.col("__x")

    def aggregate(h: str) -> Column:
        return (WHOLE[h](x) if whole and h in WHOLE else REDUCTIONS[h](x.cast("double"))).alias(h)

    apart = {"median": lambda: median(own, by, "__x"), "prod": lambda: _whole_product(own, by)}
    apart = {h: f for h, f in apart.items() if h in how and (h == "median" or whole)}
    out = own.groupBy(*by).agg(*(aggregate(h) for h in how if h not in apart), F.lit(None).alias("__none")).drop("__none")
    for f in apart.values():
        out = _joined(out, f(), by, "left")
    return out.select(*by, *how).withColumns({c: F.lit(0).cast("long") for c in keep or []})


def _whole_product(a: DataFrame, by: list[str]) -> DataFrame:
    """The product of the longs __x of each lane; 1 without cells, and past a long an error.

    A product that is not 0 and fits a long has 63 factors beside 1 and -1 at most.  Sums of logarithms tell where that is so; there
    these factors are gathered.
    """
    x = F.col("__x")
    size = F.sum(F.when(x != 0, F.ln(F.abs(x.cast("double")))))
    signs = a.groupBy(*by).agg(F.count_if(x == 0).alias("__zeros"), F.count_if(x < 0).alias("__negative"), F.coalesce(size, F.lit(0.0)).alias("__ln"))
    factors = _joined(a.where("abs(cast(__x as double)) > 1"), signs.where("__zeros = 0 and __ln < 44"), by)
    product = F.aggregate(F.collect_list(F.abs(x.cast("decimal(38,0)"))), F.lit(1).cast("decimal(38,0)"), lambda s, y: (s * y).cast("decimal(38,0)"))
    sign = F.when(F.col("__negative") % 2 == 1, F.lit(-1)).otherwise(F.lit(1))
    out = _joined(signs, factors.groupBy(*by).agg(product.alias("__p")), by, "left")
    too_large = (F.col("__zeros") == 0) & (F.col("__ln") >= 44)
    value = F.when(too_large, F.raise_error(F.lit("the product exceeds a long")).cast("long")).when(F.col("__zeros") > 0, F.lit(0).cast("long"))
    return out.select(*by, value.otherwise((F.coalesce("__p", F.lit(1)) * sign).cast("long")).alias("prod"))


def argmax(a: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    """The first place of the greatest value."""
    return a.where(~F.isnan(v())).groupBy(*(by or [])).agg(F.max_by(at, F.struct(v(), -F.col(at))).alias("argmax"))


def argmin(a: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    return a.where(~F.isnan(v())).groupBy(*(by or [])).agg(F.min_by(at, F.struct(v(), F.col(at))).alias("argmin"))


def bincount(a: DataFrame) -> DataFrame:
    """(bin, n) for 0 to the greatest value, bins without rows too."""
    counts = a.groupBy(v().cast("long").alias("bin")).agg(F.count("*").alias("n"))
    low, high = counts.agg(F.min("bin"), F.max("bin")).first()
    if low is not None and low < 0:
        raise DimensionMismatch("negative value")
    bins = a.sparkSession.range(0 if high is None else high + 1).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# sets of values: distinct, sorted where the caller orders them


def unique(a: DataFrame) -> DataFrame:
    return a.select("v").distinct()


def intersect1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").intersect(b.select("v"))


def union1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").union(b.select("v")).distinct()


def setdiff1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").subtract(b.select("v"))


def setxor1d(a: DataFrame, b: DataFrame) -> DataFrame:
    """One pass over both: values that only one side has."""
    both = a.select("v", F.lit(1).alias("s")).union(b.select("v", F.lit(2).alias("s")))
    return both.groupBy("v").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo = hi").select("v")


def in1d(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with the column found; the order and repeats of a stay."""
    there = b.select(F.col("v")).distinct().withColumn("__there", F.lit(True))
    return a.join(there, "v", "left").withColumn("found", F.coalesce("__there", F.lit(False))).drop("__there")


# order


def sort(a: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """Each lane sorted along the axis, by one sort of all lanes; equal values keep their order."""
    return in_lanes(a.withColumnRenamed(axis, "__i"), by, ["v", "__i"], "__k").withColumn("__i", F.col("__k")).drop("__k").withColumnRenamed("__i", axis)


def sort1d(a: DataFrame) -> DataFrame:
    """A whole vector sorted by value, by range partitioning; the places of equal values part a value that many cells have."""
    return ordinal(a.withColumnRenamed("idx", "__i"), ["v", "__i"], "idx").drop("__i")


def argsort(a: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """For each place of the sorted lane (k) the place in the lane."""
    return in_lanes(a.select(*by, axis, "v"), by, ["v", axis], "k").select(*by, "k", axis)


def smallest(a: DataFrame, k: int, at: str = "idx") -> DataFrame:
    """The k smallest cells: a partial sort in each partition, no full sort."""
    return a.orderBy("v", at).limit(k)


# neighbours along an axis


def diff(a: DataFrame, axis: str, by: list[str], n: int = 1) -> DataFrame:
    """The n-th forward difference along an axis numbered without gaps; the axis starts at 0 again."""
    if n < 1:
        return a
    rows, w = haloed(a, axis, by, 0, n)
    for _ in range(n):
        # a null cell gives null differences on both of its sides; only the last place of a lane goes
        rows = rows.withColumns({"__more": F.lead(F.lit(True)).over(w), "v": F.lead("v").over(w) - v()}).where("__more")
    return rows.where("__own").drop("__more", "__block", "__own")


def gradient(a: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """Central differences inside, one-sided ones at both ends of a lane numbered without gaps; a null neighbour gives null."""
    rows, w = haloed(a, axis, by, 1, 1)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    first, last = F.lag(F.lit(True)).over(w).isNull(), F.lead(F.lit(True)).over(w).isNull()
    x = F.when(first, after - v()).when(last, v() - before).otherwise((after - before) / 2.0)
    return rows.withColumn("v", x).where("__own").drop("__block", "__own")


def convolve(a: DataFrame, kernel: list[float], n: int | None = None, mode: str = "full", by: list[str] | None = None) -> DataFrame:
    """A vector of n cells, or lanes, with a short kernel: each cell is spread over the kernel and summed per place.

    mode: full, same or valid.  Without n each lane has its own length, which reaches to its last cell.
    """
    m, by = len(kernel), by or []
    if not m or n == 0:
        raise DimensionMismatch("empty operand")
    taps = F.array(*(F.struct(F.lit(j).cast("long").alias("j"), F.lit(float(x)).alias("x")) for j, x in enumerate(kernel)))
    spread = a.withColumn("t", F.explode(taps)).select(*by, (F.col("idx") + F.col("t.j")).alias("idx"), (v() * F.col("t.x")).alias("v"))
    out = spread.groupBy(*by, "idx").agg(F.sum("v").alias("v"))
    if mode == "full":
        return out
    if n is None:
        lengths = a.groupBy(*by).agg((F.max("idx") + 1).alias("__n"))
        out, size = _joined(out, lengths, by), F.col("__n")
    else:
        out, size = out.withColumn("__n", F.lit(n)), F.lit(n)
    short, long = F.least(size, F.lit(m)), F.greatest(size, F.lit(m))
    kept, first = (long - short + 1, short - 1) if mode == "valid" else (long, F.floor((size + m - 1 - long) / 2))
    return out.withColumn("__first", first).where((F.col("idx") >= F.col("__first")) & (F.col("idx") < F.col("__first") + kept)).withColumn("idx", F.col("idx") - F.col("__first")).drop("__n", "__first")


def _joined(a: DataFrame, per_lane: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a with the columns of a table of one row per lane; null is a lane like others, and without lanes there is one row."""
    if not by:
        return a.join(F.broadcast(per_lane), F.lit(True), how)  # one row
    lane = per_lane.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(lane, same, how).drop(*(f"__{c}" for c in by))


def correlate(a: DataFrame, kernel: list[float], n: int | None = None, mode: str = "full", by: list[str] | None = None) -> DataFrame:
    return convolve(a, kernel[::-1], n, mode, by)


def interp1d(knots: list[tuple[float, float]], x: Column, kind: str = "linear", bounds: str = "clamp", fill: float = 0.0) -> Column:
    """Interpolation between knots, sorted by x; ties of `nearest` go low.  bounds: clamp, fill, raise or extrapolate."""
    xs, ys = [k[0] for k in knots], [k[1] for k in knots]
    if len(knots) < 2 or any(a >= b for a, b in zip(xs, xs[1:], strict=False)):
        raise DimensionMismatch("two knots or more, of increasing x, are needed")
    segments = F.array(*(F.struct(*(F.lit(float(z)).alias(c) for c, z in zip(("x0", "y0", "x1", "y1"), (*a, *b), strict=True))) for a, b in zip(knots, knots[1:], strict=False)))
    k = F.greatest(F.lit(1), F.least(F.lit(len(knots) - 1), F.size(F.filter(F.array(*map(F.lit, map(float, xs))), lambda z: z <= x))))
    s = F.element_at(segments, k)
    line = s["y0"] + (x - s["x0"]) * (s["y1"] - s["y0"]) / (s["x1"] - s["x0"])
    inside = line if kind == "linear" else F.when(x - s["x0"] <= s["x1"] - x, s["y0"]).otherwise(s["y1"])
    low, high = {
        "clamp": (F.lit(float(ys[0])), F.lit(float(ys[-1]))), "fill": (F.lit(float(fill)),) * 2, "raise": (F.raise_error(F.lit("IndexOutOfBounds")).cast("double"),) * 2,
        "extrapolate": (line, line) if kind == "linear" else (F.lit(float(ys[0])), F.lit(float(ys[-1]))),
    }[bounds]
    return F.when(x < xs[0], low).when(x > xs[-1], high).otherwise(inside)


def softmax(a: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per lane, or over the whole array, shifted by the greatest value: two aggregates that combine before the shuffle."""
    by = by or []
    e = _joined(a, a.groupBy(*by).agg(F.max("v").alias("__m")), by).withColumn("v", F.exp(v() - F.col("__m"))).drop("__m")
    return _joined(e, e.groupBy(*by).agg(F.sum("v").alias("__s")), by).withColumn("v", v() / F.col("__s")).drop("__s")


def loss(kind: str) -> Column:
    """An aggregate over rows with y and p: mse, mae, hinge, bce, cce_sum over cells, or cce over rows whose y and p are arrays."""
    y, p = F.col("y"), F.col("p")
    clipped = lambda x: F.least(F.greatest(x, F.lit(1e-7)), F.lit(1 - 1e-7))
    inside = clipped(p)
    return {
        "mse": lambda: F.avg(F.pow(y - p, 2)), "mae": lambda: F.avg(F.abs(y - p)), "hinge": lambda: F.avg(F.greatest(F.lit(0.0), 1 - y * p)),
        "bce": lambda: F.avg(-(y * F.ln(inside) + (1 - y) * F.ln(1 - inside))), "cce_sum": lambda: F.sum(-y * F.ln(inside)),
        "cce": lambda: F.avg(F.aggregate(F.zip_with(y, p, lambda a, b: -a * F.ln(clipped(b))), F.lit(0.0), lambda s, x: s + x)),
    }[kind]()
