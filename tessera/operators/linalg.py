"""Linear algebra on coordinate matrices (i, j, v), and dense kernels for small ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SingularMatrix
from ..functions.roots import complex_roots, roots  # noqa: F401
from .blocks import as_cells, gram_matrix
from .order import fixed
from .signal import chirp


def v() -> Column:
    return F.col("v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A join on the inner axis and a sum; products combine before the shuffle."""
    x, y = a.select("i", F.col("j").alias("k"), v().alias("x")), b.select(F.col("i").alias("k"), "j", v().alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(rows: DataFrame, array: str, n: int) -> DataFrame:
    """The n by n matrix of inner products of the positions of an array column: one matrix product for each batch of rows, one partial sum for each task."""
    return as_cells(rows, gram_matrix(rows, array, n))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns, within the row."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(v() * v())).alias("norm"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def to_dense(a: DataFrame, rows: int, cols: int) -> DataFrame:
    cells = a.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), F.pmod("id", F.lit(cols)).alias("j"))
    return cells.join(a, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def from_dense(a: DataFrame) -> DataFrame:
    return a.where((v() != 0) | F.isnan(v()))


def row_pointers(a: DataFrame, rows: int) -> DataFrame:
    """Non-zero cells of each row; a running sum of n gives the row pointers."""
    counts = from_dense(a).groupBy("i").agg(F.count("*").alias("n"))
    return a.sparkSession.range(rows).withColumnRenamed("id", "i").join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def lu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without row exchanges, unit diagonal in the left factor."""
    n = len(x)
    left, up = np.eye(n), x.astype(float).copy()
    for k in range(n - 1):
        if up[k, k] == 0:
            raise SingularMatrix("zero pivot")
        left[k + 1 :, k] = up[k + 1 :, k] / up[k, k]
        up[k + 1 :] -= np.outer(left[k + 1 :, k], up[k])
    return left, np.triu(up)


def _qr(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(x)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def small_determinant(cells: Column, n: int) -> Column:
    """The determinant of a small matrix, an array of n rows, by its first row, within the row of Spark."""

    def minor(rows: list[int], columns: list[int]) -> Column:
        if not rows:
            return F.lit(1.0)
        out = F.lit(0.0)
        for k, c in enumerate(columns):
            out = out + (-1) ** k * cells[rows[0]][c].cast("double") * minor(rows[1:], columns[:k] + columns[k + 1 :])
        return out

    return minor(list(range(n)), list(range(n)))


def _solve(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(x, b)
    except np.linalg.LinAlgError as e:
        raise SingularMatrix(str(e)) from e


#: Kernels of one dense matrix: named results.
KERNELS = {
    "inverse": lambda x: {"inverse": _solve(x, np.eye(len(x)))}, "determinant": lambda x: {"determinant": np.array([[np.linalg.det(x)]])},
    "qr": lambda x: dict(zip("qr", _qr(x), strict=True)), "cholesky": lambda x: {"l": np.linalg.cholesky(x)}, "lu": lambda x: dict(zip("lu", lu(x), strict=True)),
    "eig": lambda x: (lambda w, v: {"values": w[::-1, None], "vectors": v[:, ::-1]})(*np.linalg.eigh(x)), "eigvals": lambda x: {"values": -np.sort(-np.linalg.eigvals(x).real)[:, None]},
    "svd": lambda x: (lambda u, s, vt: {"u": u, "s": s[:, None], "vt": vt})(*np.linalg.svd(x, full_matrices=False)),
}


def dense(a: DataFrame, kernel: str, rows: int, cols: int, key: str = "m") -> DataFrame:
    """A kernel on each matrix of a table (key, i, j, v), a task per matrix; each has to fit in a task's memory.

    Rows: key, part (the name of the result), i, j, v.
    """
    f = KERNELS[kernel]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((rows, cols))
        x[group["i"], group["j"]] = group["v"]
        out = [pd.DataFrame({key: group[key].iloc[0], "part": n, "i": np.repeat(np.arange(len(y)), y.shape[1]), "j": np.tile(np.arange(y.shape[1]), len(y)), "v": y.ravel()}) for n, y in f(x).items()]
        return pd.concat(out)

    return a.groupBy(key).applyInPandas(one, f"{key} long, part string, i long, j long, v double")


def solve(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """x of A x = b for matrices (m, i, j, v) and right sides (m, i, v), which go along as column n of the matrix."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((n, n + 1))
        x[group["i"], group["j"]] = group["v"]
        return pd.DataFrame({"m": group["m"].iloc[0], "i": np.arange(n), "v": _solve(x[:, :n], x[:, n])})

    both = a.select("m", "i", "j", "v").unionByName(b.select("m", "i", F.lit(n).cast("long").alias("j"), "v"))
    return both.groupBy("m").applyInPandas(one, "m long, i long, v double")


# polynomials: array columns of coefficients, highest power first, all within the row


def _padded(a: Column, n: Column) -> Column:
    """a with zeros before it, up to n coefficients."""
    return F.concat(F.array_repeat(F.lit(0.0), F.greatest(n - F.size(a), F.lit(0))), a.cast("array<double>"))


def polyadd(a: Column, b: Column) -> Column:
    n = F.greatest(F.size(a), F.size(b))
    return F.zip_with(_padded(a, n), _padded(b, n), lambda x, y: x + y)


def polysub(a: Column, b: Column) -> Column:
    return polyadd(a, F.transform(b, lambda x: -x))


def polymul(a: Column, b: Column) -> Column:
    """Coefficient k of the product sums those pairs whose places sum to k; empty if either is."""
    n, m = F.size(a), F.size(b)

    def cell(k: Column) -> Column:
        places = F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1))
        return F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(a, i).cast("double") * F.get(b, k - i).cast("double"))

    return F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(0), F.greatest(n + m - 2, F.lit(0))), cell)).otherwise(F.array().cast("array<double>"))


def polyder(a: Column, m: int = 1) -> Column:
    """The m-th derivative; that of a constant is the polynomial 0."""
    for _ in range(m):
        a = F.when(F.size(a) > 1, _derived(a)).otherwise(F.array(F.lit(0.0)))
    return a


def _derived(a: Column) -> Column:
    n = F.size(a)
    return F.transform(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, i: x.cast("double") * (n - 1 - i))


def polyint(a: Column, m: int = 1, k: float = 0.0) -> Column:
    """The m-th integral, k the constant of each."""
    for _ in range(m):
        a = _integrated(a, k)
    return a


def _integrated(a: Column, k: float) -> Column:
    n = F.size(a)
    return F.array_append(F.transform(a, lambda x, i: x.cast("double") / (n - i)), F.lit(float(k)))


# transforms: lanes are gathered in the JVM, and all lanes of one length in a batch are transformed at once

#: Cells of a lane that is transformed in one piece.
LANE = 1 << 14


def _lanes(series: DataFrame, by: list[str], at: str, inverse: bool, size: str | None = None) -> DataFrame:
    """The unscaled transform along `at` (0 to n - 1 without gaps) of each lane: columns by, at, re, im.

    size: the one of the columns `by` that is a lane's length; its last cells may be left out and count as 0.  Without it a lane is as long as its cells.
    """
    cells = series.select(*by, F.col(at).cast("long").alias(at), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    dealt = (cells.repartition(*by) if by else cells.repartition(1)).sortWithinPartitions(*by, at)

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        places, re, im = (t.column(c).to_numpy() for c in (at, "re", "im"))
        start = np.flatnonzero(places == 0)
        runs = np.diff(start, append=len(places))
        sizes = t.column(size).to_numpy()[start] if size else runs
        flat = re + 1j * im
        for n in np.unique(sizes):
            own, mask = np.flatnonzero(sizes == n), np.repeat(sizes == n, runs)
            x = np.zeros((len(own), n), complex)
            x[np.repeat(np.arange(len(own)), runs[own]), places[mask]] = flat[mask]
            y = (np.fft.ifft(x, axis=1) * n if inverse else np.fft.fft(x, axis=1)).ravel()
            kept = t.select(by).take(pa.array(np.repeat(start[own], n))).combine_chunks()
            yield pa.RecordBatch.from_pydict({c: _chunk(kept.column(c)) for c in by} | {at: pa.array(np.tile(np.arange(n), len(own))), "re": pa.array(y.real.copy()), "im": pa.array(y.imag.copy())})

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the cells of a lane that goes on
        for b in batches:
            begins = np.flatnonzero(b.column(at).to_numpy() == 0)
            if not len(begins):
                held += [b] if b.num_rows else []
                continue
            last = int(begins[-1])
            if held or last:
                yield from whole(pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks())
            held = [b.slice(last)]
        if held:
            yield from whole(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(transformed, cells.schema)


def _chunk(x: pa.ChunkedArray) -> pa.Array:
    return x.chunk(0) if x.num_chunks == 1 else pa.concat_arrays(x.chunks)


def _laid_out(cells: DataFrame, by: list[str], inverse: bool) -> DataFrame:
    """The unscaled transform of series (by, idx, re, im) of a b cells each, a and b among the columns `by`, in two steps of lanes of a and of b cells.  Last cells that are left out count as 0."""
    a, b, i, j = F.col("a"), F.col("b"), F.col("i"), F.col("j")
    first = _lanes(cells.select(*by, F.expr("idx div b").alias("i"), (F.col("idx") % b).alias("j"), "re", "im"), [*by, "j"], "i", inverse, "a")
    turn = (2 if inverse else -2) * np.pi * (i * j % (a * b)) / (a * b)
    turned = first.withColumns({"c": F.cos(turn), "s": F.sin(turn)}).select(*by, "i", "j", F.expr("re * c - im * s").alias("re"), F.expr("re * s + im * c").alias("im"))
    return _lanes(turned, [*by, "i"], "j", inverse, "b").select(*by, (i + a * j).alias("idx"), "re", "im")


def fft(series: DataFrame, inverse: bool = False, lane: int = LANE) -> DataFrame:
    """The transform of each series (key, idx, re, im), numbered from 0 without gaps; the inverse is scaled by 1 / n.

    A series of n = a b cells, more than `lane`, is laid out as a by b: lanes of a cells are transformed, turned by their twiddles, and
    transformed again across, b cells each, so no task holds more than a lane.  b is the divisor of n next below its root.  Where that
    leaves lanes of more than `lane` cells, as for prime lengths, the transform is a convolution with a chirp, of a power of two.
    """
    lengths = series.groupBy("key").agg(F.count("*").alias("n"))
    # one row for each length that is too long for a lane; lengths that differ are few, as together they are no more than the cells
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n"))), lambda d: F.col("n") % d == 0)
    # above a power of two of lane^2 cells lanes grow, as its root does
    cut = lengths.where(F.col("n") > lane).select("n").distinct().withColumn("b", F.array_max(divisors)).withColumn("a", F.expr("n div b"))
    cut = fixed(cut.withColumn("odd", (F.col("a") > lane) & (F.bit_count("n") != 1)))
    known = lengths.withColumnRenamed("key", "key_")
    cells = series.select("key", "idx", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")).join(known, series["key"].eqNullSafe(known.key_)).drop("key_")
    if cut.isEmpty():
        out = _lanes(cells, ["key", "n"], "idx", inverse)
    else:
        cells = fixed(cells)
        out = _lanes(cells.where(F.col("n") <= lane), ["key", "n"], "idx", inverse)
        laid = cells.join(F.broadcast(cut.where("not odd").drop("odd")), "n")
        out = out.unionByName(_laid_out(laid, ["key", "n", "a", "b"], inverse).select("key", "n", "idx", "re", "im"))
        odd = cut.where("odd").select("n")
        if not odd.isEmpty():
            out = out.unionByName(chirp(cells.join(F.broadcast(odd), "n"), odd, inverse, _of_powers).select("key", "n", "idx", "re", "im"))
    scale = F.col("n") if inverse else F.lit(1.0)
    return out.select("key", "idx", (F.col("re") / scale).alias("re"), (F.col("im") / scale).alias("im"))


def _of_powers(cells: DataFrame, by: list[str], inverse: bool = False) -> DataFrame:
    """The unscaled transform of series (by, idx, re, im) whose length, the column size of `by`, is a power of two."""
    half = F.call_function("shiftright", F.bit_count(F.col("size") - 1).cast("int"), F.lit(1))
    laid = cells.withColumn("b", F.call_function("shiftleft", F.lit(1).cast("long"), half)).withColumn("a", F.expr("size div b"))
    return _laid_out(laid, [*by, "a", "b"], inverse).select(*by, "idx", "re", "im")


def fftn(cells: DataFrame, axes: list[str], inverse: bool = False, by: list[str] | None = None) -> DataFrame:
    """The transform of an array (axes, re, im), or of one for each value of `by`, along two or more axes; a lane along an axis is the most that a task holds.

    Arrays of `by` may differ in size; the inverse is scaled by the cells of each.
    """
    by = by or []
    out = cells.select(*by, *axes, "re", "im")
    for axis in axes:
        out = _lanes(out, [*by, *(x for x in axes if x != axis)], axis, inverse).select(*by, *axes, "re", "im")
    if inverse:
        size = F.lit(1).cast("long")
        for x in axes:
            size = size * (F.max(x) + 1)
        sizes = cells.groupBy(*by).agg(size.alias("__cells"))
        own = sizes.withColumnsRenamed({c: f"__{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = out.join(own if by else F.broadcast(own), same).select(*by, *axes, *((F.col(c) / F.col("__cells")).alias(c) for c in ("re", "im")))
    return out


def dft(a: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The transform of vectors of n cells by its definition, all in Catalyst: each lane is gathered once, and its n sums are taken within the row."""
    by = by or []
    lane = a.groupBy(*by).agg(F.collect_list(F.struct(F.col("idx").alias("idx"), v().alias("v"))).alias("lane"))

    def part(f, k: Column) -> Column:  # noqa: ANN001
        return F.aggregate("lane", F.lit(0.0), lambda s, x: s + x["v"] * f(-2 * np.pi / n * F.pmod(k * x["idx"], F.lit(n))))

    waves = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.struct(k.alias("k"), part(F.cos, k).alias("re"), part(F.sin, k).alias("im")))
    return lane.select(*by, F.inline(waves))
