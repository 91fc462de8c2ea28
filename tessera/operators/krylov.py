"""Leading eigenvalues and vectors of large sparse matrices (i, j, v), symmetric or not: Arnoldi's iteration with restarts.

The basis is a table (i, q), q the row of the basis at i.  A step multiplies the matrix with the last vector by a join and a sum, and takes from the
product what lies in the basis, twice; inner products are partial sums of the tasks.  Only the projected matrix, `steps` by `steps`, is on the
driver.  A restart keeps the invariant part that belongs to the leading values: the basis times a small matrix, row by row.  For a
symmetric matrix this is Lanczos' iteration with full orthogonalisation and thick restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, NoConvergence
from .blocks import _lists, _matrix, times
from .order import fixed, release


def _sums(rows: DataFrame, k: int, h: np.ndarray) -> tuple[np.ndarray, float]:
    """For rows (q, w): the inner products of the k vectors of q with w less their combination h, and the square of its size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), 0.0
        for b in batches:
            if b.num_rows:
                q, w = _matrix(b.column("q"), k), b.column("w").to_numpy()
                w = w - q @ h
                total, square = total + q.T @ w, square + float(w @ w)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k + 1), pa.int32()), "s": pa.array([*total, square])})

    out = np.zeros(k + 1)
    for r in rows.select("q", "w").mapInArrow(partial, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r.s
    return out[:k], float(out[k])


def _extended(rows: DataFrame, k: int, h: np.ndarray, size: float) -> DataFrame:
    """(i, q) with one vector more: w less its combination h of the k vectors, over its size."""

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, w = _matrix(b.column("q"), k), b.column("w").to_numpy()
            yield pa.RecordBatch.from_pydict({"i": b.column("i"), "q": _lists(np.column_stack([q, (w - q @ h) / size]))})

    return rows.select("i", "q", "w").mapInArrow(appended, "i long, q array<double>")


def _times_vector(a: DataFrame, basis: DataFrame, k: int) -> DataFrame:
    """(i, q, w): the basis, and the matrix times its vector k."""
    x = basis.select(F.col("i").alias("j"), F.col("q")[k].alias("x"))
    product = a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("w"))
    return basis.join(product, "i", "left").select("i", "q", F.coalesce("w", F.lit(0.0)).alias("w"))


def _leading(h: np.ndarray, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a small matrix, by falling magnitude, and vectors; of a conjugate pair that with the positive imaginary part comes first."""
    w, y = np.linalg.eigh((h + h.T) / 2) if symmetric else np.linalg.eig(h)
    order = np.lexsort((-w.imag, -w.real, -np.round(np.abs(w), 12)))
    return w[order], y[:, order]


def _start(a: DataFrame, n: int, seed: int) -> DataFrame:
    x = a.sparkSession.range(n).select(F.col("id").alias("i"), ((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) + 0.5) / float(1 << 39) - 1).alias("x"))
    size = float(np.sqrt(x.agg(F.sum(F.col("x") * F.col("x"))).first()[0]))
    return x.select("i", F.array(F.col("x") / size).alias("q"))


def eigs(a: DataFrame, n: int, count: int = 6, symmetric: bool = False, steps: int | None = None, tolerance: float = 1e-9, restarts: int = 60, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The `count` eigenvalues of greatest magnitude of an n by n matrix (i, j, v), and the unit vectors as rows (i, re, im), arrays of `count` numbers.

    Cells left out are 0, cells of one place are summed.  Of a conjugate pair both are given if there is room.  symmetric: the caller's word that the matrix is; then
    values are real and im is 0.  A value counts as found when the residual of its vector is at most `tolerance` times the greatest magnitude;
    NoConvergence where `restarts` do not bring that about.  A matrix of no cells has the values 0.
    """
    if not 0 < count <= n:
        raise DimensionMismatch(f"{count} of {n} values")
    a = fixed(a.select("i", "j", F.col("v").cast("double").alias("v")).where("v <> 0"))  # read in each step
    steps = min(n, steps or max(2 * count + 8, 20))
    basis, k, h = fixed(_start(a, n, seed)), 1, np.zeros((steps + 1, steps))
    for _ in range(restarts + 1):
        closed = False
        while k <= steps:
            rows = fixed(_times_vector(a, basis, k - 1))
            first, _ = _sums(rows, k, np.zeros(k))
            second, square = _sums(rows, k, first)
            own = first + second
            size = float(np.sqrt(max(0.0, square - float(second @ second))))
            h[:k, k - 1] = own
            scale = max(float(np.abs(h[:k, :k]).max()), 1e-300)
            if k == n:
                closed = True
                release(rows)
                break
            if size <= 1e-12 * scale:  # the basis is invariant: go on from another start, which the matrix does not couple to it
                release(rows)
                rows = fixed(basis.join(_start(a, n, seed + k).select("i", F.col("q")[0].alias("w")), "i"))
                first, _ = _sums(rows, k, np.zeros(k))
                second, square = _sums(rows, k, first)
                own, size = first + second, float(np.sqrt(max(1e-300, square - float(second @ second))))
                h[k, k - 1] = 0.0
            else:
                h[k, k - 1] = size
            old, basis = basis, fixed(_extended(rows, k, own, size))
            release(old, rows)
            k += 1
            if h[k - 1, k - 2] and k - 1 >= max(count + 6, steps // 2):  # a small matrix tells whether the steps left are needed
                w, y = _leading(h[: k - 1, : k - 1], symmetric)
                if (np.abs(h[k - 1, k - 2] * y[k - 2, :count]) <= tolerance * np.abs(w).max()).all():
                    break
        dim = k if closed else k - 1
        w, y = _leading(h[:dim, :dim], symmetric)
        got = min(count, dim)
        off = 0.0 if closed else float(h[dim, dim - 1])
        top = max(float(np.abs(w).max()), 1e-300)
        if closed or (np.abs(off * y[dim - 1, :got]) <= tolerance * top).all():
            break
        keep = min(dim - 1, count + (dim - count) // 2)
        if not symmetric and keep < dim and abs(w[keep - 1].imag) > 0 and np.isclose(w[keep - 1].conj(), w[keep]):
            keep = keep + 1 if keep + 1 < dim else keep - 1
        part = y[:, :keep] if symmetric else np.column_stack([y[:, :keep].real, y[:, :keep].imag])
        u, s, _ = np.linalg.svd(part, full_matrices=False)
        u = u[:, : keep if symmetric else int((s > 1e-10 * s[0]).sum())]
        p = u.shape[1]
        turn = np.zeros((dim + 1, p + 1))
        turn[:dim, :p], turn[dim, p] = u, 1.0
        small = np.zeros_like(h)
        small[:p, :p], small[p, :p] = u.T @ h[:dim, :dim] @ u, off * u[dim - 1]
        old, basis = basis, fixed(times(basis, "q", turn, "q"))
        release(old)
        h, k = small, p + 1
    else:
        raise NoConvergence(f"{count} values after {restarts} restarts")
    values = np.concatenate([w[:got], np.zeros(count - got)])
    vectors = np.zeros((k, 2 * count))
    release(a)
    vectors[:dim, :got], vectors[:dim, count : count + got] = y[:, :got].real, y[:, :got].imag
    both = times(basis, "q", vectors, "z")
    return values, both.select("i", F.slice("z", 1, count).alias("re"), F.slice("z", count + 1, count).alias("im"))


def residuals(a: DataFrame, values: np.ndarray, vectors: DataFrame) -> np.ndarray:
    """The size of A x - value x for each vector x."""
    x = vectors.select("i", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("i", "k", "z.re", "z.im")
    product = a.join(x.withColumnRenamed("i", "j"), "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
    c, s = (F.element_at(F.array(*(F.lit(float(z)) for z in part)), F.col("k") + 1) for part in (np.real(values), np.imag(values)))
    scaled = x.select("i", "k", (-(F.col("re") * c - F.col("im") * s)).alias("re"), (-(F.col("re") * s + F.col("im") * c)).alias("im"))
    apart = product.unionByName(scaled).groupBy("i", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    out = np.zeros(len(values))
    for r in apart.groupBy("k").agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("r")).collect():
        out[r.k] = r.r
    return out
