"""Whitening of embeddings: streaming moments, merged across partitions, and a symmetric QR eigen-solve.

Entries become whole numbers x = floor(64 c) + 1000000.  The moments are those of the different x-vectors, each once: a task takes its
rows in turn by Welford's rank-one updates, and the tasks' moments are merged by the parallel update formula, FAN at a time, so that
one d by d matrix reaches the driver.  There Householder reflections make it tridiagonal, and implicit QR steps with Wilkinson's shift
diagonal.  What is left for the rows is one product each.

Vectors that are null or hold null or non-finite entries take no part, nor do vectors whose length is not that of most (of several
such lengths the greatest); without any there are no rows.  Zero vectors and repeated rows take part, and each row has its results.
Entries past 2^56 count as 2^56.  A component whose eigenvalue is 0 to within rounding has no whitened value (null) and no part in
identity_error, which is null if no component is left; so is `explained` where the trace is 0, and `deviation` where it exceeds a long.
Columns of the input named like a result have `_in` appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, set_aside
from .vectors import listed

#: Moments merged in one task.
FAN = 32
#: Sums up to here are kept as whole numbers.
EXACT = 2.0**61

_PARTS = "n long, sums array<long>, mean array<double>, scatter array<double>"


class Moments(NamedTuple):
    """n vectors, their exact sums (None where they exceed a long), their means, and their centred products summed."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scatter: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean."""
        return x - self.mean if self.sums is None or x.dtype.kind != "i" else _less(x, self.sums, self.n)

    @property
    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


def _less(x: np.ndarray, sums: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """x - sums / n of whole numbers, rounded once."""
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


class Whitening(NamedTuple):
    """The leading components: eigenvalues, vectors as columns, and which eigenvalues are above 0."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    kept: np.ndarray
    identity_error: float | None

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.moments.covariance))
        return [max(float(e), 0.0) / trace if trace > 0 else None for e in self.values]


def updated(at: Moments, x: np.ndarray) -> Moments:
    """Welford's update by each row of x in turn.

    Row k adds the rank-one matrix of its deviations from the mean before it and the mean after it.  All these means come from
    running sums, so the updates of a batch are one product of two matrices of deviations.
    """
    whole = at.sums is not None and x.dtype.kind == "i" and np.abs(at.sums.astype(float)).max(initial=0) + np.abs(x.astype(float)).sum(axis=0).max(initial=0) < EXACT
    start = at.sums if whole else at.mean * at.n
    x = x if whole else x.astype(float)
    counts = at.n + np.arange(1, len(x) + 1)[:, None]
    sums = start + np.cumsum(x, axis=0)
    less = _less if whole else lambda y, s, k: y - s / k
    old, new = less(x, sums - x, np.maximum(counts - 1, 1)), less(x, sums, counts)
    n = at.n + len(x)
    return Moments(n, sums[-1] if whole else None, sums[-1] / n, at.scatter + old.T @ new)


def merged(a: Moments, b: Moments) -> Moments:
    """The parallel update formula."""
    n = a.n + b.n
    apart = b.mean - a.mean if a.sums is None or b.sums is None else (b.sums // b.n - a.sums // a.n) + ((b.sums % b.n) / b.n - (a.sums % a.n) / a.n)
    whole = a.sums is not None and b.sums is not None and (np.abs(a.sums.astype(float)) + np.abs(b.sums.astype(float))).max(initial=0) < EXACT
    sums = a.sums + b.sums if whole else None
    mean = sums / n if whole else a.mean + apart * (b.n / n)
    return Moments(n, sums, mean, a.scatter + b.scatter + np.outer(apart, apart) * (a.n * (b.n / n)))


def _row(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"n": m.n, "sums": None if m.sums is None else m.sums.tolist(), "mean": m.mean.tolist(), "scatter": m.scatter.ravel().tolist()}],
        schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))]))


def _read(row) -> Moments:  # noqa: ANN001
    d = len(row["mean"])
    return Moments(row["n"], None if row["sums"] is None else np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d))


def moments(rows: DataFrame, array: str, d: int) -> Moments | None:
    """The moments of a column of arrays of d numbers, none of them null; None without rows."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(0, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))
        for b in batches:
            if b.num_rows:
                m = updated(m, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        if m.n:
            yield _row(m)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            for row in b.to_pylist():
                m = _read(row) if m is None else merged(m, _read(row))
        if m is not None:
            yield _row(m)

    parts = rows.select(array).mapInArrow(own, _PARTS)
    count = rows.rdd.getNumPartitions()
    while count > FAN:
        count = -(-count // FAN)
        parts = parts.repartition(count).mapInArrow(further, _PARTS)
    last = parts.repartition(1).mapInArrow(further, _PARTS).first()
    return None if last is None else _read(last)


def _tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal, and the rows of Q with Q v Q' tridiagonal, by Householder reflections."""
    a, d = v.astype(float).copy(), len(v)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        u = x.copy()
        u[0] += size if x[0] >= 0 else -size
        u /= np.linalg.norm(u)
        for m in (a[k + 1 :], q[k + 1 :]):
            m -= 2 * np.outer(u, u @ m)
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each above 0; an entry of v that is not finite raises.

    The trailing block whose off-diagonal entries stand is taken through QR steps: the shift is the eigenvalue of its last 2 by 2
    corner that is nearer to the last entry, and rotations chase the bulge down.
    """
    if not np.isfinite(v).all():
        raise ValueError("entries must be finite")
    a, b, q = _tridiagonal(v)
    eps = np.finfo(float).eps
    hi, steps = len(a) - 1, 0
    while hi > 0:
        small = np.abs(b[:hi]) <= eps * (np.abs(a[:hi]) + np.abs(a[1 : hi + 1]))
        b[:hi][small] = 0
        if b[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        steps += 1
        if steps > 200:
            raise ArithmeticError("no convergence")
        zero = np.flatnonzero(b[:hi] == 0)
        lo = int(zero[-1]) + 1 if len(zero) else 0
        half = (a[hi - 1] - a[hi]) / 2
        shift = a[hi] - b[hi - 1] ** 2 / (half + (np.hypot(half, b[hi - 1]) if half >= 0 else -np.hypot(half, b[hi - 1])))
        x, z = a[lo] - shift, b[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                b[k - 1] = r
            p, o, t = a[k], b[k], a[k + 1]
            a[k], a[k + 1] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t
            b[k] = (c * c - s * s) * o + c * s * (t - p)
            if k < hi - 1:
                x, z = b[k], s * b[k + 1]
                b[k + 1] *= c
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-a, kind="stable")
    vectors = q[order].T
    top = np.abs(vectors).argmax(axis=0)
    return a[order], vectors * np.where(vectors[top, np.arange(len(a))] < 0, -1.0, 1.0)


def whole_numbers(embedding: str) -> Column:
    """x of a vector."""
    e = F.col(embedding).cast("array<double>")
    return F.transform(e, lambda c: F.floor(F.greatest(F.least(c * 64, F.lit(2.0**62)), F.lit(-(2.0**62)))) + 1000000)


def _taking_part(embedding: str) -> Column:
    e = F.col(embedding).cast("array<double>")
    return F.col(embedding).isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(embedding) > 0)


def fit(vectors: DataFrame, embedding: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of the different x-vectors; None without vectors that take part."""
    part = vectors.where(_taking_part(embedding))
    common = part.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    d = common.d
    distinct = materialise(part.where(F.size(embedding) == d).select(whole_numbers(embedding).alias("x")).distinct(), "whitening")
    m = moments(distinct, "x", d)
    values, axes = symmetric_eigen(m.covariance)
    values, axes = values[:components], axes[:, :components]
    kept, error = values > d * np.finfo(float).eps * max(values[0], 0.0), None
    if kept.any():
        scaled = axes[:, kept] / np.sqrt(values[kept])

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_pydict({"w": listed(m.centred(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) @ scaled)})

        white = moments(distinct.mapInArrow(projected, "w array<double>"), "w", int(kept.sum()))
        error = float(np.abs(white.covariance - np.eye(int(kept.sum()))).max())
    discard(distinct)
    return Whitening(m, values, axes, kept, error)


def _deviations(x: np.ndarray, m: Moments) -> pa.Array:
    """The sum of (n x - S)^2 of each row, exactly; null past a long."""
    if m.sums is None:
        return pa.nulls(len(x), pa.int64())
    base = m.sums // m.n
    rest = m.sums - m.n * base
    rough = (((x - base).astype(float) * m.n - rest) ** 2).sum(axis=1)
    out = np.zeros(len(x), np.int64)
    safe = rough < 2.0**62
    out[safe] = ((m.n * (x[safe] - base) - rest) ** 2).sum(axis=1)
    listed_ = out.tolist()
    for k in np.flatnonzero(~safe):
        exact = sum((m.n * (int(c) - int(q)) - int(r)) ** 2 for c, q, r in zip(x[k], base, rest, strict=True))
        listed_[k] = exact if exact < 2**63 else None
    return pa.array(listed_, pa.int64())


def whiten(vectors: DataFrame, fitted: Whitening | None, embedding: str = "embedding") -> DataFrame:
    """The rows that take part, with `deviation` and the array `whitened`, one entry for each component."""
    kept = set_aside(vectors, "deviation", "whitened", "__x")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    schema = f"{fields}, deviation long, whitened array<double>"
    if fitted is None:
        return kept.where("false").selectExpr(*(f"`{c}`" for c in kept.columns), "cast(null as long) deviation", "cast(null as array<double>) whitened")
    m, d = fitted.moments, len(fitted.moments.mean)
    scale = fitted.vectors / np.sqrt(np.where(fitted.kept, fitted.values, np.inf))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                w = m.centred(x) @ scale
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel(), mask=np.tile(~fitted.kept, len(w))))
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != "__x"} | {"deviation": _deviations(x, m), "whitened": lists})

    rows = kept.where(_taking_part(embedding) & (F.size(embedding) == d)).withColumn("__x", whole_numbers(embedding))
    return rows.mapInArrow(applied, schema)
