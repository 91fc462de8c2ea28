"""What the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a basis is fitted on at most.
SAMPLE = 4096


def taking_part(embedding: Column) -> Column:
    """Whether a vector is not null, not zero, and has only finite components; null or false if not."""
    e = embedding.cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(e, lambda x: x != 0)


def valid(vectors: DataFrame) -> DataFrame:
    """vectors with the column e (array<double>), of those that take part."""
    return vectors.where(taking_part(F.col("embedding"))).withColumn("e", F.col("embedding").cast("array<double>"))


def matrices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists, none of them null, the places of the lists and a matrix of their values."""
    at = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(), np.diff(at)
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        yield own, flat[at[own][:, None] + np.arange(n)]


def listed(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def principal(vectors: DataFrame) -> np.ndarray:
    """Principal directions (columns, leading first) of a bounded sample of the rows' unit vectors e, for their commonest length."""
    rows = [np.array(r[0]) for r in vectors.select("e").orderBy(F.xxhash64("e")).limit(SAMPLE).collect()]
    if not rows:
        return np.zeros((0, 0))
    sizes, counts = np.unique([len(r) for r in rows], return_counts=True)
    x = unit(np.stack([r for r in rows if len(r) == sizes[counts.argmax()]]))
    values, basis = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return basis[:, np.argsort(-values, kind="stable")]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
