"""Convolution of two vectors that are tables, and transforms of lengths without a useful divisor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from .order import fixed

#: Cells of a kernel that is sent to all tasks at most.
SHORT = 1 << 20
#: Cells of the blocks that it meets at the least, and, unless it is longer itself, at the most.
BLOCK, WIDE = 1 << 14, 1 << 20
#: Cells of a kernel up to which products are summed directly.
DIRECT = 256


def convolve_tables(a: DataFrame, b: DataFrame, n: int | None = None, m: int | None = None, mode: str = "full") -> DataFrame:
    """(idx, v) of the convolution of two vectors (idx, v) of n and m cells; without a length a vector reaches to its last cell.

    Cells left out and nulls count as 0.  mode: full, same (as long as the longer one) or valid.

    If the shorter vector has SHORT cells at most, it goes to all tasks, the longer one is cut into blocks of at least its length, one in a task
    at a time, and the blocks' overlapping results are summed by place.  If both are longer, the product of their transforms, of a common length, is transformed back.
    """
    n, m = (size if size is not None else (None if (last := x.agg(F.max("idx")).first()[0]) is None else last + 1) for x, size in ((a, n), (b, m)))
    if not n or not m:
        raise DimensionMismatch("empty operand")
    (long, _), (short, small) = ((a, n), (b, m)) if n >= m else ((b, m), (a, n))
    out = _overlapped(long, short, small) if small <= SHORT else _by_transforms(a, b, n + m - 1)
    most, least = max(n, m), min(n, m)
    first, kept = {"full": (0, n + m - 1), "same": ((n + m - 1 - most) // 2, most), "valid": (least - 1, most - least + 1)}[mode]
    whole = a.sparkSession.range(first, first + kept).withColumnRenamed("id", "idx").join(out, "idx", "left")
    return whole.select((F.col("idx") - first).alias("idx"), F.coalesce("v", F.lit(0.0)).alias("v"))


def correlate_tables(a: DataFrame, b: DataFrame, n: int | None = None, m: int | None = None, mode: str = "full") -> DataFrame:
    """The convolution with b turned round."""
    if m is None:
        last = b.agg(F.max("idx")).first()[0]
        m = None if last is None else last + 1
    if not m:
        raise DimensionMismatch("empty operand")
    return convolve_tables(a, b.select((m - 1 - F.col("idx")).alias("idx"), "v"), n, m, mode)


def _overlapped(a: DataFrame, b: DataFrame, m: int) -> DataFrame:
    kernel = np.zeros(m)
    some = b.where(F.col("v").isNotNull()).select("idx", F.col("v").cast("double").alias("v")).toPandas()  # m cells at most
    np.add.at(kernel, some["idx"].to_numpy(np.int64), some["v"].to_numpy(float))
    # blocks of a few kernels' length, so that few places have two results to sum
    size = max(BLOCK, min(4 * m, WIDE), m)
    cells = a.where(F.col("v").isNotNull()).select(F.floor(F.col("idx") / size).alias("block"), (F.col("idx") % size).cast("int").alias("at"), F.col("v").cast("double").alias("v"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 1 << (size + m - 2).bit_length()
        turned = np.fft.rfft(kernel, wide) if m > DIRECT else None
        own, x = None, np.zeros(size)

        def result() -> Iterator[pa.RecordBatch]:
            y = np.convolve(x, kernel) if turned is None else np.fft.irfft(np.fft.rfft(x, wide) * turned, wide)[: size + m - 1]
            for k in range(0, len(y), BLOCK):
                part = y[k : k + BLOCK]
                yield pa.RecordBatch.from_pydict({"idx": pa.array(own * size + k + np.arange(len(part))), "v": pa.array(part)})

        for t in batches:
            blocks, at, v = (t.column(c).to_numpy() for c in ("block", "at", "v"))
            starts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
            for k, end in zip(starts, [*starts[1:], len(blocks)], strict=True):
                if blocks[k] != own:
                    if own is not None:
                        yield from result()
                    own, x = int(blocks[k]), np.zeros(size)
                x[at[k:end]] = v[k:end]
        if own is not None:
            yield from result()

    dealt = cells.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(products, "idx long, v double").groupBy("idx").agg(F.sum("v").alias("v"))


def _by_transforms(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    from .linalg import fft

    size = 1 << (n - 1).bit_length()
    whole = a.sparkSession.range(size).withColumnRenamed("id", "idx")

    def padded(x: DataFrame, key: int) -> DataFrame:
        return whole.join(x.select("idx", F.col("v").cast("double").alias("v")), "idx", "left").select(F.lit(key).alias("key"), "idx", F.coalesce("v", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))

    turned = fft(padded(a, 0).unionByName(padded(b, 1)))
    x, y = (turned.where(F.col("key") == k).select("idx", F.col("re").alias(f"re{k}"), F.col("im").alias(f"im{k}")) for k in (0, 1))
    product = x.join(y, "idx").select(F.lit(0).alias("key"), "idx", (F.col("re0") * F.col("re1") - F.col("im0") * F.col("im1")).alias("re"), (F.col("re0") * F.col("im1") + F.col("im0") * F.col("re1")).alias("im"))
    return fft(product, inverse=True).select("idx", F.col("re").alias("v"))


def _wave(k: Column, n: Column, sign: int) -> tuple[Column, Column]:
    """cos and sin of sign pi k^2 / n."""
    turn = sign * np.pi * (k * k % (2 * n)) / n
    return F.cos(turn), F.sin(turn)


def _times(re: Column, im: Column, c: Column, s: Column) -> tuple[Column, Column]:
    return re * c - im * s, re * s + im * c


def chirp(series: DataFrame, lengths: DataFrame, inverse: bool, transform: Callable[..., DataFrame]) -> DataFrame:
    """The unscaled transform of series (key, n, idx, re, im) of the lengths (n), by transforms of powers of two.

    exp(-2 pi i j k / n) is the product of a chirp at j, one at k, and one at k - j turned back: a convolution with the chirp, which depends
    on n alone.  transform: that of series (by, idx, re, im) of `size` cells, the last of which may be left out.
    """
    sign = 1 if inverse else -1
    n, k = F.col("n"), F.col("idx")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2((2 * n - 1).cast("double"))).cast("int"))
    own = ["key", "n", "size"]

    def turned(df: DataFrame, c: Column, s: Column) -> DataFrame:
        re, im = _times(F.col("re"), F.col("im"), F.col("c"), F.col("s"))
        return df.withColumns({"c": c, "s": s}).select(*own, "idx", re.alias("re"), im.alias("im"))

    first = turned(series.withColumn("size", size), *_wave(k, n, sign))
    places = lengths.select("n", size.alias("size")).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    near = F.least(F.col("idx"), F.col("size") - F.col("idx"))
    c, s = _wave(near, n, -sign)
    right = places.select("n", "size", "idx", F.when(near < n, c).otherwise(0.0).alias("re"), F.when(near < n, s).otherwise(0.0).alias("im"))
    y = fixed(transform(right, ["n", "size"]).select("n", "idx", F.col("re").alias("cy"), F.col("im").alias("sy")))
    product = turned(transform(first, own).join(y, ["n", "idx"]), F.col("cy"), F.col("sy"))
    back = transform(product, own, True).where("idx < n")
    return turned(back, *_wave(k, n, sign)).withColumns({x: F.col(x) / F.col("size") for x in ("re", "im")}).drop("size")
