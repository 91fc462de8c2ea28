"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


#: Set while a table is written: Spark removes the shuffle files of a query when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Set besides where materialise() is told so: bytes of a batch that goes to a worker; Spark's own is 64 MB.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage, fixes what depends on the order of rows, and survives lost executors.  The shuffle files that led to
    the table go as soon as it is written.  batch: about how many bytes of rows go to a worker at a time, if not as many as the session says.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = {_CLEANUP: spark.conf.get(_CLEANUP, "false")} | ({_BATCH: spark.conf.get(_BATCH, "64m")} if batch else {})
    for k in before:
        spark.conf.set(k, "true" if k == _CLEANUP else str(batch))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the folder of a table that materialise() wrote and that nothing lazy reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: What a worker keeps from task to task, until forget().
KEPT: dict = {}


def forget() -> None:
    """Drop what an earlier stage has kept in this worker; costs nothing where there is nothing."""
    if KEPT:
        KEPT.clear()
        trim()


def trim() -> None:
    """Give memory that a worker has freed back to the machine: workers are kept, and what one stage left would count against the next."""
    gc.collect()
    release()


def release() -> None:
    """As trim(), but for what only a collection of garbage finds: Spark's workers do that after each task anyway."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Keys that joined_hot() broadcasts at most.
HOT = 1 << 14
#: Characters of such a key.
LONG = 512


def joined_hot(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined on their key with a table of one row for each key, of which `weight` says how many of rows hold it.

    Keys that more than one in HOT of the rows hold are at most HOT, so they are broadcast, unless they have over LONG characters; the
    others meet by a shuffle.  The column weight goes.  Both inputs are read more than once: they should be written tables, or cheap.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = (F.col(weight) * HOT > total) & (F.length(F.concat(*on)) <= LONG)
    hot, rest = table.where(heavy).drop(weight), table.where(~heavy).drop(weight)
    here = rows.join(F.broadcast(hot), on)
    there = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)
    return here.unionByName(there)


def text_key() -> Column:
    """A hash of the text that, beside doc_id, tells apart rows which share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df in which columns of these names, in upper or lower case, have `_in` appended, as often as it takes to be free."""
    for c in df.columns:
        if c.lower() in names:
            new = f"{c}_in"
            while new.lower() in {x.lower() for x in df.columns}:
                new += "_in"
            df = df.withColumnRenamed(c, new)
    return df


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(df: DataFrame, order: list[str], weight: str | None = None, label: str = "ranked") -> DataFrame:
    """df with the column __start: the sum of weight (or the number of rows) that precede a row in the given order.

    Range partitioning deals the rows out, each partition is summed on its own, and only one sum per
    partition is brought together.  `order` must end in columns that make rows distinct, else equal
    rows share a partition.
    """
    parts = partitions(df)
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__at", T.LongType()), T.StructField("__w", T.LongType())])
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = sorted_.withColumns({"__part": F.spark_partition_id().cast("long"), "__w": (F.col(weight) if weight else F.lit(1)).cast("long")})

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        forget()
        for b in batches:
            w = b.column("__w").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(w)
            cols = {n: b.column(n) for n in b.schema.names}
            cols["__at"] = pa.array(ends - w)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in schema})

    kept = materialise(sorted_.mapInArrow(running, schema), label)
    from pyspark.sql import Window

    sums = kept.groupBy("__part").agg(F.sum("__w").alias("__sum"))
    before = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
    # one row per partition: a broadcast of a few kB
    return kept.join(F.broadcast(before), "__part").withColumn("__start", F.col("__before") + F.col("__at")).drop("__part", "__at", "__w", "__before")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected edges (u long, v long): one row (node, root) for each node of an edge; root is the smallest node.

    Alternates large-star and small-star rounds.  Each is a minimum per node, which combines before
    the shuffle, joined back; a node with very many links is dealt out by skew-join handling.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = materialise(e, "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # done when each node has one edge, to a root that has none
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialise(small, "edges")
        discard(old)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n points and the links a[i]-b[i], the smallest linked point of each point."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            return low
        low = new
