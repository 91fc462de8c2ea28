"""Positions: consecutive numbers in a given order, without bringing all rows to one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where Spark runs on one machine may that be unset, and a temporary folder take its place."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, as a table that release() removes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fixed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that fixed() wrote and that nothing lazy reads any more; others are left alone."""
    for table in (t for t in tables if isinstance(t, DataFrame)):
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("fixed-"):
                folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def ordinal(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the column `name`: 0, 1, ... in the given order.

    Rows are range-partitioned and numbered within partitions; one count per partition gives the offsets.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = fixed(placed.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__at", "__part", "__before")


def in_lanes(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the column `name`: 0, 1, ... in the given order within each lane, a value of the columns `by`; null is a lane like others.

    Lanes and order are range-partitioned together, so a long lane lies in many partitions.  Cells are numbered where they are; what a partition's
    first lane has in the partitions before it comes from a table of one row for each partition.
    """
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__part", F.spark_partition_id())
    fields = T.StructType([*placed.schema.fields, T.StructField("__at", T.LongType()), T.StructField("__lane", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, at, last = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.select(by) if by else None
            new = np.zeros(b.num_rows, bool)
            for c in by:
                x = own.column(c)
                both, one = pc.not_equal(x[1:], x[:-1]), pc.not_equal(pc.is_null(x[1:]), pc.is_null(x[:-1]))
                new[1:] |= pc.or_(pc.fill_null(both, False), one).to_numpy(zero_copy_only=False)
            head = own.slice(0, 1).to_pylist()[0] if by else {}
            new[0] = last is not None and head != last
            last = own.slice(b.num_rows - 1).to_pylist()[0] if by else {}
            places = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, places, -1))
            ats = np.where(start >= 0, places - start, places + at)
            lanes = lane + np.cumsum(new)
            lane, at = int(lanes[-1]), int(ats[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ats), pa.array(lanes)], [*b.schema.names, "__at", "__lane"])

    held = fixed(placed.mapInArrow(numbered, fields))
    # one row for each partition: its first and last lane and how many cells each has there
    sizes = held.groupBy("__part").agg(
        F.max("__lane").alias("lanes"), F.count_if(F.col("__lane") == 0).alias("n"), F.min_by(F.struct(*by, F.lit(0).alias("__0")), "__lane").alias("first"), F.max_by(F.struct(*by, F.lit(0).alias("__0")), "__lane").alias("last"),
        F.max_by("__at", F.struct("__lane", "__at")).alias("end"),
    )
    before, carried, last = [], 0, None
    for r in sizes.orderBy("__part").collect():
        offset = carried if last is not None and r.first == last else 0
        before.append((r["__part"], offset))
        carried, last = (offset + r.n if r.lanes == 0 else r.end + 1), r.last
    known = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    out = held.join(known, "__part").withColumn(name, F.col("__at") + F.when(F.col("__lane") == 0, F.col("__before")).otherwise(0))
    return out.drop("__part", "__at", "__lane", "__before")


#: Places along an axis that meet in one task.
BLOCK = 1 << 12


def haloed(a: DataFrame, axis: str, by: list[str], before: int, after: int) -> tuple[DataFrame, WindowSpec]:
    """Cells by blocks of places along an axis without gaps, and the window of a block.

    The cells next to a block, `before` at its start and `after` at its end, are sent to it too, with __own false.  So a lane is
    spread over as many tasks as it has blocks, and neighbours still meet.
    """
    at = F.col(axis).cast("long")
    block = lambda x: F.floor(x / BLOCK)
    sent = a.withColumn("__block", F.explode(F.sequence(block(at - after), block(at + before)))).withColumn("__own", F.col("__block") == block(at))
    return sent, Window.partitionBy(*by, "__block").orderBy(axis)
