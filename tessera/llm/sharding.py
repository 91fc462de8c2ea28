"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters whole records by a seeded hash into buckets that fit in memory.  Pass 2 shuffles each bucket
by Spark's `shuffle`, a seeded Fisher-Yates shuffle of an array, and deals the records out.  All is DataFrame
functions; a record crosses the network once.

Buckets are ranges of the hash, a task has several of them, and both numbers follow the bytes alone, so a task reads
about `bucket_bytes` times BUCKETS_A_TASK whatever the size of the table.  Rows that are equal in all columns have one
hash; where there are many of them they are aggregated to one row and a count before the scatter, and each copy gets a
hash of its own from its number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, set_aside

#: Slots of the hash that rows are counted by; a bucket is a range of slots.
SLOTS = 1 << 24
#: Bytes of records in a bucket, about; buckets at the least, and of one task where there are many.
BUCKET_BYTES, BUCKETS, BUCKETS_A_TASK = 16 << 20, 128, 8
#: Copies of a row that are numbered in one task.
BLOCK = 10_000


def _unordered(kind: T.DataType) -> bool:
    """Whether values of a type have neither order nor hash in Spark."""
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind)
    return _unordered(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType | T.VariantType)


def _bytes(docs: DataFrame) -> Column:
    """About how much memory a record takes."""
    out = F.lit(16).cast("long")
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType | T.MapType):
            wide = F.octet_length(F.to_json(c)) if not isinstance(f.dataType, T.ArrayType) or not isinstance(f.dataType.elementType, T.NumericType) else F.size(c) * 8
            out = out + F.coalesce(wide, F.lit(0)) + 16
        else:
            out = out + (F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) if isinstance(f.dataType, T.StructType | T.VariantType) else F.lit(8))
    return out.cast("long")


def shuffled_shards(docs: DataFrame, shards: int = 24, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs in random order over `shards` shards: all of its columns, and size, text_crc32, shard and slot.

    The order is a uniform shuffle fixed by the seed and the rows, whatever the session's partition counts.  Shard counts are at most one
    apart; slots of a shard run from 0 without gaps.  size is the UTF-8 bytes of the text plus 8.  Null texts count as empty; doc_id may be
    null or repeat, and rows may repeat.  A very long text makes its bucket larger by as much.  Columns of any type may follow; own columns
    of the four names come back with `_in` appended.  An empty table gives an empty table.
    """
    return _dealt(docs, shards, seed, bucket_bytes).drop("__task")


def _dealt(docs: DataFrame, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """The shuffled shards with the column __task: tasks hold consecutive slots of every shard, in the order of their numbers."""
    docs = set_aside(docs, "size", "text_crc32", "shard", "slot")
    columns = [f"`{c}`" for c in docs.columns]
    odd = [c for c, f in zip(columns, docs.schema, strict=True) if _unordered(f.dataType)]
    tie = F.to_json(F.struct(*odd)) if odd else F.lit("")
    text = F.coalesce("text", F.lit(""))
    # the caller's columns travel in one struct, so that no name meets those of this function
    rows = docs.select(
        F.xxhash64(F.lit(seed), *(F.col(c) for c in columns if c not in odd), tie).alias("hash"), tie.alias("tie"), _bytes(docs).alias("bytes"), F.struct(*columns).alias("row"),
        F.struct((F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc")).alias("own"),
    )
    slot = F.pmod(F.col("hash"), F.lit(SLOTS))
    slots = materialise(rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "slots")
    total = slots.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(total / bucket_bytes))
    tasks = min(buckets, max(BUCKETS, math.ceil(buckets / BUCKETS_A_TASK)))

    # rows that are the same in all columns, many in number, would fill one bucket
    full = slots.where((F.col("bytes") > total / buckets / 4) & (F.col("n") > 64)).select("slot")
    if not full.isEmpty():
        within = rows.withColumn("slot", slot).join(full, "slot")
        many = within.groupBy("hash").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("bytes") > total / buckets / 4) & (F.col("n") > 64)).select("hash", "n")
        many = materialise(many, "many")
        one = rows.join(many, "hash").groupBy("hash").agg(*(F.first(c).alias(c) for c in ("tie", "bytes", "row", "own", "n")))
        blocks = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))).repartition("hash", "block")
        copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * BLOCK, F.least("n", (F.col("block") + 1) * BLOCK) - 1)))
        rows = rows.join(many.select("hash"), "hash", "left_anti").unionByName(copies.withColumn("hash", F.xxhash64("hash", "copy")).select(*rows.columns))
        slots = materialise(rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), "slots")

    bucket = F.floor(F.col("slot") * F.lit(buckets) / F.lit(SLOTS)).cast("long")
    counts = slots.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("bucket") / 4096))
    # running sums in two steps, by runs of 4096 buckets and within them
    runs = counts.groupBy("run").agg(F.sum("n").alias("all")).select("run", (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("first"))
    at_run = Window.partitionBy("run").orderBy("bucket")
    before = counts.withColumn("inside", F.sum("n").over(at_run) - F.col("n")).join(runs, "run").select("bucket", (F.col("first") + F.col("inside")).alias("before"))
    before = materialise(before, "before")

    # what precedes a bucket goes to its task as one row more, so records are moved once
    task = F.floor(F.col("bucket") * F.lit(tasks) / F.lit(buckets)).cast("int")
    scattered = rows.withColumn("slot", slot).withColumn("bucket", bucket).select("hash", "tie", "row", "own", "bucket", F.lit(None).cast("long").alias("before"))
    marks = before.select(*(F.lit(None).cast(scattered.schema[c].dataType).alias(c) for c in ("hash", "tie", "row", "own")), "bucket", "before")
    scattered = scattered.unionByName(marks).withColumn("task", task).repartitionById(tasks, F.col("task"))
    if odd:  # ordered by what has an order; rows equal in that are equal in all
        record = F.struct(F.struct("hash", "tie").alias("key"), "row", "own")
        sort = lambda rows: F.array_sort(rows, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    else:
        record, sort = F.struct("hash", "row", "own"), F.array_sort
    own = F.collect_list(F.when(F.col("before").isNull(), record))
    gathered = scattered.groupBy("task", "bucket").agg(sort(own).alias("rows"), F.max("before").alias("before")).sortWithinPartitions("task", "bucket")
    shuffled = gathered.select("task", "before", F.shuffle("rows", F.lit(seed)).alias("rows"))
    at = shuffled.select("task", "before", F.posexplode("rows").alias("at", "record"))
    dealt = at.withColumn("place", F.col("before") + F.col("at"))
    return dealt.select(
        *(F.col(f"record.row.{c}") for c in columns), F.col("record.own.size").alias("size"), F.col("record.own.crc").alias("text_crc32"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.col("task").alias("__task"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """The shuffled shards as Parquet, a folder shard=N for each, in it a folder run=K for each task, K of nine digits.

    The files of a shard in the order of their paths, read one after another, are its slots in order, however many tasks there are.
    """
    run = F.lpad(F.col("__task").cast("string"), 9, "0")
    dealt = _dealt(docs, shards, seed, bucket_bytes).withColumn("run", run).drop("__task")
    dealt.sortWithinPartitions("shard", "run", "slot").write.partitionBy("shard", "run").parquet(path)
