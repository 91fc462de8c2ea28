"""Shuffled shards against what the law says, with copies, odd columns and two settings of the session."""

import collections
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding
from tessera.llm.sharding import shuffled_shards, write_shards


def brute(rows, got, shards):
    """Each row once, sizes and checksums by hand, counts at most one apart, slots without gaps."""
    want = collections.Counter((i, t, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.text, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


TEXTS = [None, "", "é" * 3, "a" * 300_000, "x"]


def rows_of(n):
    return [(i if i % 7 else None, TEXTS[i % 5]) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_law(spark, n):
    rows = rows_of(n)
    brute(rows, shuffled_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect(), 7)


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 50)
    rows = [(1, "the same")] * 3000 + [(None, None)] * 1500 + [(i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shuffled_shards(docs, 7)
    brute(rows, out.collect(), 7)
    place = F.col("slot") * 7 + F.col("shard")
    thirds = out.where("text = 'the same'").groupBy(F.floor(place / 2500).alias("third")).count().collect()
    assert len(thirds) == 3 and all(850 < r["count"] < 1150 for r in thirds)
    largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 250  # of 7500, in 128 tasks


def test_order_is_random_and_fixed(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))

    def order(seed):
        return [r.doc_id for r in shuffled_shards(docs, 1, seed).orderBy("slot").collect()]

    first, before = order(0), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        again = order(0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again and first != order(1) and sorted(first) == list(range(2000))
    # neighbours are unrelated, and the means of all tenths are near the whole's
    assert abs(sum(a < b for a, b in zip(first, first[1:], strict=False)) - 1000) < 100
    assert all(abs(sum(first[k : k + 200]) / 200 - 1000) < 170 for k in range(0, 2000, 200))


def test_columns_of_any_kind_and_name(spark):
    kind = "doc_id long, text string, `__hash` int, hash string, bucket int, rows array<int>, row map<string,int>, Slot double, tie struct<a:map<string,int>,b:int>, `a.b` int, own binary"
    rows = [(i // 2, f"t{i // 3}", i, str(i), i, [i], {"k": i}, float(i), ({"z": i}, 1), i, b"x") for i in range(60)] + [(None,) * 11] * 3
    docs = spark.createDataFrame(rows, kind)
    out = shuffled_shards(docs, 4)
    assert [c for c in out.columns if c not in ("size", "text_crc32", "shard", "slot")] == [c if c != "Slot" else "Slot_in" for c in docs.columns]
    got = out.drop("size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r)) for r in docs.collect())
    brute([(r[0], r[1]) for r in rows], out.collect(), 4)


@pytest.mark.parametrize("broadcast", [True, False])
def test_written_shards(spark, tmp_path, broadcast):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")).unionByName(spark.createDataFrame([(999, "y" * 400_000)], "doc_id long, text string"))
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        write_shards(docs, str(tmp_path / "out"), 3, bucket_bytes=2000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k in range(3):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("run=*/*.parquet"))
        assert len(files) > 100 and all(len(f.parent.name) == len("run=") + 9 for f in files)
        slots = [x for f in files for x in pq.ParquetFile(f).read(["slot"])["slot"].to_pylist()]
        assert slots == list(range(len(slots))) and len(slots) == 167
