"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted, and ordered along a Hilbert curve; several projections and
shifts give several orders.  Each order is range-partitioned and cut into blocks of equal size.  A query meets the
blocks within its window around its own place in each order; each block keeps its best, and the best of all are
ranked by the exact measure.  A block that many queries reach is sent to several tasks, each with a bounded number of them.

The window is fitted, not guessed: for a bounded sample of queries the true neighbours are found by a pass over all
rows, and the window is chosen so that the stated share of them lies within it in at least one order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, ranked
from .vectors import matrices, principal, unit, valid

CURVES, DIRECTIONS, BITS = 4, 6, 10
#: Rows of a block; queries that the window is fitted on at most; share of neighbours that the window must hold.
BLOCK, FITTED, SHARE = 4096, 64, 0.97
#: Queries that meet a block in one task, about.
ASKS = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows), by the transposed-axes construction."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _keys(basis: np.ndarray, seed: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        n = len(basis)
        turns = [np.linalg.qr(rng.standard_normal((n, n)))[0][:, :DIRECTIONS] for _ in range(CURVES)]
        shifts = rng.random((CURVES, DIRECTIONS))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                # vectors of another length than most are cut or filled up, for their order only
                x = np.zeros((part.num_rows, n))
                for own, e in matrices(part.column("e")):
                    x[own, : min(n, e.shape[1])] = e[:, :n]
                x = unit(x + 1e-300)
                for c in range(CURVES):
                    y = (x @ (basis @ turns[c])) * np.sqrt(n) / 8 + 0.5  # unit vectors spread over about one root of n
                    y = np.clip((y + shifts[c, : y.shape[1]] / 4) / 1.25, 0, 1 - 1e-9)
                    y = np.hstack([y, np.zeros((len(y), DIRECTIONS - y.shape[1]))])
                    yield pa.RecordBatch.from_pydict({
                        "curve": pa.array(np.full(len(x), c, np.int32)), "key": pa.array(hilbert((y * (1 << BITS)).astype(np.int64), BITS)), "id": part.column("id"), "e": part.column("e"),
                    })

    return keys


def _scores(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of the k rows of largest inner product of each query those that reach its bar; rows of another length than the query do not count."""
    out = []
    lengths = rows["e"].map(len).to_numpy()
    for n, some in queries.groupby(queries["e"].map(len)):
        own = rows[lengths == n]
        if not len(own):
            continue
        x, ids = np.array(own["e"].tolist()), own["id"].to_numpy()
        for at in range(0, len(some), 512):
            part = some.iloc[at : at + 512]
            s = np.array(part["e"].tolist()) @ x.T
            if len(ids) > k:
                bar = np.maximum(part["bar"].to_numpy(), np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
            else:
                bar = part["bar"].to_numpy()
            i, j = np.nonzero(s >= bar[:, None])  # all ties at the end too
            out.append(pd.DataFrame({"query": part["id"].to_numpy()[i], "id": ids[j], "score": s[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k vectors of largest inner product found for each query, ties to the smaller vec_id.

    queries holds rows of vectors (vec_id, embedding); a query's own row is no neighbour of it.  Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do rows without a vec_id; vectors of another length than the query are no
    neighbours.  Equal vectors are indexed once, with the k + 1 smallest vec_ids, which are all that can be among the nearest.
    Rows that repeat whole count once; rows that share a vec_id are told apart by their vectors, and each that is a query has its own
    ranks from 1.  Other columns are ignored.  Fewer than k candidates are all returned; an empty table gives an empty table.
    """
    rows = valid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).where("vec_id is not null").select("vec_id", "e").distinct()
    members = materialise(rows.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("r") <= k + 1), "members")
    # each different vector is a node, with a number that is fixed by writing it
    index = materialise(members.where("r = 1").select(F.monotonically_increasing_id().alias("id"), "e"), "index")
    members = materialise(members.join(index, "e").select("id", "vec_id"), "members")
    asked = valid(queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding")).where("query_id is not null").select("query_id", "e").distinct()
    asked = materialise(asked.join(index, "e").select("query_id", "id"), "asked")
    total = index.count()
    basis = principal(index)
    if not total or not len(basis):
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")

    placed = ranked(index.mapInArrow(_keys(basis, seed), "curve int, key long, id long, e array<double>"), ["curve", "key", "id"], label="curves")
    placed = materialise(placed.select("curve", "id", "e", (F.col("__start") - F.col("curve") * total).alias("place")), "places")
    targets = asked.select("id").distinct()

    # the window: places between a query and its true neighbours, in the order where they are closest
    sample = targets.join(index, "id").orderBy(F.xxhash64("id"), "id").limit(FITTED).withColumn("bar", F.lit(float("-inf"))).toPandas()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _scores(sample, rows, k + 1)

    truth = _best(index.mapInPandas(exact, "query long, id long, score double"), k + 1).where("query <> id")
    spots = placed.select("curve", "id", "place")
    mine = spots.join(F.broadcast(truth.select(F.col("query").alias("id")).distinct()), "id").select("curve", F.col("id").alias("query"), F.col("place").alias("at"))
    apart = truth.join(spots, "id").join(mine, ["curve", "query"]).groupBy("query", "id").agg(F.min(F.abs(F.col("place") - F.col("at"))).alias("d"))
    distances = sorted(r.d for r in apart.select("d").collect())
    window = distances[min(len(distances) - 1, int(SHARE * len(distances)))] if distances else 0

    reach = -(-window // BLOCK)
    rows = placed.select("curve", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "id", "e", F.lit(None).cast("double").alias("bar"))
    here = rows.join(targets, "id", "left_semi").select("curve", "block", "id", "e")

    def met(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["bar"].notna()
        return _scores(group[asks], group[~asks], k + 1)

    def searched(ask: DataFrame) -> DataFrame:
        parts = ask.groupBy("curve", "block").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        held = rows.join(parts, ["curve", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = ask.join(parts, ["curve", "block"]).withColumn("part", part)
        columns = [*rows.columns, "part"]
        return held.select(columns).unionByName(sent.select(columns)).groupBy("curve", "block", "part").applyInPandas(met, "query long, id long, score double")

    # first the query's own block in each order; the k-th best there is the bar that a row of any other block has to reach
    near = materialise(_best(searched(here.withColumn("bar", F.lit(float("-inf")))).groupBy("query", "id").agg(F.max("score").alias("score")), k + 1), "near")
    found = near
    if reach:
        bars = near.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("bar")).withColumnRenamed("query", "id")
        others = F.array_except(F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.lit((total - 1) // BLOCK), F.col("block") + reach)), F.array("block"))
        found = near.unionByName(searched(here.join(bars, "id").withColumn("block", F.explode(others))))
    best = _best(found.groupBy("query", "id").agg(F.max("score").alias("score")), k + 1)
    full = asked.withColumnRenamed("id", "query").join(best, "query").join(members, "id").where("vec_id <> query_id or id <> query")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
