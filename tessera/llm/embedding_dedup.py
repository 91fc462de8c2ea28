"""Embedding near-dedup by the epsilon grid order join.

Unit vectors are rotated to principal directions and sorted by the grid cells, of side epsilon, of the leading ones.
Range partitioning deals the order out, and each partition's sequence is cut into blocks.  Two blocks meet
only if cells of theirs touch and their bounding boxes are within epsilon.  Eight blocks in a row are a sequence; for each pair of
sequences with blocks that meet, those blocks are sent to one task, once each.  What meets there is joined
recursively: intervals of the two blocks are halved, and a pair of intervals whose boxes are further
apart than epsilon is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, forest, materialise, partitions
from .vectors import listed, matrices, principal, taking_part, unit, valid

#: Leading directions whose cells order the vectors.
LEADING = 6
#: Vectors of a block, and of an interval that is not halved further.
BLOCK, LEAF = 1024, 128
#: Blocks of a sequence, as a power of two.
SEQUENCE = 3


def _projected(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors in leading directions; vectors of another length than the basis keep their first ones."""
    y = x @ basis[:, :LEADING] if len(basis) == x.shape[1] else x[:, :LEADING]
    return np.hstack([y, np.zeros((len(y), LEADING - y.shape[1]))])


def _cells(basis: np.ndarray, epsilon: float):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, LEADING))
            for own, x in matrices(b.column("e")):
                out[own] = _projected(unit(x), basis)
            cell = np.floor(out / epsilon).astype(np.int32)
            columns = {n: b.column(n) for n in b.schema.names} | {f"c{i}": pa.array(cell[:, i]) for i in range(LEADING)}
            yield pa.RecordBatch.from_pydict(columns | {"p": listed(out)})

    return cells


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block: a new one after BLOCK rows and where label or size change."""
    block, held, key = -1, 0, None
    for b in batches:
        out = []
        for now in zip(b.column("label").to_pylist(), b.column("size").to_pylist(), strict=True):
            if now != key or held == BLOCK:
                block, held, key = block + 1, 0, now
            held += 1
            out.append(block)
        yield pa.RecordBatch.from_pydict({n: b.column(n) for n in b.schema.names} | {"block": pa.array(out, pa.int64())})


def _join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, threshold: float, epsilon: float, ux: np.ndarray, uy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between two sequences of vectors, as numbers in each."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and (c, d) < (a, b) or a == b or c == d:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > epsilon * epsilon * (1 + 1e-9) + 1e-12:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            cos = ux[a:b] @ uy[c:d].T
            i, j = np.nonzero(cos >= threshold - 1e-9)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            # what is close to the threshold is decided by the quotient on the vectors as given
            close = np.flatnonzero(np.abs(cos[i - a, j - c] - threshold) < 1e-9)
            drop = [k for k in close if np.dot(x[i[k]], y[j[k]]) / (math.sqrt(np.dot(x[i[k]], x[i[k]])) * math.sqrt(np.dot(y[j[k]], y[j[k]]))) < threshold]
            yield np.delete(i, drop), np.delete(j, drop)
            continue
        m, n = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
        todo += [(a, m, c, n), (a, m, n, d), (m, b, c, n), (m, b, n, d)]


@dataclass
class _Block:
    number: int
    label: object
    node: np.ndarray
    n: np.ndarray
    e: np.ndarray
    p: np.ndarray
    u: np.ndarray


def _between(x: _Block, y: _Block, threshold: float, epsilon: float) -> pa.RecordBatch:
    """Links of two blocks, or within one: (u, null, n), n more links of u, and (u, v, null), a link of the spanning forest."""
    same = x is y
    pairs = list(_join(x.e, y.e, x.p, y.p, same, threshold, epsilon, x.u, y.u))
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    ids = x.node if same else np.concatenate([x.node, y.node])
    j2 = j if same else j + len(x.node)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, y.n[j])
    np.add.at(links, j2, x.n[i])
    low = forest(len(ids), i, j2)
    n, e = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(ids)))
    return pa.RecordBatch.from_pydict({
        "u": pa.array(np.concatenate([ids[n], ids[e]])), "v": pa.array([None] * len(n) + ids[low[e]].tolist(), pa.int64()), "n": pa.array(links[n].tolist() + [None] * len(e), pa.int64()),
    })


def _linked(threshold: float, epsilon: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair of sequences and block; a pair of sequences has 2 ** (SEQUENCE + 1) blocks at the most."""
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            number = rows.column("block").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]])
            blocks = []
            for lo, hi in zip(first, first[1:], strict=False):
                part = rows.slice(lo, hi - lo)
                (_, e), (_, p) = (next(iter(matrices(part.column(c).combine_chunks()))) for c in ("e", "p"))
                blocks.append(_Block(int(number[lo]), part.column("label")[0].as_py(), part.column("node").to_numpy(), part.column("n").to_numpy(), e, p, unit(e)))
            left, right = (rows.column(c)[0].as_py() for c in ("a", "b"))
            for x in blocks:
                for y in blocks:
                    here = x.number >> SEQUENCE == left and y.number >> SEQUENCE == right and x.number <= y.number
                    if here and x.label == y.label and x.e.shape[1] == y.e.shape[1]:
                        yield _between(x, y, threshold, epsilon)

        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (c[1:] != c[:-1])) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and (held[-1].column("a")[0].as_py(), held[-1].column("b")[0].as_py()) != (int(a[lo]), int(c[lo])):
                    yield from done()
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()

    return linked


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is at least the threshold (above 0).  Vectors that are null,
    zero, or hold null or non-finite components, and those without a label or vec_id, link with nothing: n_links 0, their own
    component.  Vectors of different lengths do not link.  Equal vectors are compared once, and each counts as a link of the
    others, repeated rows too.  Rows that share a vec_id are told apart by their vectors and labels.  Other columns are ignored.  An empty
    table gives an empty table.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    epsilon = math.sqrt(2 - 2 * threshold) + 1e-9
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("label"))
    rows = valid(given).where("label is not null and vec_id is not null").select("vec_id", "label", "e")
    alike = rows.groupBy("label", "e").agg(F.count("*").alias("n"), F.min("vec_id").alias("id")).withColumn("size", F.size("e"))
    # each different vector of a label is a node, with a number that is fixed by writing it
    alike = materialise(alike.withColumn("node", F.monotonically_increasing_id()), "alike")
    basis = principal(alike)
    order = ["label", "size", *(f"c{i}" for i in range(LEADING)), "node"]
    label = alike.schema["label"].dataType.simpleString()
    schema = f"label {label}, e array<double>, n long, node long, size int, " + ", ".join(f"c{i} int" for i in range(LEADING)) + ", p array<double>"
    cells = alike.select("label", "e", "n", "node", "size").mapInArrow(_cells(basis, epsilon), schema)
    ordered = cells.repartitionByRange(partitions(alike), *order).sortWithinPartitions(*order)
    blocked = ordered.mapInArrow(_blocks, schema + ", block long").withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("block"))
    blocked = materialise(blocked, "blocks")

    boxes = blocked.groupBy("block").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), *(f(c).alias(f"{n}{c}") for c in ("c0", "c1") for n, f in (("lo_", F.min), ("hi_", F.max))),
        F.array(*(F.min(F.col("p")[i]) for i in range(LEADING))).alias("lo"), F.array(*(F.max(F.col("p")[i]) for i in range(LEADING))).alias("hi"),
    )
    boxes = materialise(boxes, "boxes")
    # unit vectors have few cells in a direction: no more than 2 / epsilon + 2
    at = boxes.withColumn("x", F.explode(F.sequence("lo_c0", "hi_c0"))).withColumn("y", F.explode(F.sequence("lo_c1", "hi_c1"))).select("block", "label", "size", "x", "y", "lo", "hi")
    near = at.withColumn("x", F.explode(F.array(*(F.col("x") + d for d in (-1, 0, 1))))).withColumn("y", F.explode(F.array(*(F.col("y") + d for d in (-1, 0, 1)))))
    near = near.select(F.col("block").alias("b"), "label", "size", "x", "y", F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    gap = F.transform(F.sequence(F.lit(0), F.lit(LEADING - 1)), lambda i: F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("hi_")[i], F.col("lo_")[i] - F.col("hi")[i]))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    pairs = at.withColumnRenamed("block", "a").join(near, ["label", "size", "x", "y"]).where(F.col("a") <= F.col("b")).where(apart <= epsilon * epsilon * (1 + 1e-9)).select("a", "b").distinct()
    pairs = materialise(pairs, "pairs")

    # each block once for each pair of sequences in which one of its pairs is
    ends = pairs.select(F.shiftright("a", SEQUENCE).alias("left"), F.shiftright("b", SEQUENCE).alias("right"), F.explode(F.array("a", "b")).alias("block")).distinct()
    own = blocked.select("block", "label", "node", "n", "e", "p")
    met = own.join(ends, "block").select(F.col("left").alias("a"), F.col("right").alias("b"), "block", "label", "node", "n", "e", "p")
    met = met.repartition(partitions(alike), "a", "b").sortWithinPartitions("a", "b", "block", "node")
    links = materialise(met.mapInArrow(_linked(threshold, epsilon), "u long, v long, n long"), "links")
    for spent in (blocked, boxes, pairs):
        discard(spent)

    roots = connected_components(links.where("v is not null").select("u", "v"))
    counts = links.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("more"))
    named = alike.select("node", "id").join(roots, "node").groupBy("root").agg(F.min("id").alias("least"))
    roots = roots.join(named, "root").select("node", "least")
    classes = alike.select("label", "e", "node", "id", "n").join(counts, "node", "left").join(roots, "node", "left")
    classes = classes.select("label", "e", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    # rows that take no part have no class; all others find that of their vector
    whole = valid(given).where("label is not null and vec_id is not null").select("vec_id", "label", "e").join(classes, ["label", "e"]).select("vec_id", "n_links", "component_id")
    takes_part = F.coalesce(taking_part(F.col("embedding")), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    alone = given.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = whole.unionByName(alone).withColumn("n_links", F.col("n_links").cast("long"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
