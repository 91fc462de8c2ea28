"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints that differ in at most `radius` bits are found by splitting the bits into parts.  With part
thresholds t_i (-1 or more) that sum to radius - parts + 1, a pair within the radius differs in at most t_i bits
of at least one part i: were each part over its threshold, the differences would sum to at least radius + 1.

* Bits that correlate are put into the same part, so that parts are close to independent of each other.
* The thresholds are allocated by dynamic programming over the costs which a bounded sample of fingerprints lets
  expect: the keys a part probes with and the pairs that meet in it.  The plan only sets the cost; any plan
  finds every pair.
* Each fingerprint is filed under its own value of a part and probes with all values within the threshold; what
  meets is compared on all 64 bits.  The fingerprints of a key with many are told apart once more, by radius + 1 parts of the
  bits outside the key's, one of which a pair within the radius has in common.  Where many agree even in that, they
  are cut into blocks, and each pair of blocks is a group of its own, so no group grows without bound.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, forest, materialise, partitions, text_key

#: Fingerprints that the plan is made from at most.
SAMPLE = 4096
#: Fingerprints of one key that are compared in one group, about.
BLOCK = 512


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 hashes, seed 42, of a text's shingles, repeats included.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case; a shingle is `shingle` words joined by
    a space.  Fewer words give one shingle of all; no word gives none.
    """
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """64 bits: those that over half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text: the majority of its shingles' hashes."""
    return majority(shingle_hashes(text, shingle))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (of the text) and fingerprint as a (signed) long."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "key": b.column("key"), "fp": pa.array(out.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInArrow(scored, "doc_id long, key long, fp long")


def _parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of about equal size, each grown by the free bit that correlates most with it."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    like = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-12)
    free, out = set(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        own = [min(free)]
        free.remove(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: like[b, own].sum())
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, for `total` fingerprints like those of the sample (uint64).  Parts with threshold -1 are left out."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) if len(sample) else np.zeros((1, 64))
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    scale = (total / max(1, len(bits))) ** 2
    some = bits[: min(len(bits), 1024)]
    ratio = (len(bits) / max(1, len(some))) ** 2
    for parts in range(1, min(radius + 1, 8) + 1):
        groups = _parts(bits, parts)
        slack = radius - parts + 1
        costs = []
        for g in groups:
            x = some[:, g]
            apart = x.sum(1)[:, None] + x.sum(1)[None, :] - 2 * (x @ x.T)
            np.fill_diagonal(apart, 99)
            chance = [sum(math.comb(len(g), j) for j in range(t + 1)) / 2.0 ** len(g) for t in range(slack + 1)]
            keys = [sum(math.comb(len(g), j) for j in range(t + 1)) for t in range(slack + 1)]
            # pairs seen in the sample, and at the least those that chance brings together
            costs.append([0.0] + [30.0 * total * keys[t] + max((apart <= t).sum() * ratio * scale, total * total * chance[t]) for t in range(slack + 1)])
        # table[s]: the least cost of the parts so far with thresholds that sum to s
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in table.items():
                for t in range(-1, slack + 1):
                    if s + t not in new or cost + c[t + 1] < new[s + t][0]:
                        new[s + t] = (cost + c[t + 1], [*chosen, t])
            table = new
        cost, chosen = table[slack]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _keys(parts: list[tuple[list[int], int]]):
    """For each fingerprint its key in each part (own: true) and those it probes with."""
    masks = []
    for i, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in c) for j in range(1, t + 1) for c in itertools.combinations(bits, j)]
        masks.append((i, np.uint64(mask), np.array([0, *flips], np.uint64)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column("fp").to_numpy()
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096].view(np.uint64)
                for i, mask, flips in masks:
                    value = ((fp & mask)[:, None] ^ flips[None, :]).ravel()
                    own = np.zeros((len(fp), len(flips)), bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(np.full(len(value), i, np.int32)), "value": pa.array(value.view(np.int64)), "own": pa.array(own.ravel()), "fp": pa.array(np.repeat(fp, len(flips)).view(np.int64)),
                    })

    return keys


def _links(radius: int):
    """Compares the fingerprints of each group; the rows come sorted by group."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["part", "value", "sub", "rest", "left", "right"]
        held: pd.DataFrame | None = None

        def compared(rows: pd.DataFrame) -> pa.RecordBatch:
            key = rows[columns].to_numpy()
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            fp = rows["fp"].to_numpy().view(np.uint64)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            at = np.arange(len(fp))
            for shift in range(1, len(fp)):
                at = at[at + shift < len(fp)]
                at = at[group[at] == group[at + shift]]
                if not len(at):
                    break
                near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
                a.append(near)
                b.append(near + shift)
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            # of the links in this batch a spanning forest goes on: the components stay the same
            values, place = np.unique(fp.view(np.int64), return_inverse=True)
            low = forest(len(values), place[x], place[y])
            linked = np.flatnonzero(low != np.arange(len(values)))
            return pa.RecordBatch.from_pydict({"u": pa.array(values[linked]), "v": pa.array(values[low[linked]])})

        for batch in batches:
            rows = batch.to_pandas()
            rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows
            if not len(rows):
                continue
            key = rows[columns]
            same = (key == key.iloc[-1]).all(axis=1).to_numpy()
            whole = int(len(rows) - same.sum())
            if whole:
                yield compared(rows.iloc[:whole])
            held = rows.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield compared(held)

    return links


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) between the distinct fingerprints `fp` of a table, enough to connect all that are within the radius directly or in steps."""
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    chosen = plan(sample, total, radius)
    keyed = materialise(distinct.mapInArrow(_keys(chosen), "part int, value long, own boolean, fp long"), "keys")
    counts = keyed.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("own").alias("filed")).where("n > 1 and filed")
    met = keyed.join(counts.select("part", "value", "n"), ["part", "value"]).select("part", "value", "n", "fp")
    many = F.col("n") > BLOCK
    few = met.where(~many).select("part", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest"), "fp", F.lit(1).alias("blocks"))
    masks = F.array(*(F.array(*(F.lit(m) for m in _outside(bits, radius))) for bits, _ in chosen)) if chosen else F.array(F.array(F.lit(0)))
    mask = F.get(F.get(masks, F.col("part")), F.col("sub"))
    cut = met.where(many).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(radius)))).withColumn("rest", F.col("fp").bitwiseAND(mask)).drop("n")
    key = ["part", "value", "sub", "rest"]
    sizes = cut.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = few.unionByName(cut.join(sizes, key).select(*key, "fp", "blocks"))
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    # a row meets the rows of each block: one group for each pair of blocks
    met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "fp")
    groups = [*key, "left", "right"]
    met = met.repartition(partitions(distinct), *groups).sortWithinPartitions(*groups, "fp")
    links = materialise(met.mapInArrow(_links(radius), "u long, v long"), "links")
    discard(keyed)
    return links


def _outside(bits: list[int], radius: int) -> list[int]:
    """Masks, as signed longs, of radius + 1 parts of the bits that are not among these."""
    free = [b for b in range(64) if b not in bits]
    masks = [sum(1 << b for b in free[i :: radius + 1]) for i in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _rooted(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and of each fingerprint its least doc_id and the root of its component."""
    prints = materialise(fingerprints(docs, shingle), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    own = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return prints, materialise(own, "own")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (long), fingerprint (16 hex digits) and component_id of each document.

    component_id is the smallest doc_id that can be reached by steps of at most `radius` differing bits.  Null, empty and
    blank texts have fingerprint 0 and are linked like others.  Rows with one doc_id each have their row; a null doc_id is
    passed over for the smallest, unless a component has no other.  A text of any length is read whole, in memory in proportion to it.
    Other columns, of whatever name, are ignored.  An empty table gives an empty table.
    """
    prints, own = _rooted(docs, shingle, radius)
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, named: DataFrame) -> DataFrame:
    """docs with one row of each root of named (doc_id, key of the text, root): one of the smallest doc_id, a null doc_id last.

    Of rows that share doc_id and text that stays which is least by its other columns, as JSON in order of their names.
    """
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    best = best.select(F.col("best.none").alias("__none"), F.coalesce(F.col("best.doc_id"), F.lit(0)).alias("__id"), F.col("best.key").alias("__text"))
    # plain keys, which the groups share, so that texts are dealt out once
    on = ["__none", "__id", "__text"]
    number = F.col("doc_id").cast("long")
    marked = docs.withColumns({"__none": number.isNull(), "__id": F.coalesce(number, F.lit(0)), "__text": text_key()})
    groups = on if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else [*on, "doc_id"]
    # to_json leaves out nulls, so a row without a value comes before or after those with one, but always in the same place
    others = F.to_json(F.struct(F.col("text").isNull().alias("none"), *(F.col(f"`{c}`") for c in sorted(docs.columns) if c not in ("doc_id", "text"))))
    one = marked.join(best, on, "left_semi").groupBy(*groups).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), others).alias("__row"))
    return one.select("__row.*")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each group: a row of the smallest doc_id.  Rows that share a doc_id are told apart by their texts."""
    prints, roots = _rooted(docs, shingle, radius)
    return kept_rows(docs, prints.join(roots, "fp").select("doc_id", "key", "root"))
