"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least `least`, without loss.

Most links are found by SimHash: fingerprints of the sets meet by the generalised pigeonhole principle, and what meets is compared
by whole sets.  No fingerprint of 64 bits tells all pairs of that similarity from others (they differ in up to 17 bits in the tables
at hand), so an exact pass finds those that are left, between sets which the links so far leave in different groups.

Its candidates come from prefix filtering.  With the shingles of each text in one order that all texts share, two texts of
similarity t or more have a shingle in common among the first n - ceil(t n) + 1 of each, n being the shingles of the
text.  The order puts shingles that a bounded sample of texts holds often last; it only sets the cost: any order finds
every pair.  Lengths and the places of a common shingle bound the overlap from above, and what is left is compared
by whole sets.

Texts that share a shingle are first compared with one of them, the pivot; only pairs that this leaves in different groups are compared
after that, so a large group of near copies does not make all of its pairs.  A pair of a text and its pivot is compared only if enough of
its first shingles are common, any other pair only where the sizes of both allow their first common shingle to stand.  A shingle with many texts is cut into blocks,
and each pair of blocks is a group of its own.

Before whole sets are fetched, odd sketches are compared: BITS parities of the shingles of a set.  Each shingle that only one of two sets has
changes one bit of the difference, so sets differ in at least as many shingles as sketches in bits, and a pair whose sketches are
too far apart is no link.  Pairs of a group are held against this where they meet; members of a large group that are edited apart
leave no rows behind.  Sketches of sets much larger than BITS tell nothing there, but similar sets of that size have many of their first shingles in
common, where other texts have one or two by chance: only pairs with enough of them, MOST at the most, go on, and are held against sketches
as wide as the sets are large.

A set is known by 64 bits of a hash of 128; sets that these bits mix up are told apart by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, partitions, text_key, trim
from .simhash import BLOCK, kept_rows, majority, near_links, shingle_hashes

#: Texts that the order of shingles is made from at most, and shingles that it ranks.
SAMPLE, RANKED = 16_384, 200_000
#: Rows of first shingles that are dealt out in one pass: so many, or so many for each text if that is more.
PASS, EACH = 1 << 22, 8
#: Parities of an odd sketch, where texts meet.
BITS = 512
#: First shingles that a pair must have in common, at the most.
MOST = 16
#: Shingles of the pairs that are compared by whole sets in one pass: so many, or a quarter of those of all texts if that is more.
WHOLE = 1 << 22


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, hashed as for its fingerprint, as sorted longs."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def odd_sketch(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of `bits` classes of hashes, a power of two, whether a set has an odd number of it, as longs; of half as many it is the XOR of both halves."""
    parity = np.bincount((own & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _order(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, sorted, and in how many."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([shingles(t.as_py(), shingle) for t in b.column("text").slice(at, 500)]))})

    keyed = docs.select("text", text_key().alias("key"))
    bound = keyed.select("key").distinct().orderBy("key").limit(SAMPLE).agg(F.max("key")).first()[0]
    some = keyed.where(F.col("key") <= F.lit(bound)).dropDuplicates(["key"])
    counts = some.select("text").mapInArrow(exploded, "token long").groupBy("token").count().where("count > 2")
    table = materialise(counts.orderBy(F.desc("count"), "token").limit(RANKED), "order")
    rows = table.toPandas().sort_values("token")
    discard(table)
    return rows["token"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def _first(n: int, least: Fraction) -> int:
    """How many shingles of a set of n, in the order, a similar set has one of at the least."""
    return n + (-n * least.numerator) // least.denominator + 1


def _sets(docs: DataFrame, shingle: int, least: Fraction, ranks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, key (of the text), node (of the set of shingles), more (of its hash), fp (its fingerprint), n (its size), sketch, wide (as sketch, of n parities or more; null up to BITS), and head, its first shingles in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        trim()
        for b in batches:
            for at in range(0, b.num_rows, 250):
                nodes, more, prints, sizes, heads, sketches, wide = [], [], [], [], [], [], []
                for t in b.column("text").slice(at, 250):
                    own = shingles(t.as_py(), shingle)
                    whole = xxhash.xxh3_128_intdigest(own.tobytes(), 7)
                    nodes.append(whole & (1 << 64) - 1)
                    more.append(whole >> 64)
                    prints.append(majority(own.view(np.uint64)))
                    place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                    rank = np.where(known[place] == own, often[place], 0) if len(known) else np.zeros(len(own))
                    sizes.append(len(own))
                    sketches.append(odd_sketch(own))
                    wide.append(odd_sketch(own, 1 << (len(own) - 1).bit_length()) if len(own) > BITS else None)
                    heads.append(own[np.argsort(rank, kind="stable")[: _first(len(own), least)]] if len(own) else own)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(at, 250), "key": b.column("key").slice(at, 250), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "more": pa.array(np.array(more, np.uint64).view(np.int64)),
                    "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "n": pa.array(sizes, pa.int32()), "sketch": pa.array(sketches, pa.list_(pa.int64())),
                    "wide": pa.array(wide, pa.list_(pa.int64())), "head": pa.array(heads, pa.list_(pa.int64())),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    return rows.mapInArrow(sets, "doc_id long, key long, node long, more long, fp long, n int, sketch array<long>, wide array<long>, head array<long>")


def told_apart(sets: DataFrame) -> DataFrame:
    """sets (node, more, ...), a written table, in which each node has one `more`: the least keeps the node, the others get a new one."""
    while True:
        mixed = sets.groupBy("node").agg(F.min("more").alias("__least"), F.max("more").alias("__most")).where("__least < __most").drop("__most")
        if mixed.isEmpty():
            return sets
        own = F.when(F.col("more") > F.col("__least"), F.xxhash64("node", "more")).otherwise(F.col("node"))
        old, sets = sets, materialise(sets.join(mixed, "node", "left").withColumn("node", own).drop("__least"), "sets")
        discard(old)


def _may(least: Fraction, n: Column, m: Column, p: Column, q: Column) -> Column:
    """Whether sets of n and m shingles with a common one at places p and q can be similar enough."""
    most = F.least(p, q) + 1 + F.least(n - p - 1, m - q - 1)
    return most * (least.numerator + least.denominator) >= (n + m) * least.numerator


def _pairs(least: Fraction, nearest: bool):
    """Pairs (a, b) of each group whose roots differ and that can be similar enough; the rows come sorted by group.

    asks: of how many tokens a pair that is similar enough comes at least.  nearest: only each row and the one whose sketch is nearest to its own.
    """
    up, down = least.numerator, least.denominator

    def rows_of(node: np.ndarray, asks: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        u, v = node[p], node[q]
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(u, v)), "b": pa.array(np.maximum(u, v)), "asks": pa.array(asks.astype(np.int32))})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: list[np.ndarray] | None = None
        names = ["token", "left", "right", "node", "root", "n", "at", "block"]

        def compared(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, left, right, node, root, n, place, block, sketch = c
            change = (token[1:] != token[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            group = np.concatenate([[0], np.cumsum(change)])
            x = np.arange(len(node))
            best, partner, asked = np.full(len(node), BITS + 1), np.full(len(node), -1), np.zeros(len(node), np.int64)
            short = -(-n * up // down)
            for shift in range(1, len(node)):
                x = x[x + shift < len(node)]
                x = x[group[x] == group[x + shift]]
                if not len(x):
                    break
                y = x + shift
                # the shingles that similar sets of these sizes have in common; asks of them stand among the n - need + asks first of each: if the first
                # of one end before those of the other, what is common and not in both is behind them, where there are need - asks
                need = -(-(n[x] + n[y]) * up // (up + down))
                asks = np.minimum(MOST, 1 + need - np.maximum(short[x], short[y]))  # as far as heads go; under 1: sizes too different
                once = (left[x] == right[x]) | (block[x] != block[y])  # pairs within a block are compared in the block's own group
                good = np.flatnonzero(once & (root[x] != root[y]) & (asks > 0) & (place[x] < n[x] - need + asks) & (place[y] < n[y] - need + asks))
                # sets of n and m shingles that are similar enough differ in n + m - 2 need at most
                apart = np.bitwise_count((sketch[x[good]] ^ sketch[y[good]]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of a negative number it would count the bits of its size
                near = apart <= (n[x] + n[y] - 2 * need)[good]
                p, q, asks, apart = x[good[near]], y[good[near]], asks[good[near]], apart[near]
                if not nearest and len(p):
                    yield rows_of(node, asks, p, q)
                for own, other in ((p, q), (q, p)):
                    nearer = apart < best[own]
                    best[own[nearer]], partner[own[nearer]], asked[own[nearer]] = apart[nearer], other[nearer], asks[nearer]
            if nearest:
                p = np.flatnonzero(partner >= 0)
                yield rows_of(node, asked[p], p, partner[p])

        for batch in batches:
            c = [batch.column(k).to_numpy() for k in names]
            c.append(batch.column("sketch").flatten().to_numpy().reshape(-1, BITS // 64))
            c = [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)] if held else c
            if not len(c[0]):
                continue
            same = (c[0] == c[0][-1]) & (c[1] == c[1][-1]) & (c[2] == c[2][-1])
            whole = len(same) - int(same.sum())
            if whole:
                yield from compared([x[:whole] for x in c])
            held = [x[whole:] for x in c]
        if held and len(held[0]):
            yield from compared(held)

    return pairs


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, node, n, at), sorted by token and place, those whose token another node has too, each with the token's first node, the pivot."""
    trim()
    names = ["token", "node", "n", "at"]
    last: list[np.ndarray] | None = None  # the row before, where it may still turn out to be shared
    pivot: list[np.ndarray] | None = None
    for b in batches:
        c = [b.column(k).to_numpy() for k in names]
        if not len(c[0]):
            continue
        c = [np.concatenate([x, y]) for x, y in zip(last, c, strict=True)] if last else c
        token = c[0]
        start = np.concatenate([[True], token[1:] != token[:-1]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
        ends = np.concatenate([start[1:], [False]])  # the last row waits for the next batch
        shared = ~(start & ends)
        lead = [x[first] for x in c[1:]]
        if pivot is not None and pivot[0][0] == token[0]:  # the group goes on from an earlier batch
            own = first == 0
            lead = [np.where(own, y, x) for x, y in zip(lead, pivot[1:], strict=True)]
            shared |= own
        keep = np.flatnonzero(shared[:-1])
        yield pa.RecordBatch.from_pydict({k: pa.array(x[keep]) for k, x in zip([*names, "to", "to_n", "to_at"], [*c, *lead], strict=True)})
        go_on = not start[-1] or (pivot is not None and pivot[0][0] == token[-1])
        pivot = [token[-1:], *(x[-1:] for x in lead)] if go_on else None
        last = [x[-1:] for x in c]
    if last is not None and pivot is not None:
        yield pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in zip([*names, "to", "to_n", "to_at"], [*last, *pivot[1:]], strict=True)})


def _tokens(docs: DataFrame, sets: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, tokens) of some nodes, from one text of each."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                own = [shingles(t.as_py(), shingle) for t in b.column("text").slice(at, 500)]
                yield pa.RecordBatch.from_pydict({"node": b.column("node").slice(at, 500), "tokens": pa.array(own, pa.list_(pa.int64()))})

    on = ["none", "id", "key"]  # plain keys, by which equal rows are told too, so that texts are dealt out once
    held = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("x"))
    held = held.select("node", F.col("x.doc_id").alias("id"), F.col("x.key").alias("key"))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text", text_key().alias("key"))
    held, found = (x.withColumns({"none": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))}) for x in (held, found))
    found = found.join(held, on).dropDuplicates(on).select("node", "text")
    return found.mapInArrow(tokens, "node long, tokens array<long>")


def _near_enough(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b, n) of nodes whose sketches differ in no more bits than similar sets of their sizes do in shingles; n: the shingles of both."""
    known = sets.select("node", "n", F.coalesce("wide", "sketch").alias("sketch")).dropDuplicates(["node"])
    x, y = (known.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    n, need = F.col("n_a") + F.col("n_b"), F.ceil((F.col("n_a") + F.col("n_b")) * least.numerator / F.lit(least.numerator + least.denominator))
    bits = F.least(F.size("sketch_a"), F.size("sketch_b"))

    def folded(s: str) -> Column:
        parts = F.sequence(F.lit(0), (F.size(s) / bits).cast("int") - 1)
        narrow = F.transform(F.sequence(F.lit(1), bits), lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(F.col(s), k * bits + i - 1))))
        return F.when(F.size(s) > bits, narrow).otherwise(F.col(s))

    differ = F.aggregate(F.zip_with(folded("sketch_a"), folded("sketch_b"), lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, t: s + t)
    return pairs.join(x, "a").join(y, "b").where((F.least("n_a", "n_b") >= need) & (differ <= n - 2 * need)).select("a", "b", n.cast("long").alias("n"))


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Of pairs (a, b) of nodes those of enough similarity, by sketches and then by whole sets, as links (u, v).

    Whole sets are written and sent in passes, each of some of the pairs, and only one pass of them is on disk at a time.
    """
    pairs = materialise(_near_enough(pairs.distinct(), sets, least), "pairs")
    most = max(WHOLE, (sets.agg(F.sum("n").cast("long")).first()[0] or 0) // 4)
    passes = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // most))
    links = []
    for k in range(passes):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == k).select("a", "b")
        some = materialise(_tokens(docs, sets, part.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle), "tokens")
        x, y = (some.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
        both = part.join(x, "a").join(y, "b")
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        enough = common * (least.numerator + least.denominator) >= (F.size("tokens_a") + F.size("tokens_b")) * least.numerator
        links.append(materialise(both.where(enough).select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))
        discard(some)
    discard(pairs)
    return reduce(DataFrame.unionByName, links)


def _likely(met: DataFrame, least: Fraction) -> DataFrame:
    """Of rows (a, b, n_a, n_b), one for each first shingle that two sets share, the pairs that can be similar enough."""
    behind = F.greatest(*(F.ceil(F.col(c) * least.numerator / F.lit(least.denominator)) for c in ("n_a", "n_b"))) - 1
    common = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    return common.where((F.col("common") + behind) * (least.numerator + least.denominator) >= (F.col("n_a") + F.col("n_b")) * least.numerator).select("a", "b")


def fingerprint_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or meet within the radius.

    Each fingerprint's least node stands for it, and of the fingerprints that meet a spanning forest is given; what that misses is left
    to the exact pass.
    """
    named = materialise(sets.where("n > 0").groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("other")), "named")
    met = near_links(named.select("fp"), radius)
    x, y = (named.select(F.col("fp").alias(k), F.col("rep").alias(n)) for k, n in (("u", "a"), ("v", "b")))
    across = met.join(x, "u").join(y, "v").select("a", "b")
    within = sets.select("node", "fp").join(named.where("rep < other").select("fp", "rep"), "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_links(docs: DataFrame, sets: DataFrame, shingle: int, least: Fraction, radius: int = 3) -> DataFrame:
    """Links (u, v) between the sets of docs, enough to connect all pairs of at least that similarity; rows of one node are one set."""
    near = materialise(fingerprint_pairs(sets, radius), "near")
    heads = sets.where("n > 0").select("node", "n", "head").dropDuplicates(["node"])
    keyed = heads.select("node", "n", F.posexplode("head").alias("at", "token")).select("token", "node", "n", "at")
    placed = keyed.repartition(partitions(sets), "token").sortWithinPartitions("token", "at", "node")
    shared = materialise(placed.mapInArrow(_met, "token long, node long, n int, at int, to long, to_n int, to_at int"), "shared")

    # the pivot has the fewest shingles that are rarer, so it is near what the others were copied from; what this misses is left to the exact pass
    met = shared.where((F.col("node") != F.col("to")) & _may(least, F.col("n"), F.col("to_n"), F.col("at"), F.col("to_at")))
    low, high = (f(F.struct("node", "n"), F.struct(F.col("to").alias("node"), F.col("to_n").alias("n"))) for f in (F.least, F.greatest))
    pivots = _likely(met.select(low.alias("x"), high.alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")), least)
    links = _verified(docs, sets, near.unionByName(pivots), shingle, least)
    discard(near)
    # first each set and the nearest that it meets, which joins most; then whatever is still apart
    for nearest in (True, False):
        met = _still_apart(shared, sets, connected_components(links), least, nearest)
        common = reduce(DataFrame.unionByName, met).groupBy("a", "b", "asks").agg(F.sum("common").alias("common"))
        # a set and the nearest that it meets need not meet at each of their shingles: what a quarter of them leaves out is left to the last pass
        likely = common.where(F.col("common") * (4 if nearest else 1) >= F.col("asks")).select("a", "b")
        links = links.unionByName(_verified(docs, sets, likely, shingle, least))
        for table in met:
            discard(table)
    discard(shared)
    return links


def _still_apart(shared: DataFrame, sets: DataFrame, roots: DataFrame, least: Fraction, nearest: bool) -> list[DataFrame]:
    """Pairs (a, b, asks, common) of _pairs() among the first shingles whose texts lie in several groups, as written tables, one for each pass.

    common: at how many of a pass's shingles a pair meets.

    Rows are dealt out by shingle and pair of blocks, so a shingle of many texts makes many more rows than it has texts.  They go in passes,
    each of some of the shingles and pairs of blocks, and only one pass of them is on disk at a time.
    """
    rest = materialise(shared.drop("to", "to_n", "to_at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rest")
    # a shingle whose texts are one group already has nothing to compare
    several = rest.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")).where("low < high")
    several = materialise(several.select("token", "held", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "several")
    dealt = several.agg(F.sum(F.col("held") * F.col("blocks"))).first()[0] or 0
    passes = max(1, -(-dealt // max(PASS, EACH * sets.count())))
    sketches = sets.select("node", "sketch").dropDuplicates(["node"])
    open_ = rest.join(several, "token").join(sketches, "node").withColumns({"block": F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    groups = ["token", "left", "right"]
    open_ = open_.select("token", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "root", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"), "block", "sketch")
    met = []
    for k in range(passes):
        some = open_.where(F.pmod(F.xxhash64(*groups), F.lit(passes)) == k) if passes > 1 else open_
        ordered = some.repartition(partitions(sets), *groups).sortWithinPartitions(*groups, "node")
        met.append(materialise(ordered.mapInArrow(_pairs(least, nearest), "a long, b long, asks int").groupBy("a", "b", "asks").agg(F.count("*").alias("common")), "met"))
    discard(several)
    discard(rest)
    return met


def one_of_similar(docs: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """docs with one row of each group of similar texts: a row of the smallest doc_id.

    A group is what can be reached by steps between texts whose sets of `shingle`-word shingles have a Jaccard similarity
    of at least `least`; a text of fewer words is one shingle, and texts without words are similar to each other.
    """
    sets = told_apart(materialise(_sets(docs, shingle, least, _order(docs, shingle)), "sets"))
    roots = connected_components(similar_links(docs, sets, shingle, least))
    named = sets.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    return kept_rows(docs, named)
