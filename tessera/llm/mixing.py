"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words.  A document first gets the whole copies that every document of its source is sure
of.  What is left of the target is filled by a Pareto sample: documents are ranked by the odds of a seeded
uniform number divided by the odds of their inclusion, all documents in one order, and the first ones are taken up to the size that
is fixed by the target.  The inclusion of a document is the share of its source's words that is left to fill, so that on
average each document is taken as often as the target asks for, short or long; inclusions differ between sources, and their odds are multiplied
by a document's own preference where a column of these is named.  Without preferences each source's sample ends about where
the quotient is 1; its size is fixed, so it ends where its words come nearest to the target, and one document further on in the ranking may fill the rest.

The sample is never sorted as a whole.  Ranks are integers; sums of words per source and range of ranks narrow
the range in which a source's last document lies, ten bits at a time, so a source that holds most rows costs
no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, n_words, ranked, set_aside

#: Bits of a rank, narrowed LEVEL bits at a time.
BITS, LEVEL = 40, 10


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of sources: sizes has (source, source_size); adds target.

    Sources are ordered by code point, null last, and take the weights in turn.  They share `share` times all words; a
    target stops at `most` times its source's size, and the excess is shared again by weight until none is above.
    """
    order = sizes.withColumns({"__null": F.col("source").isNull().cast("int")})
    turn = ranked(order.repartition("source"), ["__null", "source"], label="sources").drop("__null")
    turn = turn.withColumns({
        "__w": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("__start", F.lit(len(weights))) + 1).cast("int")),
        "__cap": F.col("source_size") * F.lit(float(most)),
    })
    turn = materialise(turn, "targets")
    level, before = 0.0, None
    total = float(turn.agg(F.sum("source_size")).first()[0] or 0) * share
    while level != before:
        before = level
        at_cap = F.col("__cap") <= F.lit(level) * F.col("__w")
        capped, rest = turn.agg(F.sum(F.when(at_cap, F.col("__cap")).otherwise(0.0)), F.sum(F.when(~at_cap, F.col("__w")).otherwise(0.0))).first()
        if not rest:
            break
        level = max(level, (total - capped) / rest)
    return turn.withColumn("target", F.least(F.col("__cap"), F.lit(level) * F.col("__w"))).drop("__w", "__cap", "__start")


def _uniform(seed: int, *columns: str) -> Column:
    """A number above 0 and below 1, fixed by the seed and the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, prefer: str | None = None) -> DataFrame:
    """docs with size, source_size, target (its source's), copies and taken (copies times size).

    size is the number of words, 0 for a null or empty text, and counts the whole of a long one.  The outcome is fixed by the seed, doc_id and
    text; rows equal in both have one rank and are taken or left together.  Ties of rank between different documents, of one in 2**40, are
    too.  Null sources form a source of their own; a source without words has target 0, and its documents are not taken beyond their whole
    copies.  prefer: a column of factors of the odds of inclusion; null and what is not above 0 count as 1.  Own columns of the five names come back with `_in` appended; others may have any name and type.  An empty table gives an
    empty table.
    """
    docs = set_aside(docs, "size", "source_size", "target", "copies", "taken")
    columns = [f"`{c}`" for c in docs.columns]
    draw = _uniform(seed, "doc_id", "text")
    weight = F.col(f"`{prefer}`").cast("double") if prefer else F.lit(1.0)
    weight = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0)
    # the caller's columns travel in one struct, so that no name meets those of this function
    sized = docs.select(F.struct(*columns).alias("row"), "source", n_words(F.col("text")).alias("size"), (draw / (1 - draw) / weight).alias("odds"))
    narrow = materialise(sized.select("source", "size", "odds"), "sizes")
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("sure", F.floor(rate + 1e-12).cast("long"))
    sources = sources.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size")))
    # the odds that a document of the source is in the sample; the quotient of its own odds and these ranks it, as a whole number
    sources = sources.withColumn("inclusion", F.when(F.col("left") < F.col("source_size"), F.col("left") / (F.col("source_size") - F.col("left"))).otherwise(float(1 << 30)))
    rank = F.floor(F.col("odds") / (F.col("odds") + F.col("inclusion")) * float(1 << BITS)).cast("long")
    # low: documents of lower rank are in the sample, with `done` words; the last document's rank is in the range that starts there
    state = sources.withColumns({"low": F.lit(0).cast("long"), "done": F.lit(0).cast("long"), "next": F.lit(0).cast("long")})
    for at in range(BITS - LEVEL, -1, -LEVEL):
        width = 1 << at
        state = materialise(state, "ranks")
        s = state.select(F.col("source").alias("own"), "inclusion", "low", "done", "left")
        inside = narrow.join(s, narrow.source.eqNullSafe(s.own)).withColumn("rank", rank).where(f"rank >= low and rank < low + {width << LEVEL}")
        ranges = inside.groupBy("own", F.shiftright("rank", at).alias("range")).agg(F.sum("size").alias("words"), F.first("done").alias("done"), F.first("left").alias("left"))
        # at most 2**LEVEL rows per source
        by = Window.partitionBy("own").orderBy("range")
        sums = ranges.withColumn("end", F.col("done") + F.sum("words").over(by))
        last = sums.where("end > left").groupBy("own").agg(F.min(F.struct("range", "end", "words")).alias("x"))
        last = last.select("own", (F.col("x.range") * width).alias("l"), (F.col("x.end") - F.col("x.words")).alias("d"), F.col("x.words").alias("w"))
        state = state.join(last, state.source.eqNullSafe(last.own), "left").select(
            "source", "source_size", "target", "sure", "left", "inclusion",
            # nothing passes the target: all of the range is in
            F.coalesce("l", F.col("low") + (width << LEVEL)).alias("low"), F.coalesce("d", F.col("done")).alias("done"), F.coalesce("w", F.lit(0).cast("long")).alias("next"),
        )
    # the words that are missing at `low`, and the document past it that comes nearest to them, the one at `low` too
    state = materialise(state.withColumn("gap", F.col("left") - F.col("done")), "ranks")
    s = state.select(F.col("source").alias("own"), "inclusion", "low", "gap").where("gap > 0")
    past = narrow.join(s, narrow.source.eqNullSafe(s.own)).withColumn("rank", rank).where("rank >= low and size > 0")
    filler = past.groupBy("own").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank")).alias("x"), F.first("inclusion").alias("inclusion")).select("own", "inclusion", F.col("x.rank").alias("fill"))
    # rows may share that rank: the words of all
    words = narrow.join(filler, narrow.source.eqNullSafe(filler.own)).where(rank == F.col("fill")).groupBy("own", "fill").agg(F.sum("size").alias("more"))
    state = state.join(words, state.source.eqNullSafe(words.own), "left").withColumn("fill", F.when(F.abs(F.col("more") - F.col("gap")) < F.col("gap"), F.col("fill")))
    state = materialise(state.select(F.col("source").alias("own"), "source_size", "target", "sure", "inclusion", "low", "left", "fill"), "ranks")
    discard(narrow)
    sampled = (((F.col("rank") < F.col("low")) & (F.col("left") > 0)) | F.coalesce(F.col("rank") == F.col("fill"), F.lit(False))).cast("long")
    out = sized.join(state, sized.source.eqNullSafe(state.own)).withColumn("rank", rank).withColumn("copies", F.col("sure") + sampled)
    return out.select(*(F.col(f"row.{c}") for c in columns), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
