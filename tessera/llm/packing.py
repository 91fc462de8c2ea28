"""Mixture-controlled packing: deficit round-robin over one queue per source.

In each round a source may send its quantum, its target share of a window, plus the deficit it carries; what it
sends is whole tokens, and the rest is carried on.  A source whose quantum is under `least` tokens saves up: it has a turn every
k-th round, with k quanta, and sources take different rounds of the k.  After t turns a source with quantum q has
sent floor(t k q) tokens, so the round of any token, and with it the deficit at any point, follow from the token's place in its
queue: rounds need not be played one after another, and deficits carry across windows and partitions alike.
The rounds' pieces in order, cut at each `window` tokens, are the sequences.  Targets are the sources' shares of all
tokens unless others are given; a queue that runs dry leaves its share to the others, by their targets.  Only the last sequence is short.
"""

from __future__ import annotations

import array
import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, discard, forget, materialise, ranked, release

#: Chunks whose ids a worker remembers at most.
REMEMBERED = 600_000
#: Bytes of texts that go to a worker at a time: what is remembered needs the memory.
BATCH = 1 << 22


class Encoder:
    """Byte-level BPE ids of texts as little-endian 16-bit numbers, from a .tiktoken vocabulary of under 65536 ids.

    No piece of the split pattern has a space or line end inside or at its end, unless white space meets white space.  So a
    text in which that does not occur has the ids of its chunks, each with the space or line end before it, one after
    another; the ids of common chunks are remembered.  Any other text is encoded whole.

    Tokens that the .json of the same name adds to the vocabulary are found in texts first; what lies between is encoded.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ids must be under 65536")
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = _Chunks(self.whole)
        self.added = _added(f"{path.removesuffix('.tiktoken')}.json")
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def ids(self, text: str) -> bytes:
        if not self.split or not any(t in text for t in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if first and first[-1].isspace():
                raise _Unsafe
            return b"".join([_packed(self.whole(first)), *map(self.known.__getitem__, rest)])
        except _Unsafe:
            return _packed(self.whole(text))


def _added(path: str) -> dict[str, bytes]:
    """The added tokens of a tokenizer's JSON with their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens must be found as they are")
    return {t["content"]: _packed([t["id"]]) for t in tokens}


class _Unsafe(Exception):
    pass


def _packed(ids: list[int]) -> bytes:
    return array.array("H", ids).tobytes()


class _Chunks(dict):
    def __init__(self, encode):  # noqa: ANN001
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        line = chunk[:1] == "\n"
        body = chunk[1:] if line else chunk
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Unsafe
        ids = _packed(self.encode(chunk if line else " " + chunk))
        if len(chunk) < 40 and len(self) < REMEMBERED:
            self[chunk] = ids
        return ids


def _encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, kept while documents are encoded; the stages after that forget it."""
    if ("encoder", path, pattern) not in KEPT:
        KEPT["encoder", path, pattern] = Encoder(path, pattern)
    return KEPT["encoder", path, pattern]


def tokenised(docs: DataFrame, path: str, pattern: str, end: int = 1) -> DataFrame:
    """doc_id, source, ids (16-bit, `end` last) and n of each document; a null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = _encoder(path, pattern), _packed([end])
        for b in batches:
            texts = b.column("text")
            for at in range(0, len(texts), 500):
                ids = [encoder.ids(t.as_py() or "") + tail for t in texts.slice(at, 500)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(at, 500), "source": b.column("source").slice(at, 500), "ids": pa.array(ids, pa.binary()), "n": pa.array([len(x) // 2 for x in ids], pa.int64()),
                })
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(encode, "doc_id long, source string, ids binary, n long")


def schedule(sizes: DataFrame, window: int, targets: dict[str | None, float] | None = None, least: int = 16) -> DataFrame:
    """Pieces of documents in sequences: sizes has (uid, source, n); rows (uid, start, length, sequence_id, offset)."""
    queued = ranked(sizes.withColumn("__null", F.col("source").isNull().cast("int")), ["__null", "source", "uid"], weight="n", label="queues")
    queued = materialise(queued, "queues")
    sources = queued.groupBy("__null", "source").agg(F.min("__start").alias("first"), F.sum("n").alias("tokens")).withColumnRenamed("source", "source_").withColumnRenamed("__null", "null_")
    share = F.col("tokens").cast("double")
    for name, weight in (targets or {}).items():
        share = F.when(F.col("source_").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    sources = materialise(sources.withColumn("share", share), "shares")
    total = sources.agg(F.sum("share")).first()[0] or 1.0
    quantum = F.lit(float(window)) * F.col("share") / F.lit(total)
    sources = sources.withColumn("k", F.greatest(F.lit(1), F.ceil(F.lit(float(least)) / quantum)).cast("long"))
    sources = sources.withColumns({"q": quantum * F.col("k"), "phase": F.pmod(F.xxhash64("source_"), F.col("k"))})
    d = queued.join(sources, queued.source.eqNullSafe(sources.source_)).select("uid", "n", "first", "q", "k", "phase", (F.col("__start") - F.col("first")).alias("at"))

    # the turn of a token is the last t with floor(t q) at or before it; doubles may be off by one either way
    def turn_of(token):  # noqa: ANN001, ANN202
        guess = F.floor((token + 1) / F.col("q"))
        sent = lambda t: F.floor(t * F.col("q"))
        return F.when(sent(guess + 1) <= token, guess + 1).when(sent(guess) <= token, guess).when(sent(guess - 1) <= token, guess - 1).otherwise(guess - 2)

    last = F.col("at") + F.col("n") - 1
    turns = d.withColumn("turn", F.explode(F.sequence(turn_of(F.col("at")), turn_of(last))))
    low = F.greatest(F.col("at"), F.floor(F.col("turn") * F.col("q")))
    high = F.least(last + 1, F.floor((F.col("turn") + 1) * F.col("q")))
    pieces = turns.select("uid", (F.col("turn") * F.col("k") + F.col("phase")).alias("round"), "first", (low - F.col("at")).alias("start"), (high - low).alias("length")).where("length > 0")
    placed = ranked(pieces, ["round", "first", "uid", "start"], weight="length", label="pieces")
    discard(queued)  # the pieces are written
    end = F.col("__start") + F.col("length")
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("__start") / window), F.floor((end - 1) / window))))
    begin = F.greatest(F.col("__start"), F.col("sequence_id") * window)
    return cut.select(
        "uid", (F.col("start") + begin - F.col("__start")).alias("start"), (F.least(end, (F.col("sequence_id") + 1) * window) - begin).alias("length"), "sequence_id", (begin - F.col("sequence_id") * window).alias("offset")
    )


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for whole in batches:
        for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
            out: dict[str, list] = {c.split()[0]: [] for c in _PIECES.split(", ")}
            for doc_id, ids, n, pieces in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("n").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                wide = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                for p in pieces:
                    own = wide[p["start"] : p["start"] + p["length"]].tobytes()
                    for k, v in zip(out, (doc_id, p["start"], p["length"], zlib.crc32(own), n, p["sequence_id"], p["offset"], own), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})
    release()


def packed(docs: DataFrame, path: str, pattern: str, window: int = 2048, end: int = 1, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Sequences of `window` tokens in which each source has its target share.

    targets: weights above 0 by source; a source that is not named weighs as many as it has tokens, which is also the default for all.
    A window holds each source's share to within a token a source and, for sources with a share under 16 tokens, a turn of 16.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).  Each
    document is its ids and `end`; each id lies in one piece, and only the last sequence is shorter than the window.  A null or
    empty text is the id `end` alone; a text of any length is encoded whole, in one task.  Null sources share a queue.  Repeated rows are
    packed each, whatever their doc_id; other columns are ignored.  An empty table gives an empty table.
    """
    if any(not 0 < w < float("inf") for w in (targets or {}).values()):
        raise ValueError("targets must be above 0")
    tokens = materialise(tokenised(docs, path, pattern, end).withColumn("uid", F.monotonically_increasing_id()), "tokens", BATCH)
    pieces = schedule(tokens.select("uid", "source", "n"), window, targets)
    lists = pieces.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    return tokens.select("uid", "doc_id", "ids", "n").join(lists, "uid").select("doc_id", "ids", "n", "pieces").mapInArrow(_pieces, _PIECES)
