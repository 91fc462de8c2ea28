"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, by a dictionary of groups.

A text is encoded by both tokenizers.  Where tokens of both end at the same byte, the text is cut into groups; tokens of different groups
never overlap.  A group is its ids, `a1,a2|b1`.  A document keeps its different groups with how often it holds them; the dictionary holds
each group of the corpus once.  Links (pairs of tokens whose bytes overlap) are expanded once for each group of the dictionary and
multiplied by how often the group occurs, or by how many documents hold it, which gives each id pair's count; each group's sums over its
links then go back to the documents by the group's key, the commonest groups by broadcast.

A is byte-level BPE from a .tiktoken file, B a sentencepiece model.  Most texts are cut at single spaces and line ends first, where
no token of either goes across, so each worker encodes a common chunk once.  Chunks next to other white space, and texts in which a
chunk's bytes do not come back, are encoded whole, so both ways give the same tokens.

A null or empty text has no tokens, nor has one whose joined bytes of A or B are not a space and the text (one that holds U+2581, or what B
rewrites): its numbers are 0, its groups ''.  Repeated rows count as often as they occur and have a row each.  An empty table gives
none.  Very long texts are encoded whole; groups may be as long as a text (each link is an overlap, so a group has no more links than
tokens).  Groups of over SHORT characters are known by their SHA-256, and their ids kept beside.  Extra columns are left out.
"""

from __future__ import annotations

import array
import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_hot, materialise

#: Chunks whose groups a worker remembers at most.
REMEMBERED = 300_000
#: Characters of a group that is its own key.
SHORT = 64


class Held(NamedTuple):
    """Groups of a chunk or a text in order: joined by semicolons, one by one, and the tokens of A and B."""

    joined: str
    groups: tuple[str, ...]
    n_a: int
    n_b: int


class Aligner:
    """Groups of texts, `a1,a2|b1` each, and the lengths in bytes of the tokens."""

    def __init__(self, a_path: str, a_pattern: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(t): int(k) for t, k in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=a_pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        sizes = {k: len(t) for t, k in ranks.items()}
        self.a_size, self.b_size = [sizes.get(k, 0) for k in range(max(sizes) + 1)], [len(t) for t in self.b_bytes]
        plain = [p for k, p in enumerate(pieces) if not (self.model.is_control(k) or self.model.is_byte(k) or self.model.is_unknown(k))]
        # pieces begin at a space and have none after another character, and none holds a line end: chunks can be encoded apart
        self.apart = "▁" in plain and not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)
        self.space = self.model.piece_to_id("▁")
        self.known: dict[str, Held | None] = {}

    def cut(self, a: list[int], b: list[int]) -> Held:
        """The groups of the tokens of one text or chunk."""
        out, a_size, b_size, n, m = [], self.a_size, self.b_size, len(a), len(b)
        i = j = p = q = 0
        while i < n:
            x, y = a_size[a[i]], b_size[b[j]]
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    x, i = x + a_size[a[i]], i + 1
                else:
                    y, j = y + b_size[b[j]], j + 1
            out.append(f"{a[p]}|{b[q]}" if i - p == 1 == j - q else f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
            p, q = i, j
        return Held(";".join(out), tuple(out), n, m)

    def whole(self, text: str) -> Held:
        """The groups of a space and the text; none if the tokens' bytes are not that."""
        given = " " + text
        b = self.model.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != given.encode():
            return Held("", (), 0, 0)
        return self.cut(self.a(given), b)

    def _encoded(self, chunks: list[str]) -> Iterator[tuple[str, Held | None]]:
        """Each chunk, without the space before it or with its line end, and its groups; None if it has to be seen in its text."""
        for chunk, b in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True):
            line = chunk[:1] == "\n"
            body = chunk[1:] if line else chunk
            given = chunk if line else " " + chunk
            b = b[1:] if line and b[:1] == [self.space] else b
            safe = body and not body[0].isspace() and not body[-1].isspace() and b"".join(map(self.b_bytes.__getitem__, b)) == given.encode()
            yield chunk, self.cut(self.a(given), b) if safe else None

    def counted(self, texts: list[str | None]) -> Iterator[tuple[Held, Counter]]:
        """The groups of each text, and how often it has each."""
        cuts = [text.replace("\n", " \n").split(" ") if text and self.apart else [""] for text in texts]
        known = self.known
        new = list(set().union(*cuts).difference(known))
        known.update(self._encoded(new))
        for text, chunks in zip(texts, cuts, strict=True):
            # a line end at the very start would follow the space that A sees before the text
            held = list(map(known.__getitem__, chunks)) if chunks[0] else [None]
            if None in held:
                whole = self.whole(text) if text else Held("", (), 0, 0)
                yield whole, Counter(whole.groups)
            else:
                joined, groups, n_a, n_b = zip(*held, strict=True)
                yield Held(";".join(joined), (), sum(n_a), sum(n_b)), Counter(chain.from_iterable(groups))
        spare = max(0, REMEMBERED - (len(known) - len(new)))
        for c in [c for k, c in enumerate(new) if k >= spare or len(c) >= 40]:
            del known[c]

    def links(self, group: str) -> Counter:
        """How many links of a group hold each pair of ids."""
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        a_end, b_end = list(accumulate(self.a_size[x] for x in a)), list(accumulate(self.b_size[x] for x in b))
        out, i, j = Counter(), 0, 0
        while i < len(a) and j < len(b):
            out[a[i], b[j]] += 1
            p, q = a_end[i], b_end[j]
            i, j = i + (p <= q), j + (q <= p)
        return out


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some rows, of `most` bytes of text or one row."""
    at, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
        if k > at and held + n > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


_DOCS = "doc_id long, uid long, n_a long, n_b long, n_groups long, groups_sha256 string, held array<struct<key:string,n:long,ids:string>>"


def grouped(docs: DataFrame, *paths: str) -> DataFrame:
    """Each document with its numbers of tokens and groups, the digest of its groups in order, and its different groups with their numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
            ("held", pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64()), ("ids", pa.string())])))])
        for batch in batches:
            for b in _slices(batch):
                sizes, digests, keys, times, ids, starts = [], [], [], [], [], [0]
                for held, counts in own.counted(b.column("text").to_pylist()):
                    for g in counts:
                        short = len(g) <= SHORT
                        keys.append(g if short else hashlib.sha256(g.encode()).hexdigest())
                        ids.append(None if short else g)
                    times.extend(counts.values())
                    starts.append(len(keys))
                    sizes.append((held.n_a, held.n_b, counts.total()))
                    digests.append(hashlib.sha256(held.joined.encode()).hexdigest() if held.joined else "")
                groups = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64()), pa.array(ids, pa.string())], ["key", "n", "ids"])
                n_a, n_b, n_groups = (pa.array(array.array("q", c)) for c in zip(*sizes, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), n_a, n_b, n_groups, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), groups)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, _DOCS)


def dictionary(encoded: DataFrame) -> DataFrame:
    """Each group of the corpus once: key, ids, how often it occurs (n) and how many documents hold it (docs)."""
    held = encoded.select(F.explode("held").alias("g"))
    return held.groupBy("g.key").agg(F.sum("g.n").alias("n"), F.count("*").alias("docs"), F.max("g.ids").alias("ids")).select("key", F.coalesce("ids", "key").alias("ids"), "n", "docs")


def group_links(groups: DataFrame, *paths: str) -> DataFrame:
    """The links of each group of the dictionary: key, a, b, and how many links hold the pair (times), with the group's n and docs."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                pairs = [own.links(g) for g in b.column("ids").to_pylist()]
                row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
                flat = np.array([(x, y, n) for p in pairs for (x, y), n in p.items()], np.int64).reshape(-1, 3)
                kept = b.take(pa.array(row))
                yield pa.RecordBatch.from_pydict({"key": kept.column("key"), "a": pa.array(flat[:, 0].astype(np.int32)), "b": pa.array(flat[:, 1].astype(np.int32)), "times": pa.array(flat[:, 2]), "n": kept.column("n"), "docs": kept.column("docs")})

    return groups.select("key", "ids", "n", "docs").mapInArrow(expand, "key string, a int, b int, times long, n long, docs long")


def pair_counts(links: DataFrame, by: str = "n") -> DataFrame:
    """The count of each id pair (a, b): its links over the corpus, or with by="docs" those of each document's different groups.

    best: whether no pair of the same b counts more.  held: how many groups of the dictionary hold the pair.
    """
    counts = links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col(by)).alias("count"), F.count("*").alias("held"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    # one row for each id of B: its vocabulary bounds the broadcast
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"), "held")


def aligned(docs: DataFrame, *paths: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    paths: the .tiktoken file of A, its split pattern, and the model of B.  n_best: links whose pair's count is the highest of its b,
    ties included; count_sum: the sum of the counts over the document's links.
    """
    encoded = materialise(grouped(docs, *paths), "encoded")
    groups = materialise(dictionary(encoded), "groups")
    links = materialise(group_links(groups, *paths), "links")
    pairs = materialise(pair_counts(links), "pairs")
    sums = joined_hot(links.drop("n"), pairs, ["a", "b"], "held").groupBy("key").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.max("docs").alias("docs"),
    )
    of_groups = materialise(sums, "sums")
    for spent in (groups, links, pairs):
        discard(spent)
    held = encoded.select("uid", F.inline("held")).drop("ids")
    back = joined_hot(held, of_groups, ["key"], "docs")
    per_doc = back.groupBy("uid").agg(*(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("n_links", "n_best", "count_sum")))
    out = encoded.select("doc_id", "uid", "n_a", "n_b", "n_groups", "groups_sha256").join(per_doc, "uid", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", *numbers, "groups_sha256")
