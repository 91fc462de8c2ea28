"""Removal of repeated byte strings by bucket-pointer refinement.

A window is a byte string of `length` bytes that starts somewhere in a document.  The job is to find every
window whose bytes also start somewhere else.  Suffixes are sorted only as deep as `length`, and only as far
as it takes to tell whether a bucket holds one window or more:

* Initial buckets: of the q-grams in a window the one with the smallest hash is its anchor, so equal windows
  have equal anchors at equal offsets.  Windows next to each other mostly share their anchor; such a run is one
  pointer, filed in the bucket of the anchor's q-gram (about 1 pointer for each 80 bytes).  Runs of one buffer
  that are the same, as in texts with a period, are repeats already: one of them goes on, with their number, and
  the places of all are noted, neighbouring ones as one.
* Refinement: a bucket with one pointer is finished.  In the others pointers are sorted on the identifier of
  the string which their run covers, at the offsets after and before the anchor.  A run whose identifier occurs
  again is repeated as a whole.  Any other run in a bucket with several identifiers is cut into smaller runs,
  each filed under the bucket of the bytes that its windows share, and the refinement is applied to them
  again, down to single windows.  The identifiers found at one level name the buckets of the next, and a string that
  occurs many times goes on as one representative.

Identifiers are hashes of the bytes, so equal strings get equal identifiers on all executors, and each
level is an aggregation that combines before its shuffle: no bucket is ever gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_key

#: Windows that a run of the second level holds at most.
STEP = 16
#: Windows taken at a time; a longer document is cut, and runs end at the cut.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bits of a place in a buffer of CHUNK bytes and a window.
_PLACE_BITS = CHUNK.bit_length() + 1


class _Tables:
    """Powers of the base of the rolling hash, made once in each worker."""

    def __init__(self, n: int):
        def powers(base: int) -> np.ndarray:
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)  # modulo 2**64

        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        self.values = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int, q: int, tables: _Tables) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in a buffer of several texts.

    Returns for each run the text's number, the first and last window, the anchor (places in the buffer) and the
    hash of the anchor's q-gram.
    """
    buf = np.frombuffer(data, np.uint8)
    n, w = len(buf), length - q + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tables.values[buf] * tables.up[:n], out=sums[1:])
        grams = _mix((sums[q:] - sums[:-q]) * tables.down[: n - q + 1])
    bits = np.uint64(_PLACE_BITS)  # the same for all buffers, else equal windows could choose different anchors
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # for each window its anchor
    count = np.maximum(0, ends - starts - length + 1)
    text = np.repeat(np.arange(len(starts)), count)
    first = np.cumsum(count) - count
    window = np.arange(len(text)) - first[text] + starts[text]
    if not len(window):
        return none, none, none, none, none.astype(np.uint64)
    own = at[window]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(own)]]) - 1
    return text[new], window[new], window[last], own[new], grams[own[new]]


def _signed(h: np.ndarray | list[int]) -> np.ndarray:
    return np.asarray(h, dtype=np.uint64).view(np.int64)


def _alike(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of the runs of a buffer the first of each kind, how many there are of it, and the places (row, lo, hi) of the kinds with several.

    Runs come ordered by place; places that touch are one.
    """
    order = np.lexsort((span, gram))
    new = np.concatenate([[True], (gram[order[1:]] != gram[order[:-1]]) | (span[order[1:]] != span[order[:-1]])])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(order)]]))
    several = np.sort(order[np.repeat(n, n) > 1])
    row, low, high = rows[several], lo[several], hi[several]
    if len(several):
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] > high[:-1] + 1)]))
        row, low, high = row[start], low[start], np.maximum.reduceat(high, start)
    first = order[at]  # the sort keeps the order of equal runs
    return first, n, (row, low, high)


def _first_level(length: int, q: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(CHUNK + length)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, keys, texts = batch.column("doc_id"), batch.column("tk"), batch.column("text")
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0))
            pieces: list[tuple[int, int, bytes]] = []  # row, place in the text, bytes
            held = 0

            def flush():
                data = b"".join(p[2] for p in pieces)
                ends = np.cumsum([len(p[2]) for p in pieces])
                starts = ends - np.array([len(p[2]) for p in pieces])
                t, lo, hi, a, gram = anchors(data, starts, ends, length, q, tables)
                if not len(t):
                    return
                rows = np.array([p[0] for p in pieces])[t]
                shift = (np.array([p[1] for p in pieces]) - starts)[t]
                span = np.array([digest(data[x : y + length], seed=s) for x, y, s in zip(lo.tolist(), hi.tolist(), ((a - lo) << 16 | (a - hi)).tolist(), strict=True)], np.uint64)
                a, lo, hi = a + shift, lo + shift, hi + shift
                first, n, (row, low, high) = _alike(rows, lo, hi, gram, span)
                first, n = first[order := np.argsort(first)], n[order]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.take(pa.array(rows[first])), "tk": keys.take(pa.array(rows[first])), "a": pa.array(a[first]), "lo": pa.array(lo[first]), "hi": pa.array(hi[first]),
                    "bucket": pa.array(_signed(gram[first])), "span": pa.array(_signed(span[first])), "n": pa.array(n, pa.int64()),
                })
                if len(row):
                    none = pa.nulls(len(row), pa.int64())
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(row)), "tk": keys.take(pa.array(row)), "a": none, "lo": pa.array(low), "hi": pa.array(high), "bucket": none, "span": none, "n": none})

            for row in np.flatnonzero(sizes >= length).tolist():
                data = texts[row].as_py().encode("utf-8")
                for at in range(0, len(data) - length + 1, CHUNK):
                    piece = data[at : at + CHUNK + length - 1]
                    if pieces and held + len(piece) > CHUNK:
                        yield from flush()
                        pieces, held = [], 0
                    pieces.append((row, at, piece))
                    held += len(piece)
            if pieces:
                yield from flush()

    return runs


def _next_level(length: int, step: int):
    """Cuts runs into runs of `step` windows at fixed offsets from the anchor."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "tk", "a", "lo", "hi", "bucket", "span", "class", "n")}
            for doc_id, tk, text, todo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tk", "text", "todo")), strict=True):
                data = (text or "").encode("utf-8")
                for r in todo:
                    a, low, high = r["a"], r["lo"], r["hi"]
                    for k in range((a - high) // step, (a - low) // step + 1):  # offsets from the anchor back to a window
                        lo, hi = max(low, a - k * step - step + 1), min(high, a - k * step)
                        core = data[a - k * step : a - k * step - step + 1 + length]
                        out["doc_id"].append(doc_id)
                        out["tk"].append(tk)
                        out["a"].append(a)
                        out["lo"].append(lo)
                        out["hi"].append(hi)
                        out["bucket"].append(digest(core, seed=(r["bucket"] + k) & (1 << 64) - 1))
                        out["span"].append(digest(data[lo : hi + length], seed=(a - lo) << 16 | (a - hi)))
                        out["class"].append(r["class"])
                        out["n"].append(r["n"])
                if len(out["n"]) > 50_000:
                    yield _batch(out)
                    out = {k: [] for k in out}
            yield _batch(out)

    return runs


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(_signed(v) if k in ("bucket", "span") else v, pa.int64()) for k, v in out.items()})


_RUN = "doc_id long, tk long, a long, lo long, hi long, bucket long, span long"
_PLACE = ["doc_id", "tk", "a", "lo", "hi"]


def _refined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs (bucket, span, class, n, place): the runs that are repeated as a whole, and those to be cut.

    n counts the places of a class, a class being a whole run of the first level.
    """
    spans = rows.groupBy("bucket", "span").agg(
        F.max("n").alias("most"), F.min("class").alias("c0"), F.max("class").alias("c1"), F.min(F.struct(*_PLACE)).alias("place")
    )
    spans = spans.withColumn("whole", (F.col("most") > 1) | (F.col("c0") < F.col("c1")))
    mixed = rows.groupBy("bucket").agg(F.min("span").alias("s0"), F.max("span").alias("s1")).where("s0 < s1").select("bucket")
    return spans, mixed


def _texts_of(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """The texts of the runs to be cut, each with its list of runs (no longer than the text)."""
    lists = todo.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", "lo", "hi", "bucket", "class", "n")).alias("todo"))
    lists = lists.withColumnRenamed("doc_id", "doc_id_").withColumnRenamed("tk", "tk_")
    return docs.join(lists, docs.doc_id.eqNullSafe(lists.doc_id_) & (docs.tk == lists.tk_)).select("doc_id", "tk", "text", "todo")


def repeated_runs(docs: DataFrame, length: int = 200, q: int = 32) -> DataFrame:
    """Rows (doc_id, tk, lo, hi): the windows that start at bytes lo to hi, hi included, occur elsewhere too.

    docs has doc_id, tk (text_key()) and text.  Rows of one document may overlap or repeat.
    """
    first = materialise(docs.mapInArrow(_first_level(length, q), f"{_RUN}, n long"), "anchors")
    found = materialise(first.where("bucket is null").select("doc_id", "tk", "lo", "hi"), "found")
    pointers = first.where("bucket is not null")
    shared = pointers.groupBy("bucket").agg(F.count("*").alias("c"), F.min("span").alias("s0"), F.max("span").alias("s1")).where("c > 1")
    # written first, so that both sides of the join are plain exchanges and a hot bucket can be split
    shared = materialise(shared.select("bucket", (F.col("s0") < F.col("s1")).alias("mixed")), "shared")
    alike = materialise(pointers.join(shared, "bucket"), "alike")
    discard(first)
    discard(shared)
    spans = materialise(alike.groupBy("bucket", "span").agg(F.sum("n").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct(*_PLACE)).alias("place")).where("n > 1 or mixed"), "spans")
    found = found.unionByName(_places(alike, spans.where("n > 1")))
    discard(alike)

    todo = spans.where("mixed").select("place.*", "bucket", F.col("span").alias("class"), F.least("n", F.lit(2)).alias("n"))
    for step in (STEP, 1):
        cut = _texts_of(docs, todo).mapInArrow(_next_level(length, step), f"{_RUN}, class long, n long")
        cut = materialise(cut, "cut")
        discard(spans)
        spans, mixed = _refined(cut)
        spans = materialise(spans, "spans")
        found = found.unionByName(_places(cut, spans.where("whole")))
        if step > 1:  # of each string one representative goes on; it stands for all of its places
            mixed = materialise(mixed, "mixed")
            todo = spans.join(mixed, "bucket", "left_semi").select("place.*", "bucket", F.xxhash64("bucket", "span", "c0", "c1").alias("class"), F.when(F.col("whole"), 2).otherwise(1).cast("long").alias("n"))
        discard(cut)
    discard(spans)
    return found


def _places(runs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The places of the runs whose bucket and span are repeated."""
    return materialise(runs.join(repeated.select("bucket", "span"), ["bucket", "span"], "left_semi").select("doc_id", "tk", "lo", "hi"), "found")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"


def _removed(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                data = (text or "").encode("utf-8")
                merged: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi + length)
                    else:
                        merged.append([lo, hi + length])
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(data[at:lo])
                    at = hi
                rest = b"".join([*kept, data[at:]])
                for k, v in zip(out, (doc_id, len(data), len(data) - len(rest), len(merged), [{"start": x, "end": y} for x, y in merged], rest, hashlib.sha256(rest).hexdigest()), strict=True):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return cut


def remove_repeats(docs: DataFrame, length: int = 200, q: int = 32) -> DataFrame:
    """Each document without the bytes covered by a string of `length` bytes that also starts elsewhere in docs.

    Rows: doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges), kept (the remaining bytes),
    kept_sha256.  A null text is empty.  A row that is repeated counts as two documents, so a text of `length`
    bytes or more that occurs in two rows goes from both; shorter texts stay.  doc_id may be null.  Other columns
    are ignored.  An empty table gives an empty table.
    """
    if not 0 < q < length < 1 << 16:
        raise ValueError("q must be under length, and length under 65536")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key())
    # a run that the next one in the document overlaps adds nothing; lists are no longer than the text
    runs = repeated_runs(docs, length, q).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = runs.withColumnRenamed("doc_id", "doc_id_").withColumnRenamed("tk", "tk_")
    joined = docs.join(runs, docs.doc_id.eqNullSafe(runs.doc_id_) & (docs.tk == runs.tk_), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_removed(length), _OUT)
