"""Repeated byte strings against brute force: periods, buffers of few bytes, ties between anchors, and edge rows."""

import collections
import hashlib
import random
import time

import pytest

from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import remove_repeats


def brute(rows, n):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[p : p + n] for _, b in data for p in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, n, q):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = remove_repeats(docs, n, q).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [64, 200, 1 << 20])
def test_brute(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [word(60) for _ in range(4)]
    rows = [(i, word(rng.randint(0, 40)) + rng.choice(shared)[rng.randint(0, 25) :] + word(rng.randint(0, 90))) for i in range(25)]
    for k, period in enumerate(("x", "ab", "abcde", word(17), word(45))):
        rows.append((100 + k, word(5) + period * rng.randint(2, 200 // len(period)) + word(5)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (3, rows[3][1]), (202, "x" * 150), (203, "x" * 29), (204, "x" * 30)]
    assert got(spark, rows, 30, 8) == brute(rows, 30)


def test_equal_windows_choose_equal_anchors(spark, monkeypatch):
    # few bits of hash are left to tell q-grams apart, so ties between different ones are common
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 62)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [word(50) for _ in range(5)]
    rows = [(i, word(rng.randint(0, 300)) + rng.choice(shared) + word(rng.randint(0, 30))) for i in range(40)]
    assert got(spark, rows, 40, 8) == brute(rows, 40)


def test_one_character(spark):
    # a text with a period takes neither a run nor a struct for each byte
    rows = [(1, "-" * 6_000_000), (2, "word " * 1_000_000), (3, "clean text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    began = time.time()
    out = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert (out[1].n_removed, out[1].n_spans, out[2].n_removed, out[2].n_spans, out[3].n_removed) == (6_000_000, 1, 5_000_000, 1, 0)
    assert suffix_dedup.repeated_runs(docs.withColumn("tk", suffix_dedup.text_key())).count() < 200
    assert time.time() - began < 240


def test_clashing_columns(spark):
    names = ["tk", "a", "lo", "hi", "bucket", "span", "n", "runs", "n_bytes", "spans", "kept", "class", "todo", "row"]
    text = "".join(chr(97 + i % 23) for i in range(300))
    rows = [(i, text if i % 2 else str(i), *range(len(names))) for i in range(6)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in out) == [(i, 300 if i % 2 else 1, 300 if i % 2 else 0) for i in range(6)]
