"""The schedule of pieces against what each source is due, many small sources, targets, and edge rows."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, packing, queries
from tessera.llm.packing import packed, schedule


def shares(sizes, window, targets=None, least=16):
    """Queues, tokens, quanta and rounds between turns of the sources, in plain Python."""
    queues = collections.defaultdict(list)
    for uid, source, n in sorted(sizes, key=lambda x: (x[1] is None, x[1] or "", x[0])):
        queues[source].append((uid, n))
    tokens = {s: sum(n for _, n in q) for s, q in queues.items()}
    share = {s: (targets or {}).get(s, tokens[s]) for s in queues}
    quantum = {s: window * share[s] / sum(share.values()) for s in queues}
    return queues, tokens, quantum, {s: max(1, math.ceil(least / quantum[s])) for s in queues}


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 1.0, None: 2.0, "c": 0.001}])
def test_schedule(spark, targets):
    rng = np.random.default_rng(3)
    sizes = [(i, ["a", "b", None, "c"][min(3, i % 9)] if i % 50 else "c", int(rng.integers(1, 400))) for i in range(300)]
    window = 256
    got = schedule(spark.createDataFrame(sizes, "uid long, source string, n long"), window, targets).collect()
    n = {u: k for u, _, k in sizes}
    source = {u: s for u, s, _ in sizes}
    cover, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.length > 0
        cover[r.uid].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.uid, r.start))
    for u, pieces in cover.items():
        at = 0
        for s, k in sorted(pieces):
            assert s == at
            at += k
        assert at == n[u]
    assert set(cover) == set(n)
    assert sorted(sequences) == list(range(len(sequences)))
    order = []
    for k in sorted(sequences):
        at = 0
        for o, length, u, s in sorted(sequences[k]):
            assert o == at
            at += length
            order.append((u, s, length))
        assert at == window or k == len(sequences) - 1
    # each source's tokens come in the order of its queue, and while all queues last each is sent by its target
    queues, tokens, quantum, every = shares(sizes, window, targets)
    sent, place = collections.Counter(), {s: iter([(u, i) for u, k in q for i in range(k)]) for s, q in queues.items()}
    total = 0
    dry = min(tokens[s] / quantum[s] for s in queues) * window
    for u, s, length in order:
        for i in range(length):
            assert next(place[source[u]]) == (u, s + i)
        sent[source[u]] += length
        total += length
        if total < dry * 0.95:
            for x in queues:
                assert abs(sent[x] - total * quantum[x] / window) <= 2 * quantum[x] * every[x] + window * 0.25 + 2, (x, sent[x], total)


def test_many_small_sources_make_few_pieces(spark):
    sizes = spark.range(3000).select(F.col("id").alias("uid"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(7).cast("long").alias("n"))
    pieces = schedule(sizes, 2048)
    assert pieces.count() <= 3000 + 11  # one each, and the cuts between sequences


def test_edges(spark):
    long = "word " * 200_000
    rows = [(1, None, None, 1), (1, None, None, 1), (2, "", "a", 2), (3, long, "a", 3), (None, "x y", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, uid int").withColumn("n", F.lit("clash")).withColumn("ids", F.lit(0))
    got = packed(docs, *queries.vocabulary()).collect()
    sums = collections.Counter()
    for r in got:
        sums[r.doc_id] += r.length
    size = next(r.doc_tokens for r in got if r.doc_id == 3)
    assert sums == {1: 2, 2: 1, 3: size, None: 3} and size > 200_000
    assert max(r.sequence_id for r in got) == (sum(sums.values()) - 1) // 2048
    with pytest.raises(ValueError, match="above 0"):
        packed(docs, *queries.vocabulary(), targets={"a": 0.0})


def test_workers_forget_the_encoder():
    """What is remembered for encoding counted against each later stage of a pipeline, as workers are kept."""
    packing._encoder(*queries.vocabulary())
    assert common.KEPT
    assert not list(packing._pieces(iter([]))) and not common.KEPT


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    seen = []
    real = packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, label, *batch: seen.append((label, *batch)) or real(df, label, *batch))
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("abcdefghi "), 200).alias("text"))
    packed(docs.limit(3), *queries.vocabulary())
    assert seen[0] == ("tokens", packing.BATCH)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows]), "bytes": pa.array([b.nbytes])})

    before = spark.conf.get(common._BATCH)
    got = common.materialise(docs.select("text").mapInArrow(sizes, "rows long, bytes long"), "sizes", 1 << 20).collect()
    assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 3 << 19 and spark.conf.get(common._BATCH) == before


def test_pieces_go_out_in_parts():
    n = 1201
    ids = [bytes(range(2 * (i % 5 + 1))) for i in range(n)]
    pieces = [[{"start": 0, "length": len(x) // 2, "sequence_id": i, "offset": 0}] for i, x in enumerate(ids)]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "sequence_id", "offset")]))
    given = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "ids": pa.array(ids, pa.binary()), "n": pa.array([len(x) // 2 for x in ids], pa.int64()), "pieces": pa.array(pieces, kind)})
    out = list(packing._pieces(iter([given])))
    assert [b.num_rows for b in out] == [500, 500, 201]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(n)) and all(r["ids"] == np.frombuffer(x, "<u2").astype("<u4").tobytes() for r, x in zip(rows, ids, strict=True))
