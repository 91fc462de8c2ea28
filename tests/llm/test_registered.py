"""Registered queries and the pipeline's stages against SQL, exact round trips, plain Python or held-out accuracy."""

import collections
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import pii, queries, toxicity
from tessera.llm.packing import Encoder, packed
from tessera.llm.preferences import preference_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

SPACES = ["", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", " ", "　", "\x85", "\x1c", "\x00", "﻿"]
BITS = ["don't", "I'LL", "a1b2", "...", "!?", "naïve", "日本語", "é", "🙂", "١٢٣", "x" * 50, "<|end|>", "_", "​"]


def words_of(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def nasty(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SPACES) + rng.choice(BITS) + rng.choice(SPACES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_encoder():
    ids, encoder = reference_ids(), Encoder(*queries.vocabulary())
    for text in ["", " ", "\n", *nasty(3000)]:
        assert np.frombuffer(encoder.ids(text), "<u2").tolist() == ids(text), repr(text)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    more = [(10**6 + i, t, [None, "a", "b"][i % 3], i) for i, t in enumerate([None, "", *nasty(40)])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string, n int").drop("n"))
    ids = reference_ids()
    want = {r.doc_id: [*ids(r.text or ""), 1] for r in docs.collect()}
    rows = packed(docs, *queries.vocabulary()).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, own))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sum((ids for _, ids in sorted(p)), []) for d, p in pieces.items()} == want
    for k, s in sequences.items():
        ends = [0, *np.cumsum([n for _, n in sorted(s)]).tolist()]
        assert [at for at, _ in sorted(s)] == ends[:-1]
        assert ends[-1] == 2048 or k == max(sequences)
    # each full window holds each source's share, to within a token a source
    source = {r.doc_id: r.source for r in docs.collect()}
    total = sum(map(len, want.values()))
    share = collections.Counter()
    for d, t in want.items():
        share[source[d]] += 2048 * len(t) / total
    for k in list(sequences)[:5]:
        got = collections.Counter()
        for r in rows:
            if r.sequence_id == k:
                got[source[r.doc_id]] += r.length
        assert k == max(sequences) or all(abs(got[s] - q) <= len(share) + 1 for s, q in share.items())


def test_preferences_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.op9_preference_rows(spark, SF)
    want = c.sql(queries.ORACLES["op9_preference_rows"]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


def test_preferences_edges(spark):
    kind = "pair_id long, turn long, role string, text string, n_common string"
    same = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x")]
    c = spark.createDataFrame([*same, (2, 0, None, None, ""), (2, 1, "assistant", "é🙂", ""), (3, 0, "user", "alone", ""), (None, 0, "user", "q", "")], kind)
    r = spark.createDataFrame([*same, (2, 0, "", "", ""), (4, 0, "user", "alone", "")], kind)
    got = {x.pair_id: x for x in preference_rows(c, r).collect()}
    assert sorted(got) == [1, 2] and (got[1].n_common, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (2, "", "", "")
    assert (got[2].n_common, got[2].prompt, got[2].rejected) == (1, "<||>\n<|end|>\n", "")
    low, high = map(int, got[2].chosen_mask.split(":"))
    assert got[2].chosen[low:high] == "é🙂<|end|>\n"
    assert preference_rows(c.where("false"), r).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    rows = queries.op3_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    count = collections.Counter(known)
    assert count[1, 1] / (count[1, 1] + count[1, 0]) > 0.85 and count[0, 1] / (count[0, 1] + count[0, 0]) < 0.03, count


def test_toxicity_learns_nothing_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_edge_rows(spark):
    odd = spark.createDataFrame([(1, None, 5.0, "x"), (1, "", 1.0, "y"), (None, " \n", None, "z"), (2, "Mail a.b@c.de " * 3, 2.0, None)], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.scored(odd, toxicity.train(odd, labels)).collect()
    assert len(out) == 4 and {r.predicted for r in out} == {0} and {r.predicted_in for r in out} == {"x", "y", "z", None}
    model = pii.train(odd)
    found = pii.found_spans(odd, model).collect()
    assert sorted((r.n_email, r.spans.count("email")) for r in found) == [(0, 0)] * 3 + [(3, 3)]
    assert {r.text for r in pii.redacted(odd, model).collect()} == {None, "", " \n", "Mail <EMAIL> " * 3}
    none = odd.where("false")
    model = pii.train(none)
    assert pii.found_spans(none, model).count() == 0 and toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    assert packed(none.withColumn("source", toxicity.F.lit("s")), *queries.vocabulary()).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, kept = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert sorted(r for r in kept["toxicity"]) == sorted(r for r in given if model.score(r.text) < 0.5)
    # of each group of similar texts (five-word shingles, 0.8 or more) the document of the smallest id
    sets = {r.doc_id: words_of(r.text) for r in kept["toxicity"]}
    near = {i: [j for j in sets if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in sets}
    label = {i: i for i in sets}
    while (new := {i: min(label[j] for j in near[i]) for i in sets}) != label:
        label = new
    assert sorted(r for r in kept["simhash_dedup"]) == sorted(r for r in kept["toxicity"] if label[r.doc_id] == r.doc_id)
    before, after = {r.doc_id: r for r in kept["simhash_dedup"]}, {r.doc_id: r for r in kept["pii"]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) and (r.text == before[i].text) == (not pii.base_spans(before[i].text))
    times = collections.Counter(r.doc_id for r in kept["mixing"])
    assert set(times.values()) <= {1, 2} and all(tuple(r) == tuple(after[r.doc_id]) for r in kept["mixing"])
    ids = reference_ids()
    want = collections.Counter({i: n * (len(ids(after[i].text)) + 1) for i, n in times.items()})
    got = collections.Counter()
    for r in kept["packing"]:
        got[r.doc_id] += r.length
    assert got == want


def test_encoder_added_tokens():
    ids, encoder = reference_ids(), Encoder(*queries.vocabulary())
    assert np.frombuffer(encoder.ids("hello <|endoftext|> world"), "<u2").tolist() == [31373, 220, 50256, 995]
    rng, end = random.Random(2), "<|endoftext|>"
    for text in [end, end * 2, f" {end}\n", "<|endoftext|", f"<{end}>", f"a{end}b", *(rng.choice(["", " ", "\n"]).join([a, end, b]) for a, b in zip(nasty(1000), nasty(1000, 3), strict=True))]:
        assert np.frombuffer(encoder.ids(text), "<u2").tolist() == ids(text), repr(text)


def test_near_copies_stage(spark):
    # five-word shingles, Jaccard similarity of 0.8 or more, all pairs compared
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = sorted(docs.collect())
    words = [(r.text or "").lower().split() for r in given]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]
    label = list(range(len(given)))
    near = [[j for j in label if 10 * len(a & sets[j]) >= 8 * len(a | sets[j])] for a in sets]
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(kept) == [r for i, r in enumerate(given) if label[i] == i]
