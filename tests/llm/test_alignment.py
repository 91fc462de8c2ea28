"""Aligned tokens against both tokenizers' own ids and every pair of a text's tokens."""

import collections
import hashlib
import itertools
import random

import public_tokenizers
import pytest

from tessera.llm import alignment, common, queries
from tessera.llm.alignment import aligned, aligner, dictionary, group_links, grouped, pair_counts

PATHS = (*queries.vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))
SPACES = ["", " ", " ", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\xa0", "　", "\x85", "\x00"]
BITS = ["don't", "I'LL", "a1b2", "...", "naïve", "日本語", "é", "🙂", "١٢٣", "x" * 50, "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "_", "​", "the", "of", "tion", "ﬁ"]


def reference():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])

    def tokens(text):
        if not text:
            return [], []
        left = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
        want = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == want == b"".join(t for _, t in right) else ([], [])

    return tokens


def spans(tokens):
    ends = [0, *itertools.accumulate(len(t) for _, t in tokens)]
    return [(k, x, y) for (k, _), x, y in zip(tokens, ends, ends[1:], strict=False)]


def brute(texts):
    tokens = reference()
    docs, counts = [], collections.Counter()
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(i, j) for i, x, y in a for j, p, q in b if x < q and p < y]
        counts.update(links)
        both = sorted({y for *_, y in a} & {y for *_, y in b})
        groups = [f"{','.join(str(i) for i, x, y in a if lo < y <= hi)}|{','.join(str(i) for i, x, y in b if lo < y <= hi)}" for lo, hi in zip([0, *both], both, strict=False)]
        docs.append((a, b, groups, links))
    top = collections.defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (len(a), len(b), len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, links in docs
    ], counts


def nasty(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) + rng.choice(SPACES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("remembered", "short", "hot"), [(300_000, 64, 1 << 14), (5, 8, 20)])
def test_aligned(spark, monkeypatch, remembered, short, hot):
    for module, name, value in ((alignment, "REMEMBERED", remembered), (alignment, "SHORT", short), (common, "HOT", hot)):
        monkeypatch.setattr(module, name, value)
    texts = [None, "", " ", "\n", "\nstart", "a▁b", "the", *["the of the"] * 30, " lead", "trail  ", *nasty(220, 1), "日本語" * 300, "q" * 3000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(8).collect() if len(r.text or "") < 3000]
    want, _ = brute(texts)
    docs = spark.createDataFrame([(k if k % 9 else None, t, "key", 5) for k, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(3)
    got = aligned(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((k if k % 9 else None, *w) for k, w in enumerate(want)), key=repr)


def test_pair_counts(spark):
    texts = ["the of naïve", "the the 日本語", *nasty(40, 2), "the of naïve"]
    _, counts = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = grouped(docs, *PATHS)
    links = group_links(dictionary(encoded), *PATHS)
    assert {(r.a, r.b): r["count"] for r in pair_counts(links).collect()} == counts
    # by documents a group counts once in each
    own = aligner(*PATHS)
    want = collections.Counter()
    for _, groups in own.counted(texts):
        for g in groups:
            want.update(own.links(g))
    assert {(r.a, r.b): r["count"] for r in pair_counts(links, "docs").collect()} == want


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "the " * 200_000), (2, "x" * 200_000)], "doc_id long, text string")
    assert aligned(docs.where("false"), *PATHS).count() == 0
    rows = {r.doc_id: r for r in aligned(docs, *PATHS).collect()}
    assert rows[1].n_links >= 200_000 and rows[2].n_a > 0
