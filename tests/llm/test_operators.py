"""Operators against brute force on small fixtures with nulls, empty texts, repeats and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm import pii, similar
from tessera.llm.ann import nearest
from tessera.llm.embedding_dedup import near_vectors
from tessera.llm.mixing import mixed
from tessera.llm.sharding import shuffled_shards
from tessera.llm.simhash import fingerprint, near_groups, one_of_each
from tessera.llm.suffix_dedup import remove_repeats


def brute_repeats(rows, n):
    count = collections.Counter(b[p : p + n] for _, b in rows for p in range(len(b) - n + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    shared = [word(80) for _ in range(3)]
    rows = [(i, word(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 30) :] + word(20)) for i in range(30)]
    rows += [(30, "x" * 200), (31, None), (32, ""), (None, rows[4][1]), (4, rows[4][1])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 12)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows], 40)


def test_simhash(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(5)]
    rows = [(i, base[i % 5] + " " + " ".join(rng.choices(words, k=rng.randint(0, 2)))) for i in range(40)] + [(40, None), (41, ""), (42, " \t")]
    fp = {i: fingerprint(t) for i, t in rows}
    label = {i: i for i in fp}
    for _ in fp:
        label = {i: min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3) for i in fp}
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", label[i]) for i in fp}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x[30:50] = x[:20] + 0.05 * rng.standard_normal((20, 8))
    x[50:] = x[3]
    label = [int(v) for v in np.arange(60) % 2]
    rows = [(i, [float(c) for c in v], y) for i, (v, y) in enumerate(zip(x, label, strict=True))] + [(60, None, 1), (61, [0.0] * 8, 1), (62, [float("nan")] * 8, 1), (63, [1.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    assert len(got) == 64 and [got[i].n_links for i in range(60)] == link.sum(1).tolist() and got[61].n_links == 0 and got[61].kept
    found = collections.defaultdict(list)
    for r in nearest(table, table.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    for q in (0, 20, 40):
        s = x @ x[q]
        assert found[q] == [i for i in sorted(range(60), key=lambda i: (-round(s[i], 9), i)) if i != q][:5]


def test_mixing_and_sharding(spark):
    rows = [(i, "a b c" if i % 3 else None, "s%d" % (i % 4) if i % 5 else None, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixed(docs).toPandas()
    assert len(out) == 200 and (out.taken <= 2 * out["size"]).all() and "size_in" in out
    sums = out.fillna({"source": "-"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 3).all()
    placed = shuffled_shards(docs, 7, bucket_bytes=300).toPandas()
    counts = placed.groupby("shard").slot.agg(["count", "max"])
    assert len(placed) == 200 and counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all()


def test_clashing_columns(spark):
    names = ["Size", "size_in", "source_", "Taken", "shard", "slot", "fp", "component_id", "n_bytes", "uid", "u", "v", "node", "root", "n"]
    rows = [(i % 6, "a b c d " * (i % 3) or None, "s" if i % 2 else None, *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    out = mixed(docs)
    assert out.count() == 12 and {"Size_in_in", "size_in", "Taken_in", "source_", "size", "taken"} <= set(out.columns)
    out = shuffled_shards(docs, 5)
    assert out.count() == 12 and {"Size_in_in", "shard_in", "slot_in", "shard"} <= set(out.columns)
    assert near_groups(docs).count() == 12 and remove_repeats(docs).count() == 12
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [0, 1, 2]


def test_vectors_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([], kind)
    assert near_vectors(none).count() == 0 and nearest(none, none).count() == 0
    # equal vectors: all linked, and ties go to the smaller vec_id
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(30)] + [(40, [1.0, None], 0), (60, [], 0)], kind)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(same).collect()}
    assert got == {i: (29, 0, i == 0) for i in range(30)} | {40: (0, 40, True), 60: (0, 60, True)}
    rows = nearest(same, same.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in rows] == [*range(1, 21), *range(20)] and {r.score for r in rows} == {5.0}


@pytest.mark.parametrize("f", [lambda d: remove_repeats(d), lambda d: near_groups(d), lambda d: mixed(d), lambda d: shuffled_shards(d)])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_personal_data():
    text = "mail a.b@c.de, call +1 (626) 555-5759 or 4111 1111 1111 1111 at 1.2.3.4 not 1.2.3.444"
    assert [text[s:e] for _, s, e in pii.base_spans(text)] == ["a.b@c.de", "+1 (626) 555-5759", "4111 1111 1111 1111", "1.2.3.4"]


def test_one_of_each_row(spark):
    rng = random.Random(7)
    a, b = (" ".join(rng.choices([f"w{k}" for k in range(90)], k=60)) for _ in range(2))
    c, d = (" ".join(rng.choices([f"v{k}" for k in range(90)], k=60)) for _ in range(2))
    # doc_id 5 holds a text of its own and a copy of 3; rows without doc_id copy 3 or each other
    rows = [(3, a), (5, b), (5, a), (7, c), (7, c), (None, a), (None, d), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(3, a), (5, b), (7, c), (None, d)], key=repr)
    assert sorted(map(tuple, one_of_each(docs).collect()), key=repr) == want


def words_of(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def one_of_each_brute(rows):
    """Of rows (doc_id, text) one of each group by five-word shingles and similarity 0.8, all pairs compared."""
    sets = [words_of(t) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j in label if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in label]
    while (new := [min(label[j] for j in near[i]) for i in range(len(rows))]) != label:
        label = new
    return sorted((min((r for r, k in zip(rows, label, strict=True) if k == own), key=lambda r: (r[0] is None, r[0] or 0)) for own in set(label)), key=repr)


def test_similar(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda n: rng.choices([f"w{k}" for k in range(400)], k=n)
    rows = []
    for _ in range(6):
        base = word(rng.choice([12, 60, 200]))
        for share in (0.0, 0.0, 0.01, 0.02, 0.03, 0.04, 0.06):
            rows.append(" ".join(w if rng.random() >= share else "x" + w for w in base))
        rows.append(" ".join(base[: len(base) * 5 // 6]))
    rows += [None, "", " \t", "one two", "ONE  two", "one two three", " ".join(word(100))]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = one_of_each_brute(rows)
    assert 12 < len(want) < len(rows) - 12
    for block in (similar.BLOCK, 3):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = sorted(((r.doc_id, r.text) for r in similar.one_of_similar(docs).collect()), key=repr)
        assert [i for i, _ in got] == [i for i, _ in want]
