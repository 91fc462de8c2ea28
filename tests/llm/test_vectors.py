"""Embedding links and nearest neighbours against all pairs, with blocks small enough that pairs of blocks, halving and bars run."""

import collections

import numpy as np
import pytest

from tessera.llm import ann, embedding_dedup
from tessera.llm.ann import nearest
from tessera.llm.embedding_dedup import near_vectors

KIND = "vec_id long, embedding array<double>, label string, id int, e string, node int, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], KIND).repartition(3)


def part(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, threshold):
    ok = [part(v) and y is not None and i is not None for i, v, y in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                link[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    label = list(range(n))
    while (new := [min(label[j] for j in [i, *np.flatnonzero(link[i])]) for i in range(n)]) != label:
        label = new
    least = collections.defaultdict(list)
    for i, k in enumerate(label):
        least[k].append(rows[i][0])
    out = []
    for i, (v, *_) in enumerate(rows):
        known = [x for x in least[label[i]] if x is not None]
        component = min(known) if ok[i] else v
        out.append((v, int(link[i].sum()), component, v is None or v == component))
    return sorted(out, key=repr)


def vectors(seed, n=240, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, d)) * np.linspace(2, 0.3, d)
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, d))
    rows = [(i, [float(c) for c in v * rng.choice([1e-8, 1.0, 1e8])], "ab"[int(rng.integers(0, 2))]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(5)] * 2  # equal vectors and repeated rows
    # one vec_id with vectors of its own, one of them a copy
    rows += [(7, rows[9][1], rows[9][2]), (7, [-c for c in rows[9][1]], rows[9][2]), (7, rows[7][1], "c")]
    rows += [(2000, None, "a"), (2001, [0.0] * d, "a"), (2002, [float("nan")] * d, "a"), (2003, [1.0, None], "a"), (2004, rows[0][1], None), (2005, [], "a"), (2006, [1.0, 1.0], "a"), (2007, [1.0, 1.01], "a"), (2008, [float("inf")] * d, "b"), (None, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize(("block", "leaf", "sequence", "threshold"), [(1024, 128, 3, 0.93), (8, 3, 1, 0.93), (5, 2, 0, 0.8), (7, 7, 3, 0.99)])
def test_links(spark, monkeypatch, block, leaf, sequence, threshold):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("SEQUENCE", sequence)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = vectors(block)
    got = near_vectors(table(spark, rows), threshold).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_links(rows, threshold)


def test_links_at_the_threshold(spark):
    # cosines of 3/5 exactly, and a step below
    rows = [(1, [1.0, 0.0], "a"), (2, [3.0, 4.0], "a"), (3, [3.0, -4.0], "a"), (4, [3.0, 4.0 + 1e-12], "b"), (5, [1.0, 0.0], "b")]
    got = sorted(map(tuple, near_vectors(table(spark, rows), 0.6).collect()))
    assert got == [(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def lists(found):
    out = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize(("block", "asks"), [(4096, 4096), (16, 4096), (16, 3)])
def test_recall(spark, monkeypatch, block, asks):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "ASKS", asks)
    rng = np.random.default_rng(block)
    x = rng.standard_normal((600, 16)) * np.linspace(1.5, 0.5, 16)
    rows = [(i, [float(c) for c in v], "a") for i, v in enumerate(x)]
    rows += [(5000, None, "a"), (5020, [0.0] * 16, "a"), (5040, [float("nan")] * 16, "a"), (5060, [1.0], "a")]
    t = table(spark, rows)
    got, hit = lists(nearest(t, t.where("vec_id % 20 = 0")).collect()), 0
    assert sorted(got) == list(range(0, 600, 20))
    for q, found in got.items():
        s = x @ x[q]
        true = [i for i in sorted(range(600), key=lambda i: (-s[i], i)) if i != q][:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len(set(true) & {v for _, v, _ in found})
    assert hit >= 0.9 * 20 * len(got)


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (2, [1.0, 0.01], "a")]
    t = table(spark, rows)
    assert sorted(map(tuple, near_vectors(t).collect())) == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    got = sorted((r.rank, r.vec_id, r.score) for r in nearest(t, t.where("vec_id = 1"), 3).collect())
    # each of the two has ranks of its own: vectors 2 and the other 1
    assert got == [(1, 2, 0.01), (1, 2, 1.0), (2, 1, 0.0), (2, 1, 0.0)]


def test_few_and_none(spark):
    one = table(spark, [(20, [1.0, 2.0], "a")])
    assert nearest(one, one).count() == 0 and near_vectors(one).count() == 1
    assert nearest(one.where("false"), one.where("false")).count() == 0 and near_vectors(one.where("false")).count() == 0
    same = table(spark, [(i, [1.0, 2.0], "a") for i in range(30)])
    assert [v for _, v, _ in lists(nearest(same, same.where("vec_id = 20"), 5).collect())[20]] == [0, 1, 2, 3, 4]
