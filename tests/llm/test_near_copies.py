"""SimHash against an independent fingerprint and all pairs, with blocks small enough that each path runs."""

import random

import pytest
import xxhash

from tessera.llm import simhash, similar
from tessera.llm.simhash import near_groups, near_links


def fingerprint(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c == " " or "\t" <= c <= "\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    label = list(range(len(fps)))
    near = [[j for j, g in enumerate(fps) if (f ^ g).bit_count() <= radius] for f in fps]
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    return label


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize(("block", "radius"), [(512, 3), (6, 3), (2, 3), (6, 1), (6, 0), (6, 5)])
def test_links(spark, monkeypatch, block, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block + radius)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = {0, (1 << 64) - 1}
    while len(fps) < 160:
        f = rng.choice([rng.choice(seeds), rng.choice(sorted(fps)), rng.getrandbits(64)])
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6])):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    links = near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), radius).collect()
    at = {signed(f): i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for r in links:
            low = min(label[at[r.u]], label[at[r.v]])
            changed |= label[at[r.u]] != low or label[at[r.v]] != low
            label[at[r.u]] = label[at[r.v]] = low
    assert label == components(fps, radius)


def test_groups(spark):
    rng = random.Random(9)
    words = ["Ab", "cd", "é", "EF", "\x85x", "　", "g1", "h-h", "ÄÖ", "\x0b"]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = rng.choice(base).split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3 % 40, rng.choice([" ", "\t", "\n ", "\x0c"]).join(w)))
    rows += [(70, None), (71, ""), (72, " \t\x0b"), (73, "one"), (74, "ONE"), (75, "one two"), (None, "one"), (76, "w " * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    fps = [fingerprint(t) for _, t in rows]
    label = components(fps, 3)
    least = {k: min(i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None) for k in set(label)}
    want = sorted(((i, f"{f:016x}", least[k]) for (i, _), f, k in zip(rows, fps, label, strict=True)), key=repr)
    got = near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def shingles(text, k=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


@pytest.mark.parametrize("block", [512, 7])
def test_copies_with_edits(spark, monkeypatch, block):
    # groups of copies with words changed, cut off and put in, on both sides of 0.8, none of which may be lost
    monkeypatch.setattr(similar, "BLOCK", block)
    rng, rows = random.Random(block), []
    for _ in range(6):
        n = rng.choice([8, 15, 30, 60, 150, 300])
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                at, kind = rng.randrange(len(w)), rng.random()
                if kind < 0.6:
                    w[at] = f"e{rng.randrange(100_000)}"
                elif kind < 0.8 and len(w) > 6:
                    w = w[:at] or w
                else:
                    w = w[:at] + [f"i{rng.randrange(100_000)}" for _ in range(rng.randint(1, max(1, n // 12)))] + w[at:]
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, y in enumerate(sets) if 10 * len(x & y) >= 8 * len(x | y)] for x in sets]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    got = similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [i for i, k in enumerate(label) if i == k]


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 20, 300, 3000):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for _ in range(2))
        b = np.unique(np.concatenate([b[: n // 10], a[n // 10 :]]))
        differ = len(np.setxor1d(a, b))
        apart = int(np.bitwise_count((similar.odd_sketch(a) ^ similar.odd_sketch(b)).view(np.uint64)).sum())
        assert apart <= differ and (n < 100 or apart > 0)


def test_kept_row_does_not_depend_on_order(spark):
    text = "one text that stands in several rows of one document here"
    rows = [(1, text, "b", "en", {"x": 1}), (1, text, "a", "fr", {"x": 2}), (1, text, None, "de", None), (2, text, "a", "en", None), (None, None, "c", "en", None), (None, "", "b", "en", None), (None, "", "b", "en", {"x": 1})]
    for parts, order in ((1, rows), (3, rows[::-1]), (7, rows[3:] + rows[:3])):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, lang string, `more.of` map<string, int>").repartition(parts)
        kept = similar.one_of_similar(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, text, None, "de", None), (None, "", "b", "en", {"x": 1})], key=repr)


def test_sets_that_share_a_node_are_told_apart(spark):
    rows = [(5, 1, "a"), (5, 1, "b"), (5, 2, "c"), (5, 3, "d"), (5, 3, "e"), (6, 9, "f")]
    sets = similar.materialise(spark.createDataFrame(rows, "node long, more long, name string"), "sets")
    got = {r.name: r.node for r in similar.told_apart(sets).collect()}
    assert got["a"] == got["b"] == 5 and got["f"] == 6 and got["d"] == got["e"] and len({got[x] for x in "acdf"}) == 4


def test_passes_find_the_same_and_leave_nothing(spark, monkeypatch):
    import os
    import random

    from tessera.operators.order import shared_folder

    draw = random.Random(8)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        own = list(words)
        for at in draw.sample(range(120), 2):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.doc_id for r in similar.one_of_similar(docs).collect())
    monkeypatch.setattr(similar, "PASS", 4000)
    monkeypatch.setattr(similar, "EACH", 0)
    monkeypatch.setattr(similar, "BLOCK", 5)
    kinds = []
    monkeypatch.setattr(similar, "materialise", lambda df, label, f=similar.materialise: (kinds.append(label), f(df, label))[1])
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert sorted(r.doc_id for r in similar.one_of_similar(docs).collect()) == want
    assert kinds.count("met") > 2  # several passes
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith(("rest", "several", "met", "shared"))]


def long_texts(draw, n, size):
    """Texts of made-up words; each two of them have four phrases of their own in common."""
    texts = [[f"{k}r{j}" for j in range(draw.randint(size, size * 5 // 4))] for k in range(n)]
    for k in range(n):
        for m in range(k):
            for phrase in range(4):
                for own in (texts[k], texts[m]):
                    own.insert(draw.randrange(len(own)), " ".join(f"{k}and{m}by{phrase}{j}" for j in range(5)))
    return [" ".join(x) for x in texts]


def test_long_texts_that_share_a_phrase_do_not_reach_whole_sets(spark, monkeypatch):
    draw = random.Random(3)
    texts = long_texts(draw, 14, 2000)
    copy = texts[7].split(" ")
    for at in range(0, len(copy), 60):
        copy[at] = f"changed{at}"
    rows = list(enumerate([*texts, " ".join(copy)]))
    sizes = []
    monkeypatch.setattr(similar, "materialise", lambda df, label, f=similar.materialise: (out := f(df, label), label == "pairs" and sizes.append(out.count()))[0])
    got = sorted(r.doc_id for r in similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(range(14))
    assert sum(sizes) <= 2  # of 91 pairs of texts, all of which share phrases


def test_whole_sets_go_in_passes(spark, monkeypatch):
    draw = random.Random(4)
    rows = []
    for k in range(12):
        words = [f"{k}w{j}" for j in range(draw.choice([100, 200, 900]))]
        for _ in range(4):
            own = list(words)
            for at in draw.sample(range(len(own)), len(own) // 150):
                own[at] = f"x{draw.random()}"
            rows.append((len(rows) if draw.random() > 0.1 else None, " ".join(own)))
    docs = spark.createDataFrame([*rows, rows[0], rows[5]], "doc_id long, text string")
    want = sorted(((r.doc_id, r.text) for r in similar.one_of_similar(docs).collect()), key=repr)
    monkeypatch.setattr(similar, "WHOLE", 0)
    kinds = []
    monkeypatch.setattr(similar, "materialise", lambda df, label, f=similar.materialise: (kinds.append(label), f(df, label))[1])
    assert sorted(((r.doc_id, r.text) for r in similar.one_of_similar(docs).collect()), key=repr) == want
    assert kinds.count("tokens") > 3  # one for each verification without passes


def test_wide_sketches_fold(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    sets = {}
    for k, n in enumerate((3, 400, 700, 2000, 2001, 9000)):
        own = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for part in (1, 2):
            sets[10 * k + part] = own[: max(1, n * 9 // 10)] if part == 2 else own
    rows = [(k, len(x), similar.odd_sketch(x).tolist(), similar.odd_sketch(x, 1 << (len(x) - 1).bit_length()).tolist() if len(x) > similar.BITS else None) for k, x in sets.items()]
    known = spark.createDataFrame(rows, "node long, n int, sketch array<long>, wide array<long>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    for least in (similar.Fraction(4, 5), similar.Fraction(1, 10)):
        got = {(r.a, r.b): r.n for r in similar._near_enough(pairs, known, least).collect()}
        alike = {(a, b) for a in sets for b in sets if a < b and len(np.intersect1d(sets[a], sets[b])) >= least * len(np.union1d(sets[a], sets[b]))}
        assert alike <= got.keys() and all(n == len(sets[a]) + len(sets[b]) for (a, b), n in got.items())
        if least > similar.Fraction(1, 2):
            assert got.keys() == alike  # sets of that size are told from each other
