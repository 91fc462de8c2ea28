"""Personal data: the base patterns against `re`, the field against enumeration, its fit against differences, and planted texts."""

import hashlib
import itertools
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest

from tessera.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(d):
    doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
    return sum(doubled) % 10 == 0


def base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0]), s[2]))


def test_base_against_re():
    rng = random.Random(1)
    bits = ["a.b@c.de", "@", "x", ".", " ", "  ", "-", "+1", "(626)", "555", "5759", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "256", "007.1.1.1", "é", "１", "\n", "0", "@x.y", "%"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == base(text), repr(text)


def test_many_digits():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    model = pii.fitted([])
    for text in ("9" * 200_000, "999." * 100_000, "+" * 100_000, "a@" * 100_000, "1 " * 100_000, "(" * 100_000):
        assert pii.spans(text, model)[0] == []


def brute(model, nodes, skips):
    k, n = pii._OTHER + 1, len(nodes)
    out = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if any(x.allowed[v] == "0" if x.label is None else v != x.label for x, v in zip(nodes, y, strict=True)):
            continue
        score = sum(sum(model.unary.get(f, np.zeros(k))[v] for f in x.features) for x, v in zip(nodes, y, strict=True))
        score += sum(model.chain[a, b] for a, b in itertools.pairwise(y)) + sum(model.skip[y[a], y[b]] for a, b in skips)
        out[range(n), y] += np.exp(score)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize(("skips", "close"), [([], 1e-6), ([(0, 3)], 0.06), ([(0, 2), (1, 4)], 0.06)])
def test_marginals(skips, close):
    rng = np.random.default_rng(4)
    node = lambda f, label=None, allowed="11111": pii._Node(0, 1, label, [], [f], allowed, False)
    for _ in range(20):
        model = pii.Model({f: rng.normal(size=5) for f in "abc"}, rng.normal(size=(5, 5)), 0.7 * np.eye(5))
        nodes = [node("a"), node("b", 2), node("c"), node("a", None, "10111"), node("b")]
        assert np.abs(pii.marginals(model, nodes, skips) - brute(model, nodes, skips)).max() < close


def test_gradient():
    rng = np.random.default_rng(2)
    n, k = 12, 5
    data = pii._Data(np.repeat(np.arange(n), 2), rng.integers(0, 6, 2 * n), np.where(rng.random((n, k)) < 0.2, -50.0, 0.0), rng.integers(-1, k, n), rng.integers(-1, k, n), rng.integers(0, 3, (n, k)).astype(float), rng.integers(0, k, n), rng.random(n))
    data.barred[np.arange(n), data.y] = 0
    at = [rng.normal(size=(6, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k))]
    _, *grads = pii.objective(*at, data)
    for w, g in zip(at, grads, strict=True):
        for i in np.ndindex(w.shape):
            w[i] += 1e-5
            up = pii.objective(*at, data)[0]
            w[i] -= 2e-5
            down = pii.objective(*at, data)[0]
            w[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def with_check(rng):
    d = [4, *(rng.randint(0, 9) for _ in range(14))]
    return next("".join(map(str, d)) + str(c) for c in range(10) if luhn([*d, c]))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    kinds = [phone, lambda: ".".join(str(rng.randint(11, 255)) for _ in range(4)), lambda: with_check(rng), lambda: f"name{rng.randint(10, 99)}@mail.example.com"]
    rows = []
    for i in range(400):
        parts = [rng.choice(kinds)() for _ in range(rng.randint(0, 3))]
        parts += parts[:1] * (i % 3 == 0) + [str(rng.randint(10**15, 10**16)) for _ in range(2)]
        parts = [p for p in parts if p.startswith(("+", "name")) or "." in p or (p.startswith("4") and luhn(digits(p))) or not luhn(digits(p))]
        rows.append((i, " words stand here ".join(["start", *parts, "end"])))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    return pii.train(spark.createDataFrame(corpus, "doc_id long, text string"))


def found(text, model):
    b, every = pii.spans(text, model)
    assert b == base(text) and set(b) <= set(every)
    return [(k, text[s:e]) for k, s, e in every if (k, s, e) not in b]


def test_neighbours_that_fail_together(model):
    card = with_check(random.Random(1))
    assert found(f"call +1 (626) 555-5759 {card} now", model) == [("phone", "+1 (626) 555-5759"), ("card", card)]
    assert found(f"pay {card} {card} now", model) == [("card", card)] * 2
    assert found("pay 4111111111111112 4111111111111113 now", model) == []


def test_skip_edge_finds_the_second_mention(model):
    first, second = "Call +1 (626) 555-5759 today.", " Much further on, where no pattern looks, 626-555-5759 stands alone."
    assert found(second, model) == [] and found(first + " word" * 500 + second, model) == [("phone", "626-555-5759")]
    assert ("email", "john.smith") in found("john.smith@mail.example.com wrote. Then john.smith left.", model) and found("Then john.smith left.", model) == []


def repeats(rng):
    """Texts that name a phone as the patterns know it and, far on, without its plus."""
    for _ in range(50):
        a, b = rng.randint(200, 999), rng.randint(1000, 9999)
        yield f"Call +1 ({a}) 555-{b} today." + " word" * rng.randint(50, 500) + f" Then {a}-555-{b} again.", f"{a}-555-{b}"


def test_spans_that_only_skip_edges_give(model):
    off = pii.Model(model.unary, model.chain, np.zeros_like(model.skip))
    planted = list(repeats(random.Random(5)))
    assert [found(t, model) for t, _ in planted] == [[("phone", p)] for _, p in planted]
    assert all(found(t, off) == [] for t, _ in planted)


def test_skip_weights_are_learnt(spark, model, corpus):
    agree = np.diag(model.skip)[:4]
    assert agree.min() > 2 and model.skip[~np.eye(5, dtype=bool)].max() < 0.5
    once = [(i, " words stand here ".join(dict.fromkeys(t.split(" words stand here ")))) for i, t in corpus]
    assert np.abs(pii.train(spark.createDataFrame(once, "doc_id long, text string")).skip).max() == 0
    assert all((w == 0).all() for w in (pii.fitted([]).chain, pii.fitted([]).skip))


def test_clean_texts_stay_clean(model, corpus):
    for text in ("token = 5d190bd7c06284de91015a36974748794293dd8a", "id 9807915762804490 and 9807915762804490", "1.2.3.444 and 300.1.1.1", "a@b and @home", "in 2024-2025, 12 000 000 of 1,234,567"):
        assert found(text, model) == [], text
    assert sum(len(found(t, model)) for _, t in corpus) == 0


def test_rows(spark, model):
    card = with_check(random.Random(1))
    long = "word " * 300_000
    texts = ["", None, " \n", "Mail a.b@c.de " * 3, f"x {card} {card}", long + "1.2.3.4 " + long, "a.b@c.de 1.2.3.4"]
    rows = [(i, t, i, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], 0, "x", 1), (None, texts[6], 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email long, spans string, base int")
    got = sorted((tuple(r) for r in pii.found_spans(docs, model).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        b, every = base(t or ""), pii.spans(t or "", model)[1]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append((i, *(sum(k == x for k, *_ in b) for x in ("email", "ip", "card", "phone")), text, hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in every)))
    assert got == sorted(want, key=repr)
    masked = pii.redacted(docs, model).collect()
    assert masked[4].text == "x <CARD> <CARD>" and masked[1].text is None and masked[6].text == "<EMAIL> <IP>" and masked[4].spans == "x"
    none = docs.where("false")
    assert pii.found_spans(none, pii.train(none)).count() == 0


def test_fit_of_nothing():
    model = pii.fitted([SimpleNamespace(f="a\tb", allowed="11111", before=-1, after=-1, linked="0,0,0,0,0", y=4, n=3)])
    assert model.unary["a"].argmax() == 4
