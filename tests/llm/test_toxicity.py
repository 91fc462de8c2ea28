"""The positive-unlabelled risk by hand, its gradient by differences, what it learns, and edge rows."""

import math
import random

import numpy as np
import pytest

from tessera.llm import toxicity
from tessera.llm.toxicity import _Rows, held_out, nnpu, risk, scored, train


def data(seed=1, n=6):
    rng = np.random.default_rng(seed)
    sets = lambda k: [sorted(rng.choice(n, rng.integers(0, n), replace=False).tolist()) for _ in range(k)]
    p, u = sets(5), sets(9)
    return p, u, rng.integers(0, 50, 5), rng.integers(0, 50, 9), rng.normal(size=n + 2)


def by_hand(theta, p, u, size_p, size_u, prior):
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    margin = lambda f, s: sum(theta[i] for i in f) + theta[-2] + theta[-1] * math.log(1 + s)
    as_positive = [sigmoid(-margin(f, s)) for f, s in zip(p, size_p, strict=True)]
    as_negative = [[sigmoid(margin(f, s)) for f, s in zip(x, n, strict=True)] for x, n in ((p, size_p), (u, size_u))]
    return prior * np.mean(as_positive), np.mean(as_negative[1]) - prior * np.mean(as_negative[0])


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk(prior):
    p, u, size_p, size_u, theta = data()
    rows = _Rows.of(p, size_p), _Rows.of(u, size_u)
    *parts, grad_p, grad_n = risk(theta, *rows, prior)
    assert np.allclose(parts, by_hand(theta, p, u, size_p, size_u, prior))
    for i in range(len(theta)):
        at = [theta + d * np.eye(len(theta))[i] for d in (1e-6, -1e-6)]
        up, down = (by_hand(t, p, u, size_p, size_u, prior) for t in at)
        assert abs((up[0] - down[0]) / 2e-6 - grad_p[i]) < 1e-7 and abs((up[1] - down[1]) / 2e-6 - grad_n[i]) < 1e-7


def test_the_risk_of_negatives_stays_above_zero():
    rng = np.random.default_rng(2)
    # feature 0 marks the positive rows, of which the unlabelled ones hold a third; the others are noise
    mark = lambda k, share: [sorted(({0} if rng.random() < share else set()) | set(rng.integers(1, 40, 3).tolist())) for _ in range(k)]
    p, u = mark(60, 1.0), mark(300, 0.33)
    w, bias, size = nnpu(p, u, np.full(60, 9), np.full(300, 9), 40, 0.33)
    theta = np.concatenate([w, [bias, size]])
    _, negative, *_ = risk(theta, _Rows.of(p, np.full(60, 9)), _Rows.of(u, np.full(300, 9)), 0.33)
    margins = _Rows.of(u, np.full(300, 9)).margins(theta)
    truth = np.array([0 in f for f in u])
    assert negative > -0.05 and ((margins > 0) == truth).mean() > 0.95 and w[0] == w.max()


def corpus(spark, extra=()):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = rng.choices([f"word{k}" for k in range(60)], k=20) + (rng.choices(["vile", "filth", "scum"], k=3) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(f"{w[:4]}{''.join(chr(97 + int(c)) for c in w[4:])}" if w.startswith("word") else w for w in words)))
    labels = [(i, 0, int(i % 4 == 0)) for i in range(600)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted(spark):
    docs, labels = corpus(spark)
    got = scored(docs, train(docs, labels)).withColumn("held", held_out(toxicity.F.col("doc_id"))).collect()
    held = [(r.doc_id % 4 == 0, r.predicted) for r in got if r.held]
    assert len(held) > 80 and sum(bool(p) == t for t, p in held) / len(held) > 0.95


def test_repeated_ids_bring_one_text_each(spark):
    docs, labels = corpus(spark)
    many = docs.unionByName(docs.where("doc_id = 4").withColumn("text", toxicity.F.explode(toxicity.F.array(*(toxicity.F.lit(f"copy {k}") for k in range(300))))))
    assert train(docs, labels, positives=40, unlabelled=100).prior == train(many, labels, positives=40, unlabelled=100).prior
    assert train(docs, labels) == train(docs.unionByName(docs), labels.unionByName(labels))


def test_long_texts_and_ties(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels)
    odd = spark.createDataFrame([(1, "vile " * 300_000), (2, "vile " * 300_000), (3, None), (4, ""), (5, "x" * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in scored(odd, model).collect()}
    assert got[1] == got[2] > 0.5 and got[3] == got[4] < 0.5 and 0 <= got[5] <= 1
