"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and beginnings of words is fitted with numpy from confirmed toxic documents and
unlabelled documents.  The risk estimator corrects the unlabelled mean by the class prior, and where the
corrected part turns negative its gradient is reversed, so the classifier cannot fit the unlabelled rows as
if they were all negative.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, set_aside

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are features beside whole words.
_BEGINNINGS = (4, 5, 6)
#: Words longer than this are cut to it.
_LONGEST = 24


def _features(text: str | None) -> tuple[set[str], int]:
    words = {w[:_LONGEST] for w in _WORD.findall((text or "").lower())}
    out = set(words)
    for n in _BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out, len(words)


@dataclass
class Model:
    """weights: of the features; size_weight: of the log of the number of distinct words; scale: of the margin."""

    weights: dict[str, float]
    bias: float
    size_weight: float
    prior: float

    def score(self, text: str | None) -> float:
        features, n = _features(text)
        get = self.weights.get
        margin = self.bias + self.size_weight * math.log1p(n) + math.fsum(sorted(w for w in map(get, features) if w))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, margin))))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that nothing is learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(5)) == 0, F.lit(True))


def _encoded(vocabulary: dict[str, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sizes = [], []
            for t in b.column("text"):
                features, n = _features(t.as_py())
                out.append(sorted(vocabulary[f] for f in features if f in vocabulary))
                sizes.append(n)
            yield pa.RecordBatch.from_pydict({"positive": b.column("positive"), "words": pa.array(sizes, pa.int64()), "features": pa.array(out, pa.list_(pa.int32()))})

    return rows


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = {}
        for t, y in zip(b.column("text"), b.column("positive").to_pylist(), strict=True):
            for f in _features(t.as_py())[0]:
                counts.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(counts), pa.string()), "u": pa.array([c[0] for c in counts.values()], pa.int64()), "p": pa.array([c[1] for c in counts.values()], pa.int64())})


@dataclass
class _Rows:
    """Features of documents, flat: row and feature of each, the logs of sizes, and how many rows."""

    row: np.ndarray
    feature: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]], sizes: np.ndarray) -> _Rows:
        return cls(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([f for r in rows for f in r], np.int64), np.log1p(sizes))

    def margins(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, theta[self.feature], len(self.size)) + theta[-2] + theta[-1] * self.size

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, g[self.row], n), [g.sum(), (g * self.size).sum()]])


def risk(theta: np.ndarray, positive: _Rows, unlabelled: _Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk with the sigmoid loss, which of label y is sigmoid(-y margin), and their gradients.

    They are the prior times the loss of the positive rows as positive, and what the unlabelled rows lose as negative, less the
    prior times what the positive ones would: the risk of the negative rows, which cannot be below 0.
    """
    n = len(theta) - 2
    yes_p, yes_u = (1 / (1 + np.exp(-np.clip(x.margins(theta), -30, 30))) for x in (positive, unlabelled))
    slope_p, slope_u = positive.back(yes_p * (1 - yes_p) / len(yes_p), n), unlabelled.back(yes_u * (1 - yes_u) / len(yes_u), n)
    return prior * float((1 - yes_p).mean()), float(yes_u.mean() - prior * yes_p.mean()), -prior * slope_p, slope_u - prior * slope_p


def nnpu(x_p: list[list[int]], x_u: list[list[int]], size_p: np.ndarray, size_u: np.ndarray, n: int, prior: float, epochs: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and size weight that minimise the non-negative risk, by Adam on all rows; where its second part is below 0 a step goes up it."""
    positive, unlabelled = _Rows.of(x_p, size_p), _Rows.of(x_u, size_u)
    theta, m, v = np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2)
    theta[n] = -1.0
    for step in range(1, epochs + 1):
        _, negative, grad_p, grad_n = risk(theta, positive, unlabelled, prior)
        grad = -grad_n if negative < 0 else grad_p + grad_n
        grad = grad + decay * np.concatenate([theta[:n], [0.0, theta[n + 1]]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n]), float(theta[n + 1])


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 12000, vocabulary: int = 20000, least: int = 3) -> Model:
    """A model from the rows that are not held out.

    At most `positives` documents labelled toxic and `unlabelled` documents of any kind take part, those with the smallest hashes
    of doc_id, with one text of each doc_id; at most `vocabulary` features, of those that `least` toxic documents hold and that are commoner among them, are kept.
    The class prior is the toxic share of all labelled rows that are not held out.  Without a toxic label the model calls nothing toxic.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    total, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return Model({}, -10.0, 0.0, 0.0)
    prior = min(0.9, toxic / total)
    def first(ids: DataFrame, n: int) -> DataFrame:
        return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    p = first(known.where("toxic = 1").select("doc_id"), positives).select("doc_id", F.lit(1).alias("positive"))
    u = first(docs.where(~held_out(F.col("doc_id"))).select("doc_id"), unlabelled).select("doc_id", F.lit(0).alias("positive"))
    # at most positives + unlabelled ids, and of each the text with the smallest hash: texts that share an id are one document here
    chosen = docs.select("doc_id", "text").join(F.broadcast(p.unionByName(u).groupBy("doc_id").agg(F.collect_set("positive").alias("as"))), "doc_id")
    one = chosen.groupBy("doc_id").agg(F.min_by(F.struct("text", "as"), F.struct(F.xxhash64("text"), "text")).alias("x"))
    sample = materialise(one.select("x.text", F.explode("x.as").alias("positive")), "sample")
    n_p, n_u = sample.agg(F.sum("positive"), F.sum(1 - F.col("positive"))).first()
    if not n_p or not n_u:
        return Model({}, -10.0, 0.0, prior)
    counts = sample.mapInArrow(_listed, "feature string, u long, p long").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    lift = F.log((F.col("p") + 0.5) / n_p) - F.log((F.col("u") + 0.5) / n_u)
    best = counts.where(F.col("p") >= least).withColumn("lift", lift).where(F.col("lift") > math.log(1.5)).orderBy(F.desc(F.col("lift") * F.sqrt("p")), "feature").limit(vocabulary)
    names = [r.feature for r in best.select("feature").collect()]
    rows = sample.mapInArrow(_encoded({f: i for i, f in enumerate(names)}), "positive int, words long, features array<int>").collect()
    rows.sort(key=lambda r: (r.positive, r.words, r.features))
    pos, rest = [r for r in rows if r.positive], [r for r in rows if not r.positive]
    w, bias, size_weight = nnpu([r.features for r in pos], [r.features for r in rest], np.array([r.words for r in pos]), np.array([r.words for r in rest]), len(names), prior)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias, size_weight, prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on).  Null and empty texts have no features and get the score of the bias.

    A text of any length is scored whole, by its set of features.  Rows, repeated ones too, have a score each, which depends on the text
    alone.  Own columns of these names come back with `_in` appended.  An empty table gives an empty table.
    """
    docs = set_aside(docs, "score", "predicted")

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202  a Series to a Series
        return texts.map(model.score, na_action=None).astype(float)

    score.__annotations__ = {}
    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
