"""Models trained by passes over a DataFrame: the weights stay small and on the driver, the rows on executors."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import fixed, release
from pyspark.sql import types as T

from ..errors import RankMismatch


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Activations and how a gradient g passes back through them, from input z and output a.
_ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda z: z, lambda z, a, g: g), "relu": (lambda z: np.maximum(z, 0), lambda z, a, g: g * (z > 0)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda z, a, g: g * a * (1 - a)), "tanh": (np.tanh, lambda z, a, g: g * (1 - a * a)),
    "softmax": (_softmax, lambda z, a, g: a * (g - (a * g).sum(axis=1, keepdims=True))),
}


def _cross_entropy(p: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, int]:
    inside = np.clip(p, 1e-7, 1 - 1e-7)
    return -(y * np.log(inside)).sum(), -y / inside, len(y)


#: Losses: the sum over cells, its gradient, and what the sum is to be divided by.
_LOSSES: dict[str, Callable] = {"mse": lambda p, y: (((p - y) ** 2).sum(), 2 * (p - y), y.size), "cross_entropy": _cross_entropy}

#: Bounds of the starting weights of a layer from m to n values, or the deviation for he.
_STARTS: dict[str, Callable] = {
    "uniform": lambda rng, m, n: rng.uniform(-1, 1, (m, n)), "xavier": lambda rng, m, n: rng.uniform(-1, 1, (m, n)) * np.sqrt(6 / (m + n)), "he": lambda rng, m, n: rng.standard_normal((m, n)) * np.sqrt(2 / m),
}


@dataclass
class Sgd:
    rate: float = 0.01
    momentum: float = 0.0
    _v: dict = field(default_factory=dict)

    def step(self, name: str, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        self._v[name] = self.momentum * self._v.get(name, 0.0) - self.rate * g
        return p + self._v[name]


@dataclass
class RmsProp:
    rate: float = 0.01
    decay: float = 0.9
    _c: dict = field(default_factory=dict)

    def step(self, name: str, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        self._c[name] = self.decay * self._c.get(name, 0.0) + (1 - self.decay) * g * g
        return p - self.rate * g / (np.sqrt(self._c[name]) + 1e-8)


@dataclass
class Adam:
    rate: float = 0.001
    b1: float = 0.9
    b2: float = 0.999
    _m: dict = field(default_factory=dict)

    def step(self, name: str, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        m, v, t = self._m.get(name, (0.0, 0.0, 0))
        m, v, t = self.b1 * m + (1 - self.b1) * g, self.b2 * v + (1 - self.b2) * g * g, t + 1
        self._m[name] = m, v, t
        return p - self.rate * (m / (1 - self.b1**t)) / (np.sqrt(v / (1 - self.b2**t)) + 1e-8)


class Dense:
    """A layer from `inputs` to `outputs` values with an activation (linear, relu, sigmoid, tanh, softmax); start: uniform, xavier or he."""

    def __init__(self, inputs: int, outputs: int, activation: str = "linear", seed: int | np.random.Generator = 0, start: str = "xavier"):
        self.activation, self.training = activation, True
        self.w, self.b = _STARTS[start](np.random.default_rng(seed), inputs, outputs), np.zeros(outputs)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What goes into the activation and what comes out."""
        z = x @ self.w + self.b
        return z, _ACTIVATIONS[self.activation][0](z)


class Dropout:
    """In training each value is 0 by the chance `rate` and else scaled so that the mean stays; otherwise values pass."""

    def __init__(self, rate: float, seed: int = 0):
        if not 0 <= rate <= 1:
            raise ValueError("rate must be from 0 to 1")
        self.rate, self.seed, self.training, self.round = rate, seed, True, 0

    def mask(self, x: np.ndarray, rows: int = 0) -> np.ndarray | None:
        """Factors for each value; fixed by the seed, the epoch and a number of the rows, so a task that runs again does the same."""
        if not self.training or self.rate == 0:
            return None
        if self.rate == 1:
            return np.zeros_like(x)
        rng = np.random.default_rng([self.seed, self.round, rows])
        return (rng.random(x.shape) > self.rate) / (1 - self.rate)


def flattened(rows: DataFrame, x: str) -> DataFrame:
    """rows with an array of arrays, of any depth, as one array."""
    kind = rows.schema[x].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.ArrayType):
        raise RankMismatch(f"{x} has less than two axes")
    while isinstance(rows.schema[x].dataType.elementType, T.ArrayType):
        rows = rows.withColumn(x, F.flatten(x))
    return rows


class Sequential:
    """Layers one after another: Dense from sizes[k] to sizes[k + 1] with an activation each, and what is added later.

    loss: mse, or cross_entropy for outputs that are probabilities.
    """

    def __init__(self, sizes: list[int] | None = None, activations: list[str] | None = None, seed: int = 0, start: str = "xavier", loss: str = "mse"):
        rng = np.random.default_rng(seed)
        self.loss, self.layers = loss, []
        for (m, n), f in zip(itertools.pairwise(sizes or []), activations or [], strict=True):
            self.add(Dense(m, n, f, rng, start))

    def add(self, layer: Dense | Dropout) -> Sequential:
        self.layers.append(layer)
        return self

    def train(self) -> Sequential:
        return self._mode(True)

    def eval(self) -> Sequential:
        return self._mode(False)

    def _mode(self, training: bool) -> Sequential:
        for layer in self.layers:
            layer.training = training
        return self

    def dense(self) -> list[Dense]:
        return [layer for layer in self.layers if isinstance(layer, Dense)]

    def parameters(self) -> dict[str, np.ndarray]:
        """Weights and biases by name, in the order of the layers."""
        return {f"{name}{k}": x for k, layer in enumerate(self.dense()) for name, x in (("w", layer.w), ("b", layer.b))}

    def _pass(self, x: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
        out: list[tuple[np.ndarray | None, np.ndarray]] = [(x, x)]
        rows = zlib.crc32(np.ascontiguousarray(x).tobytes())
        for layer in self.layers:
            if isinstance(layer, Dense):
                out.append(layer.forward(out[-1][1]))
            else:
                mask = layer.mask(out[-1][1], rows)
                out.append((mask, out[-1][1] if mask is None else out[-1][1] * mask))
        return out

    def forward(self, rows: DataFrame, x: str = "x", out: str = "p") -> DataFrame:
        """rows with the column out: array<double>.  Dropout works only in training mode."""
        model = self

        @F.pandas_udf("array<double>")
        def predict(s: pd.Series) -> pd.Series:
            return pd.Series(list(model._pass(np.array(s.tolist(), float))[-1][1])) if len(s) else pd.Series([], dtype=object)

        return rows.withColumn(out, predict(x))

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row per layer."""
        rows = []
        for k, layer in enumerate(self.layers):
            if isinstance(layer, Dense):
                rows.append((k, layer.activation, self.loss, layer.w.shape[0], layer.w.ravel().tolist(), layer.b.tolist()))
            else:
                rows.append((k, "dropout", self.loss, layer.seed, [layer.rate], []))
        spark.createDataFrame(rows, "layer int, activation string, loss string, inputs int, w array<double>, b array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Sequential:
        rows = spark.read.parquet(path).orderBy("layer").collect()  # one per layer
        out = cls(loss=rows[0].loss if rows else "mse")
        for r in rows:
            if r.activation == "dropout":
                out.add(Dropout(r.w[0], r.inputs))
            else:
                layer = out.add(Dense(0, 0, r.activation, start="uniform")).layers[-1]
                layer.w, layer.b = np.array(r.w).reshape(r.inputs, -1), np.array(r.b)
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        states = self._pass(x)
        loss, delta, count = _LOSSES[self.loss](states[-1][1], y)
        grads: list[np.ndarray] = []
        for k in range(len(self.layers) - 1, -1, -1):
            (z, a), layer = states[k + 1], self.layers[k]
            if isinstance(layer, Dense):
                delta = _ACTIVATIONS[layer.activation][1](z, a, delta)
                grads = [states[k][1].T @ delta, delta.sum(0), *grads]
                delta = delta @ layer.w.T
            elif z is not None:
                delta = delta * z
        return [np.array([loss, count]), *grads]

    def fit(self, rows: DataFrame, optimiser: Sgd | RmsProp | Adam, epochs: int) -> list[float]:
        """Full-batch epochs over rows with x and y (arrays), written once: each partition sends one sum of gradients.  Returns the losses."""
        losses, rows = [], fixed(rows.select("x", "y"))
        for epoch in range(epochs):
            model = self
            for layer in self.layers:
                if isinstance(layer, Dropout):
                    layer.round = epoch

            def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = None
                for b in batches:
                    if len(b):
                        g = model._gradients(np.array(b["x"].tolist(), float), np.array(b["y"].tolist(), float))  # noqa: B023
                        total = g if total is None else [p + q for p, q in zip(total, g, strict=True)]
                if total is not None:
                    flat = np.concatenate([t.ravel() for t in total])
                    yield pd.DataFrame({"k": np.arange(len(flat)), "g": flat})

            sums = rows.select("x", "y").mapInPandas(partial, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).orderBy("k")
            flat = np.array([r.g for r in sums.collect()])  # as many numbers as the model has weights
            losses.append(float(flat[0] / flat[1]))
            at = 2
            for k, layer in enumerate(self.dense()):
                for name in ("w", "b"):
                    old = getattr(layer, name)
                    setattr(layer, name, optimiser.step(f"{name}{k}", old, flat[at : at + old.size].reshape(old.shape) / flat[1]))
                    at += old.size
        release(rows)
        return losses
