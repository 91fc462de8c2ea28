"""Reverse-mode differentiation over the rows of a DataFrame.

A Tensor is a node of an expression over array columns (inputs, one array for each row) and weights (small arrays of the driver).
`gradients` turns one loss into columns: forward values first, then, from the loss backwards, the derivative of the loss by each node, each a
column of its own.  Derivatives by weights are summed over all rows by one aggregate, so only arrays of the weights' sizes
reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch

Shape = tuple[int, ...]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


class Tensor:
    """A node.  shape: of one row's value, flattened in row-major order into an array column; () is a single number, an array of one."""

    def __init__(self, kind: str, shape: Shape, parents: tuple[Tensor, ...] = (), value: np.ndarray | str | None = None):
        self.kind, self.shape, self.parents, self.value = kind, shape, parents, value

    @staticmethod
    def column(name: str, *shape: int) -> Tensor:
        """An input: an array column of as many numbers as the shape has cells."""
        return Tensor("column", shape, value=name)

    @staticmethod
    def weight(x) -> Tensor:  # noqa: ANN001
        x = np.asarray(x, float)
        return Tensor("weight", x.shape, value=x)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def _elementwise(self, kind: str, other: Tensor | float) -> Tensor:
        other = other if isinstance(other, Tensor) else Tensor.weight(other)
        return Tensor(kind, np.broadcast_shapes(self.shape, other.shape), (self, other))

    def add(self, other: Tensor | float) -> Tensor:
        """The sum, by broadcasting."""
        return self._elementwise("add", other)

    def mul(self, other: Tensor | float) -> Tensor:
        """The product cell by cell, by broadcasting."""
        return self._elementwise("mul", other)

    __add__, __mul__ = add, mul

    def matmul(self, other: Tensor) -> Tensor:
        """A vector or matrix times a matrix."""
        if len(self.shape) not in (1, 2) or len(other.shape) != 2 or self.shape[-1] != other.shape[0]:
            raise DimensionMismatch(f"{self.shape} times {other.shape}")
        return Tensor("matmul", (*self.shape[:-1], other.shape[1]), (self, other))

    __matmul__ = matmul

    def relu(self) -> Tensor:
        return Tensor("relu", self.shape, (self,))

    def sigmoid(self) -> Tensor:
        return Tensor("sigmoid", self.shape, (self,))

    def tanh(self) -> Tensor:
        return Tensor("tanh", self.shape, (self,))

    def softmax(self) -> Tensor:
        """Over all cells of the row."""
        return Tensor("softmax", self.shape, (self,))

    def sum(self) -> Tensor:
        return Tensor("sum", (), (self,))

    def mse_loss(self, target: Tensor) -> Tensor:
        """The mean of squared differences over the cells of the row."""
        return Tensor("mse", (), (self, self._alike(target)))

    def cross_entropy_loss(self, target: Tensor) -> Tensor:
        """-sum of target times the logarithm of the value, clipped from below at 1e-12."""
        return Tensor("cross", (), (self, self._alike(target)))

    def _alike(self, target: Tensor) -> Tensor:
        if target.shape != self.shape:
            raise DimensionMismatch(f"{self.shape} and {target.shape}")
        return target

    def order(self) -> list[Tensor]:
        """This node and all it is made of, parents first, each once."""
        out, seen, open_ = [], set(), [(self, False)]
        while open_:
            t, done = open_.pop()
            if done:
                out.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                open_ += [(t, True), *((p, False) for p in t.parents)]
        return out


def _spread(x: Column, shape: Shape, to: Shape) -> Column:
    """A value of one shape at the cells of a wider one."""
    if shape == to:
        return x
    at = np.broadcast_to(np.arange(math.prod(shape)).reshape(shape), to).ravel()
    return F.transform(F.array(*(F.lit(int(k)) for k in at)), lambda k: F.get(x, k))


def _gathered(g: Column, to: Shape, shape: Shape) -> Column:
    """The turn of _spread: what came from one cell is summed."""
    if shape == to:
        return g
    at = np.broadcast_to(np.arange(math.prod(shape)).reshape(shape), to).ravel()
    cells = F.array(*(F.array(*(F.lit(int(k)) for k in np.flatnonzero(at == c))) for c in range(math.prod(shape))))
    return F.transform(cells, lambda ks: _sum(F.transform(ks, lambda k: F.get(g, k))))


def _product(x: Column, y: Column, n: int, k: int, m: int, turned: str = "") -> Column:
    """An n by k matrix times a k by m one, flat; `turned` names those (x, y) that are stored the other way round."""
    left = (lambda i, a: F.get(x, a * n + i)) if "x" in turned else (lambda i, a: F.get(x, i * k + a))
    right = (lambda a, j: F.get(y, j * k + a)) if "y" in turned else (lambda a, j: F.get(y, a * m + j))
    return F.transform(_places(n * m), lambda c: _sum(F.transform(_places(k), lambda a: left(F.floor(c / m).cast("int"), a) * right(a, (c % m).cast("int")))))


def _forward(t: Tensor, x: list[Column]) -> Column:
    if t.kind == "column":
        return F.col(f"`{t.value}`").cast("array<double>")
    if t.kind == "weight":
        return F.array(*(F.lit(float(z)) for z in t.value.ravel()))
    shapes = [p.shape for p in t.parents]
    if t.kind in ("add", "mul"):
        return F.zip_with(_spread(x[0], shapes[0], t.shape), _spread(x[1], shapes[1], t.shape), (lambda a, b: a + b) if t.kind == "add" else (lambda a, b: a * b))
    if t.kind == "matmul":
        return _product(x[0], x[1], t.size // t.shape[-1], shapes[1][0], shapes[1][1])
    if t.kind == "softmax":
        e = F.transform(F.array(F.array_max(x[0])), lambda top: F.transform(x[0], lambda z: F.exp(z - top)))[0]
        return F.transform(F.array(e), lambda y: F.transform(y, lambda z: z / _sum(y)))[0]
    if t.kind == "mse":
        return F.array(_sum(F.zip_with(x[0], x[1], lambda a, b: (a - b) * (a - b))) / t.parents[0].size)
    if t.kind == "cross":
        return F.array(-_sum(F.zip_with(x[0], x[1], lambda a, b: b * F.ln(F.greatest(a, F.lit(1e-12))))))
    if t.kind == "sum":
        return F.array(_sum(x[0]))
    return F.transform(x[0], {"relu": lambda z: F.greatest(z, F.lit(0.0)), "sigmoid": lambda z: 1 / (1 + F.exp(-z)), "tanh": F.tanh}[t.kind])


def _backward(t: Tensor, x: list[Column], y: Column, g: Column) -> list[Column]:
    """The derivatives by the parents, g that by this node, whose value is y."""
    shapes = [p.shape for p in t.parents]
    each = lambda f: F.zip_with(y, g, f)
    if t.kind == "add":
        return [_gathered(g, t.shape, s) for s in shapes]
    if t.kind == "mul":
        wide = [_spread(x[k], shapes[k], t.shape) for k in (0, 1)]
        return [_gathered(F.zip_with(g, wide[1 - k], lambda a, b: a * b), t.shape, shapes[k]) for k in (0, 1)]
    if t.kind == "matmul":
        k, m = shapes[1]
        n = t.size // m
        return [_product(g, x[1], n, m, k, "y"), _product(x[0], g, k, n, m, "x")]
    if t.kind == "relu":
        return [each(lambda a, b: F.when(a > 0, b).otherwise(0.0))]
    if t.kind == "sigmoid":
        return [each(lambda a, b: a * (1 - a) * b)]
    if t.kind == "tanh":
        return [each(lambda a, b: (1 - a * a) * b)]
    if t.kind == "softmax":
        return [F.transform(F.array(_sum(each(lambda a, b: a * b))), lambda s: each(lambda a, b: a * (b - s)))[0]]
    if t.kind == "sum":
        return [F.transform(x[0], lambda _: g[0])]
    if t.kind == "mse":
        by = F.zip_with(x[0], x[1], lambda a, b: 2 * (a - b) / t.parents[0].size * g[0])
        return [by, F.transform(by, lambda z: -z)]
    by = F.zip_with(x[0], x[1], lambda a, b: F.when(a > 1e-12, -b / a).otherwise(0.0) * g[0])
    return [by, F.transform(x[0], lambda a: -F.ln(F.greatest(a, F.lit(1e-12))) * g[0])]


def with_gradients(df: DataFrame, loss: Tensor, by: list[Tensor]) -> tuple[DataFrame, str, list[str]]:
    """df with a column of the loss and one of its derivative by each tensor of `by`; their names.  All are arrays, that of the loss of one number."""
    if loss.shape != ():
        raise DimensionMismatch("a loss is a single number")
    nodes = loss.order()
    name = {id(t): f"__v{k}" for k, t in enumerate(nodes)}
    for t in nodes:
        df = df.withColumn(name[id(t)], _forward(t, [F.col(name[id(p)]) for p in t.parents]))
    wanted = {id(t) for t in by}
    reach = set(wanted)
    for t in nodes:  # only what leads to a wanted tensor is gone back through
        if any(id(p) in reach for p in t.parents):
            reach.add(id(t))
    parts: dict[int, list[str]] = {id(loss): ["__g"]}
    df = df.withColumn("__g", F.array(F.lit(1.0)))
    for k, t in reversed(list(enumerate(nodes))):
        if id(t) not in reach or id(t) not in parts:
            continue
        total = F.col(parts[id(t)][0])
        for c in parts[id(t)][1:]:
            total = F.zip_with(total, F.col(c), lambda a, b: a + b)
        df = df.withColumn(f"__d{k}", total)
        if t.parents:
            own = _backward(t, [F.col(name[id(p)]) for p in t.parents], F.col(name[id(t)]), F.col(f"__d{k}"))
            for n, (p, g) in enumerate(zip(t.parents, own, strict=True)):
                if id(p) in reach:
                    df = df.withColumn(f"__p{k}_{n}", g)
                    parts.setdefault(id(p), []).append(f"__p{k}_{n}")
    at = {id(t): k for k, t in enumerate(nodes)}
    for t in by:
        if id(t) not in at:
            raise DimensionMismatch("the loss does not depend on a tensor")
    return df, name[id(loss)], [f"__d{at[id(t)]}" for t in by]


def gradients(df: DataFrame, loss: Tensor, by: list[Tensor]) -> tuple[float, list[np.ndarray]]:
    """The loss summed over the rows, and its derivatives by the weights of `by`; 0 without rows.  One pass, partial sums in each task."""
    rows, value, names = with_gradients(df, loss, by)

    def cells_of(column: str, n: int) -> Column:
        return F.transform(F.col(column), lambda g, k: F.struct(F.lit(n).alias("t"), k.alias("k"), g.alias("g")))

    cells = rows.select(F.explode(F.concat(*(cells_of(c, n) for n, c in enumerate([value, *names], -1)))).alias("c")).groupBy("c.t", "c.k").agg(F.sum("c.g").alias("g")).collect()
    total, out = 0.0, [np.zeros(t.size) for t in by]
    for r in cells:
        if r.t < 0:
            total = r.g
        else:
            out[r.t][r.k] = r.g
    return total, [g.reshape(t.shape) for g, t in zip(out, by, strict=True)]
