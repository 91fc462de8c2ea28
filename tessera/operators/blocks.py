"""Dense linear algebra over many tasks: tall matrices as rows of arrays, and square ones in blocks.

A tall matrix has one row of Spark for each of its rows (key columns and an array of n numbers).  Its Gram matrix and its
triangular factor are n by n and small: each task sends one such matrix, several levels combine them, and only
the last one reaches the driver.  What is left for the rows is one product each.

A square matrix too large for one task is cut into blocks of b by b.  The factorisation goes from panel to panel: a tournament of
the tasks picks b pivot rows, the driver factors that one b by b block, the row and the column of blocks next to it are solved in
parallel, and the rest is updated on a grid of tasks.  n / b steps, each written to the checkpoint folder; what a step has
replaced is removed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, MatrixNotPositiveDefinite, SingularMatrix
from .order import fixed, release

#: Columns of a tall matrix at most: n by n numbers have to fit on the driver.
WIDEST = 4096
#: Partial results that are combined in one task.
FAN = 32


def _matrix(lists: pa.ListArray, n: int) -> np.ndarray:
    if len(lists) and (np.diff(lists.offsets.to_numpy()) != n).any():
        raise DimensionMismatch(f"rows of {n} numbers are needed")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(float)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1], pa.array(x.ravel()))


def _reduced(rows: DataFrame, array: str | Column, n: int, partial, combine) -> np.ndarray:  # noqa: ANN001
    """partial of each batch, combined in each task, then FAN tasks at a time, until one n-column matrix is left."""
    if n > WIDEST:
        raise DimensionMismatch(f"no more than {WIDEST} columns")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = partial(_matrix(b.column("x"), n))
                total = x if total is None else combine(total, x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"x": _lists(total.reshape(1, -1))})

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.column("x"):
                x = row.values.to_numpy().reshape(-1, n)
                total = x if total is None else combine(total, x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"x": _lists(total.reshape(1, -1))})

    out = rows.select(F.col(array).cast("array<double>").alias("x") if isinstance(array, str) else array.cast("array<double>").alias("x")).mapInArrow(own, "x array<double>")
    parts = rows.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        out = out.repartition(parts).mapInArrow(further, "x array<double>")
    last = out.repartition(1).mapInArrow(further, "x array<double>").first()
    return np.array(last[0]).reshape(-1, n) if last else np.zeros((0, n))


def gram_matrix(rows: DataFrame, array: str | Column, n: int) -> np.ndarray:
    """Inner products of the columns, n by n: one matrix product for each batch."""
    out = _reduced(rows, array, n, lambda x: x.T @ x, np.add)
    return out if len(out) else np.zeros((n, n))


def as_cells(rows: DataFrame, x: np.ndarray) -> DataFrame:
    """A small matrix as a table (i, j, v)."""
    spark, (m, n) = rows.sparkSession, x.shape
    cell = F.posexplode(F.col("x"))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, x array<double>") if m else spark.createDataFrame([], "i long, x array<double>")
    return table.select("i", cell.alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def triangle(rows: DataFrame, array: str | Column, n: int) -> np.ndarray:
    """The triangular factor R of a tall matrix, its diagonal not negative: factors of the parts are stacked and factored again."""

    def factor(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x, mode="r")

    r = _reduced(rows, array, n, factor, lambda a, b: factor(np.vstack([a, b])))
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def times(rows: DataFrame, array: str, x: np.ndarray, out: str) -> DataFrame:
    """rows with the column out: the array as a row vector times a small matrix."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names if c != "__x"}
            yield pa.RecordBatch.from_pydict(columns | {out: _lists(_matrix(b.column("__x"), len(x)) @ x)})

    given = rows.drop(out) if out != array else rows
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != out)
    wide = given.select(*(F.col(f"`{f.name}`") for f in given.schema if f.name != out), F.col(array).cast("array<double>").alias("__x"))
    return wide.mapInArrow(product, f"{fields + ', ' if fields else ''}`{out}` array<double>")


def _upper_inverse(r: np.ndarray) -> np.ndarray:
    if not len(r) or (np.abs(np.diag(r)) <= 1e-12 * np.abs(r).max()).any():
        raise SingularMatrix("the columns depend on each other")
    return np.linalg.solve(r, np.eye(len(r)))


def tall_qr(rows: DataFrame, array: str, n: int, out: str = "q") -> tuple[DataFrame, np.ndarray]:
    """Q, as rows with the column out, and R.  Q is made of the rows in two steps, which keeps its columns at right angles."""
    first = triangle(rows, array, n)
    q = times(rows, array, _upper_inverse(first), out)
    second = triangle(q, out, n)
    return times(q, out, _upper_inverse(second), out), second @ first


def tall_svd(rows: DataFrame, array: str, n: int, out: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U, as rows with the column out, the singular values, largest first, and V transposed.  Columns of U for values of 0 are 0."""
    _, s, vt = np.linalg.svd(triangle(rows, array, n))
    scale = np.where(s > 1e-12 * max(s.max(initial=0.0), 1e-300), 1 / np.where(s > 0, s, 1), 0.0)
    return times(rows, array, vt.T * scale, out), s, vt


def least_squares(rows: DataFrame, array: str, target: str, n: int) -> np.ndarray:
    """The coefficients for which the rows' products come nearest to the target column, by the factor of the rows with the target beside them."""
    both = F.concat(F.col(array).cast("array<double>"), F.array(F.col(target).cast("double")))
    r = triangle(rows, both, n + 1)
    return _upper_inverse(r[:n, :n]) @ r[:n, n]


def axes_of(rows: DataFrame, array: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors, as columns, of the Gram matrix."""
    w, v = np.linalg.eigh(gram_matrix(rows, array, n))
    return w[::-1], v[:, ::-1]


# square matrices in blocks: (bi, bj, x), x the b * b numbers of a block, row by row


def _filled(cells: DataFrame, places: DataFrame, b: int) -> DataFrame:
    """Blocks at all places (bi, bj) from cells (i, j, v); what is left out is 0.  A block has b * b cells at most."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = np.zeros((t.num_rows, b * b))
            for k, (at, v) in enumerate(zip(t.column("at"), t.column("v"), strict=True)):
                if at.is_valid:
                    x[k, at.values.to_numpy()] = v.values.to_numpy()
            yield pa.RecordBatch.from_pydict({"bi": t.column("bi"), "bj": t.column("bj"), "x": _lists(x)})

    at = ((F.col("i") % b) * b + F.col("j") % b).cast("int")
    held = cells.where(F.col("v").isNotNull()).groupBy(F.floor(F.col("i") / b).alias("bi"), F.floor(F.col("j") / b).alias("bj"))
    held = held.agg(F.collect_list(F.struct(at.alias("at"), F.col("v").cast("double").alias("v"))).alias("m")).select("bi", "bj", F.col("m.at").alias("at"), F.col("m.v").alias("v"))
    return places.join(held, ["bi", "bj"], "left").mapInArrow(dense, "bi long, bj long, x array<double>")


def _held(cells: DataFrame, b: int, c: int) -> DataFrame:
    """Blocks of b by c (bi, bj, x) of those places that have a cell; a task makes one at a time."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = None, np.zeros(b * c)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"bi": pa.array([own[0]]), "bj": pa.array([own[1]]), "x": _lists(x.reshape(1, -1))})

        for t in batches:
            if not t.num_rows:
                continue
            bi, bj, at, v = (t.column(k).to_numpy() for k in ("bi", "bj", "at", "v"))
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(bi) != 0) | (np.diff(bj) != 0)]))
            for k, end in zip(starts, [*starts[1:], len(bi)], strict=True):
                if (bi[k], bj[k]) != own:
                    if own is not None:
                        yield made()
                    own, x = (int(bi[k]), int(bj[k])), np.zeros(b * c)
                x[at[k:end]] = v[k:end]
        if own is not None:
            yield made()

    at = ((F.col("i") % b) * c + F.col("j") % c).cast("int")
    dealt = cells.select(F.floor(F.col("i") / b).alias("bi"), F.floor(F.col("j") / c).alias("bj"), at.alias("at"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    return dealt.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(dense, "bi long, bj long, x array<double>")


#: Numbers of a product, or of the blocks of a matrix that it is made of, that one task holds at most.
HELD = 1 << 24


def _met(a: DataFrame, c: DataFrame, rows: int, columns: int, b: int, out: Callable[[Iterator[tuple[int, int, np.ndarray]]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """What out, a function of each task's blocks (bi, bj, z) of the product of matrices (i, j, v), makes of them, of the columns `kind`.

    Tasks form a grid: a block of the first matrix goes to one row of them, one of the second to one column.  A task meets the inner axis block
    by block and adds up its own part of the product, so there is no row for each term, and an inner position that many cells have is no hot key.
    An inner axis of b places at most is one block: those of the first matrix are held, those of the second pass by, and nothing of the product is kept, so
    the grid need not grow with it.  Only blocks with cells are sent.
    """
    down, across = -(-rows // b), -(-columns // b)
    inner = (a.agg(F.max("j")).first()[0] or 0) + 1
    one, wide = inner <= b, min(b, inner)
    least = -(-down * b * wide // HELD) if one else math.isqrt(-(-down * across * b * b // HELD) - 1 if down * across * b * b > HELD else 0) + 1
    # thin blocks go to no more tasks than the session asks for, as Spark holds what it deals out to over 200
    few = math.isqrt(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    g = max(1, min(few, max(down, across)) if one else _grid_side(a, max(down, across)), least)
    over = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    left = _held(a, b, wide).withColumn("o", over).select(((F.col("bi") % g) * g + F.col("o")).alias("cell"), F.col("bj").alias("inner"), F.lit(0).alias("side"), F.col("bi").alias("outer"), "x")
    right = _held(c, wide, b).withColumn("o", over).select((F.col("o") * g + F.col("bj") % g).alias("cell"), F.col("bi").alias("inner"), F.lit(1).alias("side"), F.col("bj").alias("outer"), "x")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        total: dict[tuple[int, int], np.ndarray] = {}
        held: dict[int, np.ndarray] = {}
        at = None
        for t in batches:
            for inner, side, outer, given in zip(t.column("inner").to_pylist(), t.column("side").to_pylist(), t.column("outer").to_pylist(), t.column("x"), strict=True):
                x = given.values.to_numpy()
                if inner != at:
                    held, at = {}, inner
                if side == 0:
                    held[outer] = x.reshape(b, wide).copy()
                    continue
                for bi, y in held.items():
                    z = y @ x.reshape(wide, b)
                    if one:
                        yield bi, outer, z
                    else:
                        total[bi, outer] = total[bi, outer] + z if (bi, outer) in total else z
        yield from ((*place, z) for place, z in total.items())

    sent = left.unionByName(right).repartitionById(g * g, F.col("cell").cast("int")).sortWithinPartitions("inner", "side")
    return sent.select("inner", "side", "outer", "x").mapInArrow(lambda batches: out(met(batches)), kind)


def product(a: DataFrame, c: DataFrame, rows: int, columns: int, b: int = 256) -> DataFrame:
    """The product of matrices (i, j, v) of `rows` rows and `columns` columns, in blocks; cells left out are 0."""

    def each(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for bi, bj, z in found:
            yield pa.RecordBatch.from_pydict({"bi": pa.array([bi]), "bj": pa.array([bj]), "x": _lists(z.reshape(1, -1))})

    out = _met(a, c, rows, columns, b, each, "bi long, bj long, x array<double>").select("bi", "bj", F.posexplode("x").alias("at", "v"))
    out = out.select((F.col("bi") * b + F.floor(F.col("at") / b)).alias("i"), (F.col("bj") * b + F.col("at") % b).alias("j"), "v")
    return out.where((F.col("i") < rows) & (F.col("j") < columns))


def product_by_rows(a: DataFrame, c: DataFrame, rows: int, columns: int, fold: Callable[[np.ndarray, int, int], np.ndarray], names: list[str], b: int = 256) -> DataFrame:
    """(i, names) of each row of the product of matrices (i, j, v): what fold gives of each block of it, by its first row and column, summed.

    fold(z, i, j) gives a number of each name for each row of z.  Blocks are folded in the tasks that make them, so no cell of the product becomes a row.
    """

    def folded(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for bi, bj, z in found:
            x = fold(z, bi * b, bj * b)
            own[bi] = own[bi] + x if bi in own else x
        for bi, x in own.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array(bi * b + np.arange(b))} | {name: pa.array(np.ascontiguousarray(x[:, k])) for k, name in enumerate(names)})

    kind = ", ".join(["i long", *(f"`{name}` double" for name in names)])
    parts = _met(a, c, rows, columns, b, folded, kind)
    return parts.where(F.col("i") < rows).groupBy("i").agg(*(F.sum(name).alias(name) for name in names))


def _places(a: DataFrame, rows: int, first: int, columns: int) -> DataFrame:
    return a.sparkSession.range(rows * columns).select(F.floor(F.col("id") / columns).alias("bi"), (F.col("id") % columns + first).alias("bj"))


def blocked(a: DataFrame, n: int, b: int) -> DataFrame:
    """A matrix (i, j, v) of n by n as blocks; what is left out is 0.  The last blocks are filled up by the unit matrix."""
    side = -(-n // b)
    unit = a.sparkSession.range(n, side * b).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    cells = a.where((F.col("i") < n) & (F.col("j") < n)).select("i", "j", F.col("v").cast("double").alias("v")).unionByName(unit)
    return _filled(cells, _places(a, side, 0, side), b)


def cells_of(blocks: DataFrame, n: int, b: int) -> DataFrame:
    out = blocks.select("bi", "bj", F.posexplode("x").alias("at", "v"))
    out = out.select((F.col("bi") * b + F.floor(F.col("at") / b)).alias("i"), (F.col("bj") * b + F.col("at") % b).alias("j"), "v")
    return out.where((F.col("i") < n) & (F.col("j") < n))


def _lu(x: np.ndarray, tiny: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    left, up = np.eye(len(x)), x.astype(float).copy()
    for k in range(len(x)):
        if abs(up[k, k]) <= tiny:
            raise SingularMatrix("zero pivot")
        left[k + 1 :, k] = up[k + 1 :, k] / up[k, k]
        up[k + 1 :] -= np.outer(left[k + 1 :, k], up[k])
    return left, np.triu(up)


def _best_rows(x: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that elimination takes as pivots if it goes by the greatest entry of a column, in its order."""
    rest, order = x.astype(float).copy(), np.arange(len(x))
    for k in range(min(most, len(x), x.shape[1])):
        p = k + int(np.abs(rest[k:, k]).argmax())
        rest[[k, p]], order[[k, p]] = rest[[p, k]], order[[p, k]]
        if rest[k, k] != 0:
            rest[k + 1 :, k:] -= np.outer(rest[k + 1 :, k] / rest[k, k], rest[k, k:])
    return order[:most]


def _tournament(panel: DataFrame, count: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b rows of a panel of `count` blocks that serve as pivots: their numbers, and the rows themselves, in order.

    Each task eliminates within its own blocks and puts up b rows; FAN tasks' winners meet at a time, until b rows are left.
    """
    kind = "ids array<long>, x array<double>"

    def winners(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = _best_rows(x, b)
        return ids[best], x[best]

    def sent(held: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if held is not None:
            yield pa.RecordBatch.from_pydict({"ids": _lists(held[0].reshape(1, -1)), "x": _lists(held[1].reshape(1, -1))})

    def met(held: tuple | None, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return winners(ids, x) if held is None else winners(np.concatenate([held[0], ids]), np.vstack([held[1], x]))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for t in batches:
            for bi, x in zip(t.column("bi").to_pylist(), _matrix(t.column("x"), b * b), strict=True):
                held = met(held, bi * b + np.arange(b), x.reshape(b, b))
        yield from sent(held)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for t in batches:
            for row in t.to_pylist():
                held = met(held, np.array(row["ids"]), np.array(row["x"]).reshape(-1, b))
        yield from sent(held)

    out = panel.select("bi", "x").mapInArrow(own, kind)
    while count > FAN:
        count = -(-count // FAN)
        out = out.repartition(count).mapInArrow(further, kind)
    last = out.repartition(1).mapInArrow(further, kind).first()
    return np.array(last.ids), np.array(last.x).reshape(-1, b)


def _each(blocks: DataFrame, b: int, f, taken: dict[int, np.ndarray] | None = None) -> DataFrame:  # noqa: ANN001
    """f of each block, in which the rows that are taken (by row of blocks) count as 0."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = _cleared(_matrix(t.column("x"), b * b).reshape(-1, b, b), t.column("bi"), taken or {})
            yield pa.RecordBatch.from_pydict({"bi": t.column("bi"), "bj": t.column("bj"), "x": _lists(f(x).reshape(-1, b * b))})

    return blocks.select("bi", "bj", "x").mapInArrow(mapped, "bi long, bj long, x array<double>")


def _cleared(x: np.ndarray, bi: pa.Array, taken: dict[int, np.ndarray]) -> np.ndarray:
    if not taken:
        return x
    x = x.copy()
    for k, row in enumerate(bi.to_pylist()):
        if row in taken:
            x[k, taken[row]] = 0
    return x


def _gathered(blocks: DataFrame, ids: np.ndarray, b: int, k: int) -> DataFrame:
    """The rows of these numbers, in this order, as the blocks (k, bj)."""
    where: dict[int, list[tuple[int, int]]] = {}
    for at, i in enumerate(ids.tolist()):
        where.setdefault(i // b, []).append((at, i % b))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = _matrix(t.column("x"), b * b).reshape(-1, b, b)
            own = [(bj, at, x[n, row]) for n, (bi, bj) in enumerate(zip(t.column("bi").to_pylist(), t.column("bj").to_pylist(), strict=True)) for at, row in where[bi]]
            if own:
                yield pa.RecordBatch.from_pydict({"bj": pa.array([o[0] for o in own]), "at": pa.array([o[1] for o in own], pa.int32()), "r": _lists(np.stack([o[2] for o in own]))})

    # b rows of b numbers for each column of blocks
    out = blocks.where(F.col("bi").isin(sorted(where))).select("bi", "bj", "x").mapInArrow(rows, "bj long, at int, r array<double>")
    x = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda z: z["r"]))
    return out.groupBy("bj").agg(x.alias("x")).select(F.lit(k).cast("long").alias("bi"), "bj", "x")


def _grid_side(df: DataFrame, most: int) -> int:
    """Cells along each side of a grid with about one cell for each shuffle partition."""
    return max(1, min(most, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1))


def _less_products(rest: DataFrame, left: DataFrame, up: DataFrame, b: int, side: int, taken: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Blocks of rest less the product of the block of left in their row and that of up in their column.

    Tasks form a grid: a block of rest goes to one, one of left to a row of them, one of up to a column.  A task holds those of left and up,
    and the blocks of rest pass by.
    """
    g = _grid_side(rest, side)
    cell = (F.col("bi") % g) * g + F.col("bj") % g
    over = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    sent = rest.select(cell.alias("cell"), F.lit(2).alias("kind"), "bi", "bj", "x")
    sent = sent.unionByName(left.withColumn("o", over).select(((F.col("bi") % g) * g + F.col("o")).alias("cell"), F.lit(0).alias("kind"), "bi", "bj", "x"))
    sent = sent.unionByName(up.withColumn("o", over).select((F.col("o") * g + F.col("bj") % g).alias("cell"), F.lit(1).alias("kind"), "bi", "bj", "x"))

    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, ups = {}, {}
        for t in batches:
            kinds, bi, bj, x = t.column("kind").to_numpy(), t.column("bi").to_pylist(), t.column("bj").to_pylist(), _matrix(t.column("x"), b * b).reshape(-1, b, b)
            for n in np.flatnonzero(kinds < 2):
                (lefts if kinds[n] == 0 else ups)[bi[n] if kinds[n] == 0 else bj[n]] = x[n]
            own = np.flatnonzero(kinds == 2)
            if len(own):
                old = _cleared(x[own], pa.array([bi[n] for n in own]), taken or {})
                zero = np.zeros((b, b))
                new = np.stack([old[m] - lefts.get(bi[n], zero) @ ups.get(bj[n], zero) for m, n in enumerate(own)])
                yield pa.RecordBatch.from_pydict({"bi": pa.array([bi[n] for n in own]), "bj": pa.array([bj[n] for n in own]), "x": _lists(new.reshape(-1, b * b))})

    placed = sent.repartitionById(g * g, F.col("cell").cast("int")).sortWithinPartitions("kind").select("kind", "bi", "bj", "x")
    return placed.mapInArrow(updated, "bi long, bj long, x array<double>")


def _block(blocks: DataFrame, k: int, b: int) -> np.ndarray:
    return np.array(blocks.where((F.col("bi") == k) & (F.col("bj") == k)).first().x).reshape(b, b)


def blocked_lu(blocks: DataFrame, side: int, b: int, beside: bool = False, pivots: bool = False, tiny: float = 0.0) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """L, with ones on its diagonal, and U of a matrix of side * side blocks, and the rows' order.

    Without pivots rows are not exchanged, and a zero pivot raises.  With them the pivots of a panel are found by a tournament: row `order[k]` of the
    matrix is row k of L U.  Rows are not moved: those of a panel's pivots are gathered into a row of U's blocks and count as 0 in what is left.
    So L's blocks stand at the rows' places in the matrix, and the triangle of each panel's pivots at the row of blocks -1 - k.
    tiny: pivots up to that size raise.

    beside: further columns of blocks stand right of the matrix and go through the same steps, as part of U.
    """
    rest, lefts, ups, order = fixed(blocks), [], [], []
    spark, kind = blocks.sparkSession, "bi long, bj long, x array<double>"
    held: dict[int, set[int]] = {}
    for k in range(side):
        if pivots:
            ids, x = _tournament(rest.where(F.col("bj") == k), side, b)
            best = _best_rows(x, b)
            ids, x = ids[best], x[best]
        else:
            ids, x = k * b + np.arange(b), _block(rest, k, b)
        order.append(ids)
        low, high = _lu(x, tiny)
        lefts.append(spark.createDataFrame([(-1 - k if pivots else k, k, low.ravel().tolist())], kind))
        ups.append(spark.createDataFrame([(k, k, high.ravel().tolist())], kind))
        last = k == side - 1
        if last and not beside:
            break
        by_low, by_high = np.linalg.solve(low, np.eye(b)), np.linalg.solve(high, np.eye(b))
        further = rest.where(F.col("bj") > k)
        across = fixed(_each(_gathered(further, ids, b, k) if pivots else further.where(F.col("bi") == k), b, lambda x, m=by_low: m @ x))
        ups.append(across)
        if last:
            break
        taken = {}
        for i in ids.tolist():
            held.setdefault(i // b, set()).add(i % b)
            taken.setdefault(i // b, []).append(i % b)
        taken = {bi: np.array(rows) for bi, rows in taken.items()}
        left_over = ~F.col("bi").isin([bi for bi, rows in held.items() if len(rows) == b])
        column = fixed(_each(rest.where((F.col("bj") == k) & left_over), b, lambda x, m=by_high: x @ m, taken))
        lefts.append(column)
        old, rest = rest, fixed(_less_products(further.where(left_over), column, across, b, side, taken))
        release(old)
    release(rest)
    out = []
    for parts in (lefts, ups):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        out.append(fixed(whole))
        for p in parts:
            release(p)
    return out[0], out[1], np.concatenate(order)


def lu(a: DataFrame, n: int, b: int = 256) -> tuple[DataFrame, DataFrame]:
    """L and U of a matrix (i, j, v) as cells, without exchanges of rows."""
    left, up, _ = blocked_lu(blocked(a, n, b), -(-n // b), b)
    return cells_of(left, n, b), cells_of(up, n, b)


def pivoted_lu(a: DataFrame, n: int, b: int = 256) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """L and U as cells, and the order: row order[k] of the matrix is row k of L U.  The order, n numbers, reaches the driver."""
    side = -(-n // b)
    left, up, order = blocked_lu(blocked(a, n, b), side, b, pivots=True)
    places = a.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(order)], "i long, to long")
    own = left.where("bi < 0").withColumn("bi", -1 - F.col("bi"))
    low = cells_of(own, side * b, b).where("i >= j").unionByName(cells_of(left.where("bi >= 0"), side * b, b).where("v <> 0").join(F.broadcast(places), "i").select(F.col("to").alias("i"), "j", "v"))
    return low.where((F.col("i") < n) & (F.col("j") < n)), cells_of(up, n, b), order[order < n]


#: Pivots up to this size count as 0, which makes a matrix singular.
TINY = 1e-9


def _sign(order: np.ndarray) -> int:
    """1 if the order takes an even number of exchanges, else -1: by its cycles."""
    seen, cycles = np.zeros(len(order), bool), 0
    for k in range(len(order)):
        cycles += not seen[k]
        while not seen[k]:
            seen[k], k = True, order[k]  # noqa: PLW2901
    return -1 if (len(order) - cycles) % 2 else 1


def determinant(a: DataFrame, n: int, b: int = 256) -> float:
    """The product of U's diagonal, of which no more than n numbers reach the driver, with the sign of the rows' order; 0 for a singular matrix, 1 for an empty one."""
    if not n:
        return 1.0
    try:
        _, up, order = blocked_lu(blocked(a, n, b), -(-n // b), b, pivots=True, tiny=TINY)
    except SingularMatrix:
        return 0.0
    size, power = float(_sign(order)), 0
    for r in cells_of(up.where("bi = bj"), n, b).where("i = j").select("v").collect():
        size, more = math.frexp(size * r.v)
        power += more
    try:
        return math.ldexp(size, power)
    except OverflowError:
        return math.copysign(math.inf, size)


def cholesky(a: DataFrame, n: int, b: int = 256) -> DataFrame:
    """The lower factor of a symmetric matrix: the columns of L by the roots of U's diagonal.  A matrix that is not symmetric, to 1e-9 of its greatest entry, raises."""
    cells = a.select("i", "j", F.col("v").cast("double").alias("v"))
    apart = cells.unionByName(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.abs(F.sum("v")).alias("d"))
    if (apart.agg(F.max("d")).first()[0] or 0.0) > 1e-9 * (cells.agg(F.max(F.abs("v"))).first()[0] or 0.0):
        raise MatrixNotPositiveDefinite("the matrix is not symmetric")
    try:
        left, up = lu(a, n, b)
    except SingularMatrix as e:
        raise MatrixNotPositiveDefinite(str(e)) from e
    d = up.where("i = j").select("j", F.col("v").alias("d"))
    if not d.where("d <= 0").isEmpty():
        raise MatrixNotPositiveDefinite("a pivot is not above 0")
    return left.where("i >= j").join(d, "j").select("i", "j", (F.col("v") * F.sqrt("d")).alias("v"))


def solve(a: DataFrame, y: DataFrame, n: int, b: int = 256) -> DataFrame:
    """x of A x = y for a matrix (i, j, v) and right sides (i, v), or (i, j, v) for several; x in the same form.

    Pivots are found by a tournament; a singular matrix raises.  The right sides stand beside the matrix as further columns of blocks and go through the same steps; then the steps are undone from the
    last block up.
    """
    one = "j" not in y.columns
    right = y.withColumn("j", F.lit(0).cast("long")) if one else y
    columns = (right.agg(F.max("j")).first()[0] or 0) + 1
    side, wide = -(-n // b), -(-columns // b)
    tall = right.select("i", (F.col("j") + side * b).alias("j"), F.col("v").cast("double").alias("v"))
    beside = _filled(tall, _places(a, side, side, wide), b)
    _, up, _ = blocked_lu(blocked(a, n, b).unionByName(beside), side, b, beside=True, pivots=True, tiny=TINY)
    rest, solved = up.where(F.col("bj") >= side), None
    for k in range(side - 1, -1, -1):
        by_high = np.linalg.solve(_block(up, k, b), np.eye(b))
        now = fixed(_each(rest.where(F.col("bi") == k), b, lambda x, m=by_high: m @ x))
        solved = now if solved is None else solved.unionByName(now)
        if k:
            column = up.where((F.col("bj") == k) & (F.col("bi") < k))
            rest = fixed(_less_products(rest.where(F.col("bi") < k), column, now, b, side))
    out = solved.select("bi", (F.col("bj") - side).alias("bj"), F.posexplode("x").alias("at", "v"))
    cells = out.select((F.col("bi") * b + F.floor(F.col("at") / b)).alias("i"), (F.col("bj") * b + F.col("at") % b).alias("j"), "v").where((F.col("i") < n) & (F.col("j") < columns))
    return cells.drop("j") if one else cells


def inverse(a: DataFrame, n: int, b: int = 256) -> DataFrame:
    spark = a.sparkSession
    return solve(a, spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, b)
