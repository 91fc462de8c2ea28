"""Graphs as edges (u, v), and small collections as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DepthLimit
from .order import fixed, release


#: Levels of a search that are kept as tables of their own.
LEVELS = 16
#: Edges that a task tells apart.  Tasks are no more than they need be: to deal rows out to over 200 parts Spark holds those of a whole part of the input.
EDGES = 1 << 21


def bfs(edges: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """(node, depth) of what can be reached along directed edges: a frontier join per level.  The start counts even without edges.

    Goes on until no level has new nodes; where `most` is given and nodes lie deeper, raises DepthLimit.  The edges are written once, for all levels.
    """
    edges = fixed(edges)
    frontier = edges.sparkSession.createDataFrame([(start, 0)], "node long, depth int")
    levels, depth = [frontier], 0
    frontier = frontier.hint("broadcast")  # of one row, whose size Spark does not know: the edges need no sort for it
    while True:
        depth += 1
        new = frontier.join(edges, frontier.node == edges.u).select(F.col("v").alias("node")).distinct().join(_all(levels), "node", "left_anti")
        frontier = fixed(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            release(edges, frontier)
            return _all(levels)
        if most is not None and depth > most:
            raise DepthLimit(f"nodes lie deeper than {most} levels")
        levels.append(frontier)
        if len(levels) > LEVELS:  # what was visited is written anew only now and then
            old, levels = levels, [fixed(_all(levels))]
            release(*(x for x in old if x is not frontier))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) once.

    Edges are dealt out before they are told apart, EDGES or about so many to a task; a table of them for each part of the input would grow
    with the part and save little where few edges repeat.
    """
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES))
    return edges.repartition(parts, "u", "v").distinct()


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def reachable(edges: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """(node) of what a search of either order visits; the order of a depth-first search has no distributed form."""
    return bfs(edges, start, most).select("node")


def subset_sums(a: Column) -> Column:
    """All sums of subsets of an integer array, distinct; 0 is one."""
    return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.array_union(s, F.transform(s, lambda y: y + x.cast("long"))))


def subset_sum(a: Column, target: int) -> Column:
    return F.array_contains(subset_sums(a), F.lit(target).cast("long"))


# stacks, queues and lists are arrays; each operation gives the new array or the value


def push(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def pop(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def peek(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def front(a: Column) -> Column:
    return F.get(a, F.lit(0))


def dequeue(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def prepend(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def remove_first(a: Column, x: Column) -> Column:
    at = F.array_position(a, x).cast("int")
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, 1, F.greatest(at - 1, F.lit(0))), F.slice(a, at + 1, F.size(a))))
