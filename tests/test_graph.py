"""Searches along chains, whose depth no limit may cut without an error."""

import pytest

from tessera.errors import DepthLimit
from tessera.operators import graph


def test_bfs_limit(spark):
    chain = spark.range(6).selectExpr("id AS u", "id + 1 AS v")
    assert sorted(map(tuple, graph.bfs(chain, 0).collect())) == [(k, k) for k in range(7)]
    assert graph.bfs(chain, 0, 6).count() == 7
    for search in (graph.bfs, graph.reachable):
        with pytest.raises(DepthLimit):
            search(chain, 0, 3)


def test_bfs_goes_on(spark, monkeypatch):
    # levels played without Spark, two joins each, far past the former limit of 1000 levels
    class Frame:
        sparkSession = None

        def __init__(self, last):
            self.last = last

        def isEmpty(self):
            return self.last > 3000

        def unionByName(self, other):
            return other

        def __getattr__(self, name):
            if name in ("node", "u"):
                return 0
            return (lambda *a, **k: Frame(self.last + 1)) if name == "join" else (lambda *a, **k: self)

    start = Frame(0)
    start.sparkSession = type("S", (), {"createDataFrame": staticmethod(lambda *a: Frame(0))})()
    monkeypatch.setattr(graph, "fixed", lambda f: f)
    assert 2000 < graph.bfs(start, 0).last <= 3000


def test_distinct_edges_in_parts(spark, monkeypatch):
    # one partition holds all rows; tasks that tell them apart hold about EDGES each, however many there are
    monkeypatch.setattr(graph, "EDGES", 500)
    edges = spark.range(0, 20_000, 1, 1).selectExpr("id % 7000 AS u", "-1 - id % 7000 AS v")
    parted = graph.distinct_edges(edges)
    sizes = [n for n, in parted.selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    assert sum(sizes) == 7000 and len(sizes) == 40 and max(sizes) < 500
    assert parted._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_edges_go_to_few_tasks(spark):
    # a million edges are no reason for more tasks than the session asks for
    edges = spark.range(0, 1_200_000, 1, 2).selectExpr("id AS u", "-1 - id AS v")
    assert graph.distinct_edges(edges).rdd.getNumPartitions() == 4


def test_edges_are_read_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "fixed", lambda df, f=graph.fixed: (written.append(df.columns), f(df))[1])
    chain = spark.range(4).selectExpr("id AS u", "id + 1 AS v")
    assert graph.bfs(chain, 0).count() == 5 and written.count(["u", "v"]) == 1
