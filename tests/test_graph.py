"""Chains, levels and closures of graphs that are deeper than a fixed number of rounds."""

import pytest

from plumbago.operators import graph

N = 70


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def line(spark, relation):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", relation, i) for i in range(N)], "source string, target string, relation string, edge_idx long").coalesce(1)
    return spark.createDataFrame([(f"n{i}",) for i in range(N + 1)], "id string").coalesce(1), edges


def test_long_chains_stay(spark):
    got = graph.chains(line(spark, "then")[1]).collect()
    assert [(r["head"], r["steps"]) for r in got] == [("n0", [f"n{i}" for i in range(N + 1)])]


def test_deep_levels(spark):
    nodes, edges = line(spark, "contains")
    got = {r["id"]: (r["level"], r["parent"]) for r in graph.levels(nodes, edges).collect()}
    assert got == {f"n{i}": (i, f"n{i - 1}" if i else None) for i in range(N + 1)}


def test_far_descendants(spark):
    got = {tuple(r) for r in graph.descendants(line(spark, "then")[1]).collect()}
    assert got == {(f"n{i}", f"n{j}") for i in range(N) for j in range(i + 1, N + 1)}


def test_a_later_chain_ends_before_a_taken_step(spark):
    rows = [("a", "b", "then", 0), ("b", "c", "leads to", 1), ("c", "d", "next step", 2), ("x", "y", "then", 3), ("y", "z", "then", 4), ("z", "b", "then", 5), ("p", "b", "then", 6), ("q", "q2", "likes", 7)]
    got = {r["head"]: r["steps"] for r in graph.chains(spark.createDataFrame(rows, "source string, target string, relation string, edge_idx long")).collect()}
    assert got == {"a": ["a", "b", "c", "d"], "x": ["x", "y", "z"]}
