"""Paths on graphs whose edges are shared groups, without the edges; closures of nodes with the same parents."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import graph as G
from evigraph.operators import pairs as P
from evigraph.plans import paths
from evigraph.plans.catalog import Tables


def cost(a, b, n):
    return 0.1 + ((a * 31 + b * 17) % 23) / 23.0 + 1.0 / n


@pytest.mark.parametrize("groups, k, hops", [(12, 7, 4), (12, 5, 3), (12, 40, 5), (3, 4, 1)])
def test_as_on_the_graph_of_all_pairs(spark, groups, k, hops):
    rng = random.Random(groups + k)
    rows = spark.createDataFrame([(rng.randrange(groups), rng.randrange(30)) for _ in range(70)] + [(None, 3), (1, None)], "g int, m long").cache()
    pairs = P.co_occurring(rows, "g", "m").withColumn("cost", cost(F.col("node_a"), F.col("node_b"), F.col("n")))
    edges = pairs.select("node_a", "node_b", "cost").toDF("src", "dst", "cost").unionByName(pairs.select("node_b", "node_a", "cost").toDF("src", "dst", "cost"))
    want = sorted((round(r["cost"], 9), list(r["nodes"])) for r in G.top_paths(edges, 0, 29, k, hops).collect())
    for least, width in ((0.1, 2), (0.0, 64)):
        got = G.shared_group_paths(rows, "g", "m", cost, 0, 29, k, hops, least, width).collect()
        assert sorted((round(r["cost"], 9), list(r["nodes"])) for r in got) == want


def test_wide_paths_make_no_pairs(spark, monkeypatch):
    rows = [(1, i % 7, i % 5) for i in range(40)] + [(2, 3, None), (3, None, 2), (4, 99, 77)]
    orders = spark.createDataFrame(rows, "o_orderkey int, o_custkey long, o_orderdate int")
    pairs = P.co_occurring(orders, "o_orderdate", "o_custkey").withColumn("p", paths._p(F.col("node_a"), F.col("node_b"), F.col("n")))
    both = pairs.select("node_a", "node_b", "p").toDF("src", "dst", "p").unionByName(pairs.select("node_b", "node_a", "p").toDF("src", "dst", "p"))
    want = [(round(r["cost"], 9), list(r["nodes"])) for r in G.top_paths(G.costs(both, 0.5), 0, 6, paths.K, paths.HOPS).orderBy("cost", "nodes").collect()]
    known = {(r["src"], r["dst"]): r["p"] for r in both.collect()}

    monkeypatch.setattr(P, "co_occurring", None)
    t = Tables(spark, "nowhere")
    t.orders = orders
    found, used, ends = paths.ranked(t)
    assert ends == (0, 6)
    assert [(round(r["cost"], 9), list(r["nodes"])) for r in found.orderBy("rank").collect()] == want
    assert all(known[r["src"], r["dst"]] == pytest.approx(r["p"]) for r in used.collect())
    t.orders = orders.where("o_custkey = 1")
    none, _, ends = paths.ranked(t)
    assert ends == (None, None) and none.count() == 0


def test_closure_by_classes_of_nodes_with_the_same_parents(spark, monkeypatch):
    rng = random.Random(5)
    links = [(f"{i}.{a}", f"{i + 1}.{b}") for i in range(4) for a in range(6) for b in range(5)] + [(f"x{a}", f"x{b}") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25] + [("x1", "3.0"), ("0.0", "1.0"), ("a", None), (None, "b")]
    up = {}
    for a, b in links:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    want = set()
    for node in up:
        front, seen, distance = {node}, set(), 0
        while front:
            distance += 1
            front = {b for a in front for b in up.get(a, ())} - seen
            seen |= front
            want |= {(node, b, distance) for b in front}
    made, rows = G.cut, []
    monkeypatch.setattr(G, "cut", lambda df, name: (lambda got: (rows.append(got.count()) if name == "closure" else None, got)[1])(made(df, name)))
    got = [tuple(r) for r in G.closure(spark.createDataFrame(links, "child string, parent string")).collect()]
    assert sorted(got) == sorted(want)
    assert sum(rows) < len(want) / 2  # a row a pair of classes, not of nodes
