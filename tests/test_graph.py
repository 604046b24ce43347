import random

import pytest

from tracewell.operators import graph as G


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def edges(spark):
    rnd = random.Random(2)
    pairs = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "n1"), ("n1", None), ("x", "y")]
    return spark.createDataFrame([(a, b, "clash") for a, b in pairs], "src string, dst string, rank string")


def test_one_task_equals_distributed_rounds(spark, edges):
    weighted = edges.groupBy("src", "dst").count().selectExpr("src", "dst", "cast(count as double) weight")
    for f in (G.page_rank, G.hits, G.components):
        assert rows(f(edges)) == rows(f(edges, local_edges=0))
    seeds = {"n1": 9.0, "n2": 1.0, "nowhere": 5.0, "x": -1.0}
    assert rows(G.personal_rank(weighted, seeds)) == rows(G.personal_rank(weighted, seeds, local_edges=0))
    assert rows(G.personal_rank(weighted, {k: v * 10 for k, v in seeds.items()})) == rows(G.personal_rank(weighted, seeds))


def test_strong_components_and_betweenness_by_joins(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(62)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("self", "self")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = rows(G.strong_components(e, local_edges=0))
    assert got == rows(G.strong_components(e)) and ("y", "x", 3) in got and any(size > 3 for _, _, size in got)
    assert rows(G.edge_betweenness(e, local_nodes=5)) == rows(G.edge_betweenness(e))
    assert rows(G.edge_betweenness(e, local_nodes=5, max_sources=7)) == rows(G.edge_betweenness(e, max_sources=7))


def test_restart_walks(spark):
    e = lambda *p: spark.createDataFrame([(a, b, 1.0) for a, b in p], "src string, dst string, weight double")
    r = dict(G.personal_rank(e(("A", "B"), ("B", "C"), ("D", "D")), {"A": 1.0}, rounds=20).collect())
    assert r["B"] > r["C"] and r["A"] > r["D"] == 0
    r = dict(G.personal_rank(e(("B", "A")), {"A": 1.0}, rounds=30).collect())
    assert r["A"] > 0.5 > r["B"]
    assert sum(dict(G.page_rank(e(("A", "B"), ("C", "B"))).collect()).values()) == pytest.approx(1)


def test_best_paths(spark):
    schema = "src string, dst string, confidence string, score double"
    e = spark.createDataFrame([("a", "b", "ambiguous", 0.2), ("b", "d", "ambiguous", 0.2), ("a", "c", "extracted", 1.0), ("c", "d", "extracted", 1.0)], schema)
    assert [r.path for r in G.best_path(e, "a", "d", 4).collect()] == ["a > c > d"]
    e = spark.createDataFrame([("a", "b", "", 0.0), ("c", "b", "", 0.0), ("x", "y", "", 0.0)], schema)
    assert [(r.hops, r.path) for r in G.best_path(e, "a", "c", 8).collect()] == [(2, "a > b > c")]
    assert G.best_path(e, "a", "y", 8).count() == 0


def test_communities_and_cores(spark):
    e = spark.createDataFrame([("alpha", "beta"), ("beta", "alpha"), ("gamma", "beta"), ("selflink", "self")], "src string, dst string")
    label = dict(G.label_propagation(e).collect())
    assert len({label[x] for x in ("alpha", "beta", "gamma")}) == 1 and label["self"] != label["alpha"]
    strong = {r["node"]: r["size"] for r in G.strong_components(e).collect()}
    assert strong == {"alpha": 2, "beta": 2, "gamma": 1, "selflink": 1, "self": 1}
    assert rows(G.mutual(e)) == [("alpha", "beta"), ("beta", "alpha")]
    assert rows(G.min_degree(e, 2)) == [("alpha", "beta"), ("beta", "alpha")]
    b = {(r.a, r.b): r.score for r in G.edge_betweenness(e).collect()}
    assert b[("alpha", "beta")] == pytest.approx(2 / 10) and len(b) == 3


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    for f in (G.page_rank, G.hits, G.components, G.label_propagation, G.strong_components, G.degrees, G.edge_betweenness, G.mutual, lambda e: G.min_degree(e, 2)):
        assert f(none).count() == 0
    for f in (G.page_rank, G.hits, G.components):
        assert f(none, local_edges=-1).count() == 0
