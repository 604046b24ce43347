import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import hierarchy as H


def truth(par):
    out = {}
    for n in set(par) | set(par.values()):
        x, seen, way = n, set(), [n]
        while x in par and x not in seen:
            seen.add(x)
            x = par[x]
            way.append(x)
        out[n] = ("", -1, None) if x in seen else (x, len(way) - 1, way[::-1])
    return out


@pytest.mark.parametrize(("n", "at_most", "seed", "cell"), [(60, 400_000, 1, 13), (300, 20, 2, 3)])
def test_against_walk(spark, monkeypatch, n, at_most, seed, cell):
    monkeypatch.setattr(H, "CELL", cell)
    rnd = random.Random(seed)
    par = {f"n{i}": f"n{rnd.choice([max(0, i - 1), rnd.randrange(0, i), 0])}" for i in range(1, n)}
    par |= {"r1": "r2", "r2": "r3", "r3": "r1", "below": "r1", "deeper": "below", "self": "self", "two": "top"}
    rows = [(f" {c}\t", p, rnd.choice(["extends", " EXTENDS "]), 1) for c, p in par.items() for _ in range(rnd.choice([1, 2]))]
    rows += [("x", None, "extends", 1), ("y", "  ", "extends", 1), (None, "n1", "extends", 1), ("z", "n1", "implements", 1), ("n5", "zz", None, 1)]
    edges = spark.createDataFrame(rows, "child_fqn string, parent_fqn string, kind string, id int")
    spans = H.intervals(H.links(edges), at_most)
    want = truth(par)
    got = {r["name"]: r for r in spans.collect()}
    assert set(got) == set(want)
    for k, (root, depth, _) in want.items():
        assert (got[k]["root"], got[k]["depth"]) == (root, depth), k
    above = H.ancestors(spans)
    assert {(r["name"], r["ancestor"], r["steps"]) for r in above.collect()} == {
        (k, a, len(w) - 1 - i) for k, (_, _, w) in want.items() if w for i, a in enumerate(w[:-1])
    }
    paths = {r["name"]: r["path"] for r in H.paths(spans, above).collect()}
    assert all(paths[k] == (" > ".join(w) if w else None) for k, (_, _, w) in want.items())


def test_more_trees_than_one_task_ranks(spark):
    """Contraction ends although the lists are more than what is ranked in one task."""
    edges = spark.range(200).select(F.concat(F.lit("c"), "id").alias("child_fqn"), F.concat(F.lit("p"), (F.col("id") / 2).cast("int")).alias("parent_fqn"), F.lit("extends").alias("kind"))
    got = H.intervals(H.links(edges), 10).collect()
    assert len(got) == 300 and all(r["depth"] == (0 if r["name"][0] == "p" else 1) for r in got)
    assert all(r["root"] == (r["parent"] or r["name"]) for r in got)


def test_empty_and_only_rings(spark):
    schema = "child_fqn string, parent_fqn string, kind string"
    assert H.intervals(H.links(spark.createDataFrame([], schema))).count() == 0
    rings = H.intervals(H.links(spark.createDataFrame([("a", "b", "extends"), ("b", "a", "extends")], schema))).collect()
    assert {(r["name"], r["root"], r["depth"]) for r in rings} == {("a", "", -1), ("b", "", -1)}


def test_of_two_parents_the_smaller_name_holds(spark):
    edges = spark.createDataFrame([("c", "q", "extends"), ("c", "p", "extends")], "child_fqn string, parent_fqn string, kind string")
    assert H.links(edges).select(F.col("parent")).collect()[0][0] == "p"
