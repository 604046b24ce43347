import pytest
from pyspark.sql import functions as F

from tracewell.operators import ranking as K
from tracewell.operators import search as Q
from tracewell.operators import typed as Y


def test_evidence(spark):
    rows = [("a", "o", "t1", "lexical", 0.8, "x"), ("a", "o", "t1", "lexical", 0.8, "x"), ("a", "o", "t1", "lexical", 0.4, "y"), ("a", "o", "t2", "semantic", 0.5, ""), ("b", "o", "t1", "lexical", 0.9, ""), ("c", "p", "path_exact", "lexical", 0.1, "")]
    e = spark.createDataFrame(rows, "handle string, owner string, type string, channel string, score double, fact string")
    c = {(r.handle, r.channel): r.score for r in K.channel_scores(K.bounded(e)).collect()}
    assert c[("a", "lexical")] == pytest.approx(1.0) and c[("a", "semantic")] == 0.5
    assert K.bounded(e).where("handle = 'a'").count() == 3
    got = [(r.handle, r.tier) for r in K.ranked(K.bounded(e), {"lexical": 1.0, "semantic": 1.0}, 1, 10).collect()]
    assert got == [("c", 2), ("a", 0)]
    assert K.ranked(K.bounded(e.limit(0)), {"lexical": 1.0}, 1, 10).count() == 0


def test_nearest_rank_and_buckets(spark):
    df = spark.createDataFrame([("g", round(1 - i / 10, 1), f"n{i}") for i in range(10)], "g string, v double, name string")
    r = K.nearest_rank(df, ["g"], "v", [0.5, 0.95]).first()
    assert (round(r["mean"], 2), r.p50, r.p95) == (0.55, 0.5, 1.0)
    b = K.equal_buckets(df, ["g"], "v", "name").collect()
    assert sorted((x.bucket, x.n, x.high, x.low, x.example) for x in b)[0] == (0, 2, 1.0, 0.9, "n0") and len(b) == 5


def test_caps_and_turns(spark):
    df = spark.createDataFrame([(i % 2, i % 3, i) for i in range(12)], "a int, b int, v int")
    kept = K.capped_twice(df, "a", "b", [F.asc("v")], 3, 2).collect()
    assert max(sum(r.a == k for r in kept) for k in (0, 1)) <= 3 and max(sum(r.b == k for r in kept) for k in range(3)) <= 2
    turns = [r.a for r in K.interleaved(df, "a", "a", [F.asc("v")], 5).collect()]
    assert turns == [0, 1, 0, 1, 0]
    assert [p["id"] for p in K.packed_plans([{"id": 1, "size": 5, "utility": 5}, {"id": 2, "size": 9, "utility": 30}, {"id": 1, "size": 1, "utility": 1.5}], 10)] == [2, 1]
    assert K.opened_tree({"": 0, "a": 1, "b": 3, "b/c": 2, "b/d": 0.5}, 3) == ["b", "a", "b/c"]


def test_measures(spark):
    results = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query string, doc string, rank int")
    judged = spark.createDataFrame([("q", "d1", 0), ("q", "d2", 3), ("q", "d3", 1), ("none", "d1", 2)], "query string, doc string, grade int")
    r = {x.query: x for x in K.ndcg(results, judged, 2).collect()}
    assert r["q"].recall == 0.5 and r["q"].precision == 0.5 and r["none"].ndcg == 0
    assert r["q"].ndcg == pytest.approx((7 / 1.5849625) / (7 + 1 / 1.5849625), rel=1e-6)


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [-1.0, 0.0])], "k int, v array<float>")
    got = [(r.k, round(r.score, 4)) for r in Q.nearest(v, "k", "v", {9: [2.0, 0.0]}, 2).orderBy(F.desc("score")).collect()]
    assert got == [(1, 1.0), (2, 0.7071)]
    with pytest.raises(ValueError):
        Q.nearest(v, "k", "v", {9: [0.0, 0.0]}, 2)
    assert Q.nearest(v, "k", "v", {}, 2).count() == 0


def test_diversified_and_reranked(spark):
    h = spark.createDataFrame([("o", "h", k, p) for p, k in enumerate([4, 5, 6, 3, 9])] + [("p", "h", 4, 5)], "owner string, heading string, ord long, place long")
    assert [r.ord for r in Q.diversified(h, 10).collect()] == [4, 6, 9, 4]
    r = spark.createDataFrame([("a", 1, 1.0, False), ("b", 2, 0.9, True), ("c", 3, 0.8, False)], "handle string, place int, score double, pinned boolean")
    s = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1.0)], "handle string, second double")
    assert {x.handle: x.place for x in Q.reranked(r, s).collect()} == {"c": 1, "b": 2, "a": 3}


def test_query_words():
    assert Q.query_words("the offlineSync of a note") == ["offline", "sync", "note"]
    assert Q.query_words("of the") == ["of", "the"] and Q.query_words("a") == []


def test_typed_errors():
    s = Y.Schema({"T": {"a": "bool", "n": "int"}})
    s.check(Y.Plan(("T",), (Y.Filter("n", "gt", (1,), "int"),)))
    for bad in (Y.Plan(("U",)), Y.Plan(("T",), (Y.Filter("x", "eq", (1,)),)), Y.Plan(("T",), (Y.Filter("a", "gt", (1,)),)), Y.Plan(("T",), (), (Y.Sort("a"),))):
        with pytest.raises(ValueError):
            s.check(bad)


def test_typed_presence(spark):
    n = spark.createDataFrame([(i, "T", f"p{i}", 0, "t") for i in range(5)], "node_id long, type_name string, note_path string, start_byte int, title string")
    v = spark.createDataFrame([(0, "T", "f", "string", "x", None, None, 0, "value"), (0, "T", "f", "string", "y", None, None, 1, "value"), (1, "T", "f", "string", "y", None, None, 0, "value"), (2, "T", "f", "string", "", None, None, 0, "null"), (3, "T", "f", "array", "x", None, None, 0, "value")], "node_id long, type_name string, field_name string, value_kind string, value_norm string, value_num double, target_node_id long, ordinal int, presence string")
    ids = lambda op, *vals: [r.node_id for r in Y.page(n, v, Y.Plan(("T",), (Y.Filter("f", op, vals),))).collect()]
    assert ids("eq", "x") == [0] and ids("neq", "x") == [1, 2, 3, 4] and ids("exists") == [0, 1, 3] and ids("missing") == [2, 4] and ids("contains", "y") == [0, 1]
    order = [r.node_id for r in Y.page(n, v, Y.Plan(("T",), (), (Y.Sort("f", True),), 3, 1)).collect()]
    assert order == [1, 3, 2]
    assert "Sort" in Y.explained(n, v, Y.Plan(("T",))) or "TakeOrdered" in Y.explained(n, v, Y.Plan(("T",)))


def test_ranks_in_slabs(spark):
    """Ties across slab borders, a null key, one value that most rows hold."""
    import math

    values = [5.0] * 300 + [float(i % 37) for i in range(150)] + [float(i) for i in range(60)]
    rows = [("a", v, f"r{i:04d}") for i, v in enumerate(values)] + [(None, 1.0, "x"), (None, 2.0, "y"), ("b", None, "z")]
    df = spark.createDataFrame(rows, "k string, v double, name string")
    got = {r.k: r for r in K.nearest_rank(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    order = sorted(values)
    assert [got["a"][f"p{q}"] for q in (10, 50, 90)] == [order[math.ceil(q / 100 * len(order)) - 1] for q in (10, 50, 90)]
    assert (got["a"].n, got["a"].max, round(got["a"].mean, 9)) == (len(values), 59.0, round(sum(values) / len(values), 9))
    assert (got[None].p50, got[None].n) == (1.0, 2) and "b" not in got
    buckets = sorted((r.bucket, r.n, r.low, r.high, r.example) for r in K.equal_buckets(df, ["k"], "v", "name").where("k = 'a'").collect())
    ranked = sorted((-v, f"r{i:04d}") for i, v in enumerate(values))
    size = math.ceil(len(ranked) / 10)
    want = [ranked[i : i + size] for i in range(0, len(ranked), size)]
    assert buckets == [(i, len(w), -w[-1][0], -w[0][0], w[0][1]) for i, w in enumerate(want)]
