from tracewell.plans import graphs


def test_edges_called_once_count(spark, monkeypatch):
    """a - b - c - d, of which only a - b is called three times; every pair has one shortest way."""
    calls = [("a", "b")] * 3 + [("b", "c"), ("c", "d"), ("d", "c"), ("d", "d")]
    monkeypatch.setattr(graphs, "packages", lambda spark, d: spark.createDataFrame(calls, "src string, dst string"))
    got = {(r["a"], r["b"]): r["score"] for r in graphs.graph_edge_betweenness(spark, "").collect()}
    assert got == {("a", "b"): 0.5, ("b", "c"): round(4 / 6, 9), ("c", "d"): 0.5}
