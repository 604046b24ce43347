from tracewell.operators import graph as G
from tracewell.plans.graphs import graph_ancestors


def brute(pairs):
    near, out = {}, set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    for root in near:
        seen, front, k = {root}, {root}, 0
        while front:
            k, front = k + 1, {w for u in front for w in near.get(u, ())} - seen
            seen |= front
            out |= {(root, w, k) for w in front}
    return out


def test_every_kind_and_any_depth(spark, tmp_path):
    kinds = ["extends", "implements", "embeds", "IMPLEMENTS", "implements ", None]
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("c0", "c40"), ("r", "s"), ("s", "t"), ("t", "r"), ("x", "x"), ("x", "c68")]
    rows = [(f" {a}", f"{b}\t", kinds[i % len(kinds)]) for i, (a, b) in enumerate(pairs)] + [("", "c1", "extends"), ("c1", " ", "extends"), (None, "c1", "extends")]
    spark.createDataFrame(rows, "child_fqn string, parent_fqn string, kind string").write.parquet(f"{tmp_path}/super_edges.parquet")
    got = [tuple(r) for r in graph_ancestors(spark, str(tmp_path)).select("root", "node", "steps").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pairs)


def test_one_task_equals_distributed_rounds(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(7)] + [("c0", "c4"), ("r", "s"), ("s", "r"), ("x", "x"), ("x", "c3")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    local, rounds = (sorted(map(tuple, G.reached(e, n).collect())) for n in (G.LOCAL_EDGES, 0))
    assert local == rounds == sorted(brute(pairs))
