"""Graph operators over edge frames (src, dst[, kind, weight, confidence]).

Iterations have fixed counts and run as joins and aggregations; what a round hands on is written every few rounds, so plans stay
short and a lost executor costs a few rounds. Graphs of at most LOCAL_EDGES distinct edges (a documented bound, 16 bytes an edge)
are iterated in one task instead, where a round costs a millisecond; both ways give the same numbers, and larger graphs no others.

Null ends are no edges; repeated edges count once unless weighted; self-loops are kept unless said otherwise; an empty graph has
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import confidence, surprise_factor
from tracewell.runtime import written

LOCAL_EDGES = 200_000
#: Rounds between two written tables.
ROUNDS = 5


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()


def _in_one_task(edges: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, cols: list[str]) -> DataFrame:
    """f(src, dst, other columns by number, names) on node numbers, run on all edges in one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [p for p in parts if len(p)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        names, numbers = np.unique(np.r_[rows["src"].to_numpy(object), rows["dst"].to_numpy(object)].astype(str), return_inverse=True)
        n = len(rows)
        yield pd.DataFrame({"node": names} | f(numbers[:n], numbers[n:], rows, names))

    return edges.select("src", "dst", *cols).repartition(1).mapInPandas(run, schema)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, inbound, outbound) of distinct edges, with partial sums before the shuffle."""
    e = distinct_edges(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge, and dead ends: linked to, linking nowhere."""
    d = nodes.join(degrees(edges), "node", "left").select("node", F.coalesce("inbound", F.lit(0)).alias("i"), F.coalesce("outbound", F.lit(0)).alias("o"))
    return d.where("o = 0").select("node", F.when(F.col("i") == 0, "orphan").otherwise("dead_end").alias("state"))


def _rank_local(damping, rounds, seeds):
    def f(src, dst, rows, names):
        n = len(names)
        weight = rows["weight"].to_numpy(float) if seeds is not None else np.ones(len(src))
        out = np.bincount(src, weight, n)
        p = np.full(n, 1 / n)
        if seeds is not None:
            p = np.array([max(0.0, seeds.get(x, 0.0)) for x in names])
            p = p / p.sum() if p.sum() > 0 else p
        share = weight / np.where(out[src] > 0, out[src], 1)
        r = p.copy()
        for _ in range(rounds if p.sum() > 0 else 0):
            r = damping * np.bincount(dst, r[src] * share, n) + (1 - damping + damping * r[out == 0].sum()) * p
        return {"rank": r}

    return f


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, rank): uniform start, dangling mass spread over all nodes."""
    e = written(distinct_edges(edges)).df
    if e.count() <= local_edges:
        return _in_one_task(e, _rank_local(damping, rounds, None), "node string, rank double", [])
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.count()
    return _iterate(e.withColumn("weight", F.lit(1.0)), nodes.withColumn("p", F.lit(1.0 / max(n, 1))), damping, rounds)


def personal_rank(edges: DataFrame, seeds: dict[str, float], damping: float = 0.85, rounds: int = 15, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, rank) of a walk over weighted edges (src, dst, weight) that restarts at the seeds; dangling mass goes to the seeds.
    Seeds outside the graph and with no positive weight don't count; without any, every rank is 0."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("weight") > 0) & ~F.isnan("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    e = written(e).df
    seeds = {k.strip(): v for k, v in seeds.items() if k.strip() and v > 0 and v == v and v != float("inf")}
    if e.count() <= local_edges:
        return _in_one_task(e, _rank_local(damping, rounds, seeds), "node string, rank double", ["weight"])
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in seeds.items() for x in kv]), F.col("node")), F.lit(0.0)) if seeds else F.lit(0.0)
    start = nodes.withColumn("raw", raw)
    total = start.agg(F.sum("raw").alias("total"))
    p = start.withColumn("total", total.scalar()).select("node", F.coalesce(F.try_divide("raw", "total"), F.lit(0.0)).alias("p"))
    return _iterate(e, p, damping, rounds)


def _iterate(e: DataFrame, start: DataFrame, damping: float, rounds: int) -> DataFrame:
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    share = written(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))).df
    base = written(start.join(out.select(F.col("src").alias("node"), F.lit(1).alias("leads")), "node", "left").select("node", "p", F.col("leads").isNull().alias("dangling"))).df
    table = written(base.withColumn("rank", F.col("p")))
    state = table.df
    for i in range(rounds):
        flow = share.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        state = base.join(flow, "node", "left").withColumn("lost", lost.scalar()).select(
            "node", "p", "dangling", (damping * F.coalesce("flow", F.lit(0.0)) + (1 - damping + damping * F.col("lost")) * F.col("p")).alias("rank")
        )
        if (i + 1) % ROUNDS == 0 or i + 1 == rounds:
            after = written(state)
            table.drop()
            table, state = after, after.df
    return state.select("node", "rank")


def hits(edges: DataFrame, rounds: int = 30, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, hub, authority): authorities first, hubs from the new authorities, both with length 1."""
    e = written(distinct_edges(edges)).df
    unit = lambda x: x / (np.linalg.norm(x) or 1.0)

    def f(src, dst, rows, names):
        n = len(names)
        hub = authority = np.ones(n)
        for _ in range(rounds):
            authority = np.bincount(dst, hub[src], n).astype(float)
            hub = np.bincount(src, authority[dst], n).astype(float)
            authority, hub = unit(authority), unit(hub)
        return {"hub": hub, "authority": authority}

    if e.count() <= local_edges:
        return _in_one_task(e, f, "node string, hub double, authority double", [])
    nodes = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()).df
    table = written(nodes.select("node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))
    for _ in range(rounds):
        a = e.join(table.df.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
        a = written(a)
        h = e.join(a.df.select(F.col("node").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("h"))
        both = nodes.join(a.df, "node", "left").join(h, "node", "left").select("node", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h"))
        both = written(both)
        length = lambda c: both.df.agg(F.sqrt(F.sum(F.col(c) * F.col(c)))).scalar()  # noqa: B023, E731
        after = written(both.df.withColumn("na", length("a")).withColumn("nh", length("h")).select("node", F.coalesce(F.try_divide("h", "nh"), F.lit(0.0)).alias("hub"), F.coalesce(F.try_divide("a", "na"), F.lit(0.0)).alias("authority")))
        for t in (table, a, both):
            t.drop()
        table = after
    return table.df


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the smallest node that is connected, directions aside. Each round takes the neighbours' smallest label and
    then the label's label, so the rounds grow with the logarithm of the longest way."""
    e = distinct_edges(edges)
    both = written(e.union(e.select("dst", "src")).distinct()).df

    def f(src, dst, rows, names):
        label = np.arange(len(names))
        while True:
            new = label.copy()
            np.minimum.at(new, src, label[dst])
            new = new[new]
            if (new == label).all():
                return {"component": names[label]}
            label = new

    if both.count() <= local_edges:
        return _in_one_task(both, f, "node string, component string", [])
    table = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(table.df.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = table.df.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        low = written(low)
        jump = low.df.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = written(low.df.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = after.df.where("old <> component").limit(1).count()
        low.drop()
        table.drop()
        table = after
        if not changed:
            return table.df.select("node", "component")


#: A weak component of more edges than these is not given to one task by what is sequential by definition.
COMPONENT_EDGES = 5_000_000


def _per_component(edges: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    e = written(distinct_edges(edges)).df
    placed = written(e.join(components(e).withColumnRenamed("node", "src"), "src")).df
    largest = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    if largest > COMPONENT_EDGES:
        raise ValueError(f"a component has {largest} edges; what is sequential by definition takes at most {COMPONENT_EDGES}")
    return placed.groupBy("component").applyInPandas(f, schema)


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): nodes in order take the label most neighbours have, the smallest of equal ones, each seeing the labels changed
    before it in the same round. That order makes it sequential, so it runs per connected component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in zip(rows["src"], rows["dst"], strict=True):
            near.setdefault(a, set())
            near.setdefault(b, set())
            if a != b:
                near[a].add(b)
                near[b].add(a)
        label = {v: v for v in near}
        for _ in range(rounds):
            changed = False
            for v in sorted(near):
                votes: dict[str, int] = {}
                for u in near[v]:
                    votes[label[u]] = votes.get(label[u], 0) + 1
                if votes and (best := min(votes, key=lambda x: (-votes[x], x))) != label[v]:
                    label[v], changed = best, True
            if not changed:
                break
        return pd.DataFrame({"node": list(label), "label": list(label.values())})

    return _per_component(edges, run, "node string, label string")


def _strong_local(rows: pd.DataFrame) -> pd.DataFrame:
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
        back.setdefault(b, []).append(a)
    seen, order = set(), []
    for v in sorted(ahead):
        if v in seen:
            continue
        seen.add(v)
        stack = [(v, iter(ahead[v]))]
        while stack:
            u, it = stack[-1]
            w = next((x for x in it if x not in seen), None)
            if w is None:
                order.append(u)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(ahead[w])))
    out: dict[str, str] = {}
    for v in reversed(order):
        if v in out:
            continue
        out[v], todo, group = v, [v], [v]
        while todo:
            for w in back.get(todo.pop(), []):
                if w not in out:
                    out[w] = v
                    todo.append(w)
                    group.append(w)
        low = min(group)
        for w in group:
            out[w] = low
    return pd.DataFrame({"node": list(out), "component": list(out.values())})


def _strong_joined(e: DataFrame) -> DataFrame:
    """Forward-backward reachability: every node takes the smallest name that reaches it; the nodes of a colour that reach its name in
    turn are its strong component and leave; the rest goes on. Nodes without a way in or out leave first, each by itself."""
    src, dst = F.col("src").alias("node"), F.col("dst").alias("node")
    now, done = written(e.where("src <> dst")).df, []
    every = e.select(src).union(e.select(dst)).distinct()
    while not now.isEmpty():
        left = now.count()
        while True:
            kept = now.join(now.select(dst).distinct().withColumnRenamed("node", "src"), "src", "left_semi").join(now.select(src).distinct().withColumnRenamed("node", "dst"), "dst", "left_semi")
            now = written(kept.select("src", "dst")).df
            before, left = left, now.count()
            if left == before:
                break
        if not left:
            break
        colour = written(now.select(src).distinct().withColumn("colour", F.col("node"))).df
        while True:
            pushed = now.join(colour.withColumnRenamed("node", "src"), "src").groupBy(dst).agg(F.min("colour").alias("pushed"))
            after = written(colour.join(pushed, "node", "left").select("node", F.least("colour", "pushed").alias("colour"), (F.col("pushed") < F.col("colour")).alias("changed"))).df
            colour = after.select("node", "colour")
            if after.where("changed").isEmpty():
                break
        one = now.join(colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "cs"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "cd"), "dst").where("cs = cd")
        one = written(one.select("src", "dst", F.col("cs").alias("colour"))).df
        front = colour.where("node = colour")
        found = front
        while not front.isEmpty():
            back = one.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(src, "colour").distinct()
            front = written(back.join(found, ["node", "colour"], "left_anti")).df
            found = written(found.unionByName(front)).df
        done.append(found)
        gone = found.select("node")
        now = written(now.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")).df
    rings = every.select("node", F.col("node").alias("component")).limit(0)
    for found in done:
        rings = rings.unionByName(found.select("node", F.col("colour").alias("component")))
    return every.join(rings, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component, size): the smallest node of the strong component."""
    e = written(distinct_edges(edges)).df
    if e.count() <= local_edges:
        found = e.repartition(1).mapInPandas(lambda parts: (_strong_local(pd.concat(got)) for got in [[p for p in parts if len(p)]] if got), "node string, component string")
    else:
        found = _strong_joined(e)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")


def best_path(edges: DataFrame, start: str, end: str, max_hops: int) -> DataFrame:
    """(cost, hops, path) of the best way, directions aside, in at most so many hops: least sum of 1 - confidence, then fewest hops,
    then the smallest path. One row or none. edges: (src, dst, confidence, score). Each layer keeps one best way per node."""
    cost = 1 - confidence(F.col("confidence"), F.col("score"))
    e = edges.where("src is not null and dst is not null").select("src", "dst", cost.alias("c"))
    both = e.union(e.select("dst", "src", "c")).groupBy("src", "dst").agg(F.min("c").alias("c"))
    both = written(both).df
    layer = both.sparkSession.createDataFrame([(start, 0.0, start)], "node string, cost double, path string")
    reached = []
    for hop in range(1, max_hops + 1):
        ways = layer.join(both, layer["node"] == both["src"]).select(F.col("dst").alias("node"), F.round(F.col("cost") + F.col("c"), 9).alias("cost"), F.concat("path", F.lit(" > "), F.col("dst")).alias("path"))
        layer = written(ways.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("b")).select("node", "b.cost", "b.path")).df
        reached.append(layer.where(F.col("node") == end).select("cost", F.lit(hop).alias("hops"), "path"))
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    return out.orderBy("cost", "hops", "path").limit(1)


def edge_betweenness(edges: DataFrame, local_nodes: int = 5000, max_sources: int = 500) -> DataFrame:
    """(a, b, score) of undirected edges: shares of shortest ways through an edge from at most so many sources (the first by name, a
    limit that is part of the measure), halved and normalised by the pairs. Graphs of up to local_nodes are searched source by source
    with all edges in every task; larger ones layer by layer with joins."""
    e = distinct_edges(edges).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = written(e).df
    spark = e.sparkSession
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    # One more than the bound tells whether it is kept, and bounds what comes to the driver.
    names = [r[0] for r in nodes.limit(local_nodes + 1).collect()]
    if not names:
        return spark.createDataFrame([], "a string, b string, score double")
    if len(names) > local_nodes:
        return _betweenness_joined(e, nodes, max_sources)
    names.sort()
    number = {v: i for i, v in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    for r in e.toLocalIterator():
        near[number[r["a"]]].append(number[r["b"]])
        near[number[r["b"]]].append(number[r["a"]])
    shared = spark.sparkContext.broadcast(near)
    sources = spark.range(min(len(names), max_sources)).repartition(min(64, len(names)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, total = shared.value, {}
        for p in parts:
            for s in p["id"]:
                order, depth, ways, before = [s], {s: 0}, {s: 1.0}, {s: []}
                for u in order:
                    for w in near[u]:
                        if w not in depth:
                            depth[w], ways[w], before[w] = depth[u] + 1, 0.0, []
                            order.append(w)
                        if depth[w] == depth[u] + 1:
                            ways[w] += ways[u]
                            before[w].append(u)
                flow = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for u in before[w]:
                        c = ways[u] / ways[w] * (1 + flow[w])
                        flow[u] += c
                        k = (min(u, w), max(u, w))
                        total[k] = total.get(k, 0.0) + c
        if total:
            yield pd.DataFrame({"x": [k[0] for k in total], "y": [k[1] for k in total], "part": list(total.values())})

    n = len(names)
    sums = sources.mapInPandas(run, "x long, y long, part double").groupBy("x", "y").agg(F.sum("part").alias("s"))
    lookup = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    named = sums.join(lookup.select(F.col("id").alias("x"), F.col("name").alias("a")), "x").join(lookup.select(F.col("id").alias("y"), F.col("name").alias("b")), "y")
    return named.select("a", "b", (F.col("s") / 2 / max(1.0, n * (n - 1) / 2)).alias("score"))


def _betweenness_joined(e: DataFrame, nodes: DataFrame, max_sources: int) -> DataFrame:
    """Ways are counted layer by layer from all sources at once, then handed back from the last layer on. A layer's neighbours lie in the
    layers beside it, so only two are looked at for what is new."""
    both = written(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select("b", "a"))).df
    n = nodes.count()
    first = nodes.orderBy("node").limit(max_sources).select(F.col("node").alias("s"), "node", F.lit(1.0).alias("ways"))
    layers = [written(first).df]
    while True:
        now = layers[-1]
        ahead = now.join(both, now["node"] == both["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        for past in layers[-2:]:
            ahead = ahead.join(past.select("s", "node"), ["s", "node"], "left_anti")
        after = written(ahead).df
        if after.isEmpty():
            break
        layers.append(after)
    parts = []
    flow = layers[-1].withColumn("flow", F.lit(0.0))
    for nearer in reversed(layers[:-1]):
        far = flow.select("s", F.col("node").alias("w"), F.col("ways").alias("far_ways"), "flow")
        steps = far.join(both, far["w"] == both["src"]).select("s", "w", "far_ways", "flow", F.col("dst").alias("node")).join(nearer, ["s", "node"])
        steps = written(steps.select("s", "node", "w", (F.col("ways") / F.col("far_ways") * (1 + F.col("flow"))).alias("c"))).df
        parts.append(written(steps.groupBy(F.least("node", "w").alias("a"), F.greatest("node", "w").alias("b")).agg(F.sum("c").alias("c"))).df)
        back = steps.groupBy("s", "node").agg(F.sum("c").alias("flow"))
        flow = nearer.join(back, ["s", "node"], "left").select("s", "node", "ways", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    total = e.select("a", "b", F.lit(0.0).alias("c"))
    for part in parts:
        total = total.unionByName(part)
    return total.groupBy("a", "b").agg((F.sum("c") / 2 / max(1.0, n * (n - 1) / 2)).alias("score")).where("score > 0")


def surprising(edges: DataFrame, scores: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Edges (src, dst, kind, confidence, score) no one wrote on purpose, by how unexpected they are; of each pair of communities the
    best, edges without communities all. scores: (node, type, community, inbound, outbound, authority). Written links, self-loops
    and ends that are pure hubs (over 50 out, under 3 in) don't count."""
    side = lambda p: scores.select(*[F.col(c).alias(f"{p}_{c}") for c in scores.columns])
    written_links = F.col("kind").isin("wikilink", "mdlink") | F.col("kind").startswith("note_link:")
    e = edges.where((F.col("src") != F.col("dst")) & ~written_links)
    e = e.join(side("s"), F.col("src") == F.col("s_node"), "left").join(side("d"), F.col("dst") == F.col("d_node"), "left")
    hub = lambda p: F.coalesce((F.col(f"{p}_outbound") > 50) & (F.col(f"{p}_inbound") < 3), F.lit(False))
    e = e.where(~hub("s") & ~hub("d"))
    both = F.col("s_node").isNotNull() & F.col("d_node").isNotNull()
    known = both & (F.coalesce("s_community", F.lit("")) != "") & (F.coalesce("d_community", F.lit("")) != "")
    s_degree, d_degree = F.col("s_inbound") + F.col("s_outbound"), F.col("d_inbound") + F.col("d_outbound")
    add = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    total = (
        surprise_factor(F.col("confidence"), F.col("score")) + add(known & (F.col("s_community") != F.col("d_community")), 2.0) + add(both & (F.col("s_type") != F.col("d_type")), 2.0)
        + add(both & (F.least(s_degree, d_degree) <= 2) & (F.greatest(s_degree, d_degree) >= 8), 1.5) + add(both & (F.col("s_authority") < 0.1) & (F.col("d_authority") < 0.1), 1.0)
    )
    e = e.withColumn("surprise", total).where(F.col("surprise") >= min_score)
    pair = F.when(known, F.concat_ws("\u0001", F.least("s_community", "d_community"), F.greatest("s_community", "d_community"))).otherwise(F.concat_ws("\u0002", "src", "dst", "kind"))
    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc(F.round("surprise", 9)), "src", "dst", "kind"))
    return e.withColumn("pair", pair).withColumn("place", place).where("place = 1").select("src", "dst", "kind", "surprise")


def bridges(edges: DataFrame, communities: DataFrame, top: int = 5) -> DataFrame:
    """(community, node, crossing): per community the nodes with most edges into others. communities: (node, community)."""
    e = distinct_edges(edges)
    a, b = communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    cross = e.join(a, "src").join(b, "dst").where("ca <> cb")
    ends = cross.select(F.col("src").alias("node"), F.col("ca").alias("community")).union(cross.select("dst", "cb"))
    counted = ends.groupBy("community", "node").agg(F.count(F.lit(1)).alias("crossing"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("crossing"), "node"))
    return counted.withColumn("place", place).where(F.col("place") <= top).drop("place")


def community_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, members, anchor, density) of nodes (node, community, authority): the anchor has the highest authority, then the
    smallest name; density is the mean degree over members - 1."""
    d = nodes.select("node", "community", "authority").join(degrees(edges), "node", "left").withColumn("degree", F.coalesce(F.col("inbound") + F.col("outbound"), F.lit(0)))
    g = d.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct((-F.col("authority")).alias("x"), "node")).alias("best"), F.sum("degree").alias("total"))
    dense = F.when(F.col("members") > 1, F.col("total") / F.col("members") / (F.col("members") - 1)).otherwise(0.0)
    return g.select("community", "members", F.col("best.node").alias("anchor"), dense.alias("density"))


def mutual(edges: DataFrame) -> DataFrame:
    e = distinct_edges(edges)
    return e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")


def min_degree(edges: DataFrame, least: int) -> DataFrame:
    """The edges that are left when nodes with fewer edges (in and out) are dropped again and again."""
    now = written(distinct_edges(edges))
    size = now.df.count()
    while True:
        keep = degrees(now.df).where(F.col("inbound") + F.col("outbound") >= least).select("node")
        kept = now.df.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
        after = written(kept.select("src", "dst"))
        n = after.df.count()
        now.drop()
        now = after
        if n == size:
            return now.df
        size = n


def recency(edges: DataFrame, times: DataFrame, now: str, fresh_days: int, offset_days: int, sample: int, passes: int = 1) -> DataFrame:
    """(node, at): the later of a node's own time and those of its newest neighbours (either direction, at most `sample`, not older
    than the window) less the offset; further passes go on from there. times: (node, at); times after now count as now."""
    cap = F.lit(now).cast("timestamp")
    e = distinct_edges(edges)
    both = written(e.union(e.select("dst", "src")).distinct()).df
    own = times.where("at is not null").select("node", F.least("at", cap).alias("at"))
    current = own
    for _ in range(passes):
        near = both.join(current.select(F.col("node").alias("dst"), "at"), "dst")
        place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("at"), "dst"))
        near = near.withColumn("place", place).where((F.col("place") <= sample) & (F.col("at") >= cap - F.make_dt_interval(F.lit(fresh_days))))
        lifted = near.groupBy(F.col("src").alias("node")).agg((F.max("at") - F.make_dt_interval(F.lit(offset_days))).alias("at"))
        current = written(current.unionByName(lifted).groupBy("node").agg(F.max("at").alias("at"))).df
    return current


def expand(edges: DataFrame, roots: DataFrame, depth: int, per_source: int | None = None) -> DataFrame:
    """(root, node, steps): what each root reaches along edges in at most so many steps, each node once at its least distance. A
    source hands on at most per_source edges, by name."""
    e = distinct_edges(edges)
    if per_source is not None:
        e = e.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("k") <= per_source).drop("k")
    e = written(e).df
    seen = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("steps"))).df
    front = seen
    for k in range(1, depth + 1):
        ahead = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = written(ahead.join(seen, ["root", "node"], "left_anti").withColumn("steps", F.lit(k))).df
        seen = seen.unionByName(front)
    return seen


def _reached_local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Breadth-first from every source over all edges; rows are handed on in batches."""
    got = [p for p in parts if len(p)]
    if not got:
        return
    rows = pd.concat(got, ignore_index=True)
    numbers, names = pd.factorize(np.r_[rows["src"].to_numpy(object), rows["dst"].to_numpy(object)])
    src, dst = numbers[: len(rows)], numbers[len(rows) :]
    order = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[order], np.arange(len(names) + 1)).tolist()
    to, out = dst[order].tolist(), ([], [], [])
    frame = lambda: pd.DataFrame({"root": names[out[0]], "node": names[out[1]], "steps": np.array(out[2], np.int32)})
    for root in np.unique(src).tolist():
        seen, front, k = {root}, [root], 0
        while front:
            k, ahead = k + 1, []
            for u in front:
                for w in to[ends[u] : ends[u + 1]]:
                    if w not in seen:
                        seen.add(w)
                        ahead.append(w)
                        for column, value in zip(out, (root, w, k)):
                            column.append(value)
            front = ahead
            if len(out[0]) >= 50_000:
                yield frame()
                out = ([], [], [])
    if out[0]:
        yield frame()


def reached(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(root, node, steps): what each source reaches along edges however far, each node once at its least distance, without the
    source itself. Rounds go on until one reaches nothing new, so rings end too."""
    e = written(distinct_edges(edges)).df
    if e.count() <= local_edges:
        return e.repartition(1).mapInPandas(_reached_local, "root string, node string, steps int")
    front = written(e.where("src <> dst").select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("steps"))).df
    seen, k = front, 1
    while not front.isEmpty():
        k += 1
        ahead = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node")).where("root <> node").distinct()
        front = written(ahead.join(seen, ["root", "node"], "left_anti").withColumn("steps", F.lit(k))).df
        seen = seen.unionByName(front)
        if k % ROUNDS == 0:
            seen = written(seen).df
    return seen


def bounded_edges(edges: DataFrame, focus: DataFrame, per_source: int, order: list[Column], both_ways: bool = True) -> DataFrame:
    """Edges of some nodes, out and in, at most so many per node and direction, with the node's degree. The two directions are two
    equality joins, not one with OR."""
    f = focus.select("focus")
    out = edges.join(f, edges["src"] == f["focus"]).withColumn("direction", F.lit("out"))
    rows = out.unionByName(edges.join(f, edges["dst"] == f["focus"]).withColumn("direction", F.lit("in"))) if both_ways else out
    w = Window.partitionBy("focus", "direction")
    ranked = rows.withColumn("degree", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("place") <= per_source)


def collapsed(edges: DataFrame, depth: int, separator: str = ".") -> DataFrame:
    """Edges between modules: the first steps of the names; edges inside a module are dropped, the others summed."""
    cut = lambda c: F.substring_index(F.col(c), separator, depth)
    e = edges.select(cut("src").alias("src"), cut("dst").alias("dst")).where("src <> dst")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def limited(edges: DataFrame, priority: Column, most: int) -> DataFrame:
    """The first edges by priority, then name: a limit on purpose."""
    return edges.orderBy(priority, "src", "dst").limit(most)
