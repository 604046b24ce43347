"""Parent-child links to full hierarchies.

1. Peeling. Taking away all childless nodes m times leaves exactly the nodes that are the m-th ancestor of some node, so m
   doubles from round to round by joining the ancestor links with themselves: 2^k leaf layers go in k joins. When a doubling
   takes nothing more away, what is left are the rings, and the nodes whose ancestor is still defined lead into one.
2. Euler tour. Each tree node has an entry and an exit element; the links between them follow from the first child, the next
   sibling and the parent. Siblings are ordered inside hash buckets and the buckets are chained, so the children of one parent
   are never sorted in one task.
3. List ranking. All tours are ranked together by contraction: every round gives the elements new random priorities and splices out
   those below both of their neighbours, a third of them, by one join in which every row takes part once. A list that is down to one
   row is done. What is left of the last round, RANK_LOCALLY elements at most, is ranked in one task; then the spliced elements get
   their ranks back, round by round.
   Positions and depths (+1 at an entry, -1 at an exit) are ranked together.

Entry and exit positions give the depth, the root, ancestors and descendants.

Defined cases: a link with a null or blank child or parent is dropped; repeated links count once; of several parents of one
child the smallest name holds; a self-link is a ring; nodes in or below a ring have root '' and depth -1; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import Written, stripped, written

#: A contracted list of at most so many elements is ranked in one task, which takes it less time than a round's join.
RANK_LOCALLY = 8_000
#: Children of one parent are ordered in so many buckets.
BUCKETS = 256


def links(edges: DataFrame, child: str = "child_fqn", parent: str = "parent_fqn", kind: str | None = "kind", of_kind: str = "extends") -> DataFrame:
    """(child, parent) strings of the usable links, one row per child."""
    if kind is not None:
        edges = edges.where(F.lower(stripped(F.col(kind))) == of_kind)
    pairs = edges.select(stripped(F.col(child)).alias("child"), stripped(F.col(parent)).alias("parent"))
    return pairs.where((F.col("child") != "") & (F.col("parent") != "")).groupBy("child").agg(F.min("parent").alias("parent"))


def _numbered(names: DataFrame) -> Written:
    """Names with dense-enough 64-bit ids, fixed by being written."""
    return written(names.select(F.monotonically_increasing_id().alias("id"), "name"))


def peel(up: DataFrame) -> Written:
    """The nodes that are in a ring or lead into one. up: (id, parent), the parent null at a root."""
    state = written(up.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("anc")))
    left = state.df.select("anc").distinct().count()
    while True:
        a, b = state.df.alias("a"), state.df.select(F.col("id").alias("anc"), F.col("anc").alias("above"))
        # An ancestor without a row is a root or has run out of one: its descendants are peeled and leave the state.
        after = written(a.join(b, "anc").select("id", F.col("above").alias("anc")))
        state.drop()
        state, before = after, left
        left = state.df.select("anc").distinct().count()
        if left == before or not left:
            return state


def _tour(tree: DataFrame) -> DataFrame:
    """(e, nxt, w, first, last): the successor of each tour element; an entry is 2*id, an exit 2*id+1. w is +1 for a step down, -1 for
    a step up, 0 for a step aside; the exit of a root has no row. first: nothing leads to it; last: it leads to the end of its list.
    tree: (id, parent) with a null parent at a root."""
    kids = tree.where(F.col("parent").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    inside = Window.partitionBy("parent", "bucket").orderBy("id")
    kids = kids.withColumn("sibling", F.lead("id").over(inside))
    ends = kids.groupBy("parent", "bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    across = Window.partitionBy("parent").orderBy("bucket")
    ends = ends.withColumn("after", F.lead("first").over(across)).withColumn("n", F.row_number().over(across))
    to_sibling = kids.where(F.col("sibling").isNotNull()).select("id", "sibling")
    chained = ends.where(F.col("after").isNotNull()).select(F.col("last").alias("id"), F.col("after").alias("sibling"))
    to_parent = ends.where(F.col("after").isNull()).select(F.col("last").alias("id"), "parent")
    first = ends.where(F.col("n") == 1).select(F.col("parent").alias("id"), F.col("first").alias("kid"))
    entry, leave, no = F.col("id") * 2, F.col("id") * 2 + 1, F.lit(False)
    aside = to_sibling.unionByName(chained).select(leave.alias("e"), (F.col("sibling") * 2).alias("nxt"), F.lit(0).cast("long").alias("w"), no.alias("first"), no.alias("last"))
    to_parent = to_parent.join(tree.select(F.col("id").alias("parent"), F.col("parent").isNull().alias("last")), "parent")
    rise = to_parent.select(leave.alias("e"), (F.col("parent") * 2 + 1).alias("nxt"), F.lit(-1).cast("long").alias("w"), no.alias("first"), "last")
    # A step aside goes from an exit at one depth to an entry at the same depth; an entry to its own exit too.
    down = tree.join(first, "id", "left").select(
        entry.alias("e"), F.coalesce(F.col("kid") * 2, leave).alias("nxt"), F.when(F.col("kid").isNull(), 0).otherwise(1).cast("long").alias("w"),
        F.col("parent").isNull().alias("first"), (F.col("parent").isNull() & F.col("kid").isNull()).alias("last"),
    )
    return aside.unionByName(rise).unionByName(down)


def _rank_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pointer doubling over one in-memory list set; an end points at itself."""
    got = [p for p in parts if len(p)]
    if not got:
        return
    rows = pd.concat(got, ignore_index=True)
    e = rows["e"].to_numpy()
    order = np.argsort(e)
    e, nxt, w, d = e[order], rows["nxt"].to_numpy()[order], rows["w"].to_numpy()[order].copy(), rows["d"].to_numpy()[order].copy()
    at = np.minimum(np.searchsorted(e, nxt), len(e) - 1)
    known = e[at] == nxt
    # An element whose successor has no row is followed by the end of its list.
    to = np.where(known, at, len(e))
    to, w, d, last = np.append(to, len(e)), np.append(w, 0), np.append(d, 0), np.append(np.where(known, -1, nxt), -1)
    while (to[:-1] != len(e)).any():
        last = np.where(last == -1, last[to], last)
        w, d, to = w + w[to], d + d[to], to[to]
    yield pd.DataFrame({"e": e, "tail": last[:-1], "w": w[:-1], "d": d[:-1]})


def rank(succ: DataFrame, at_most: int = RANK_LOCALLY) -> DataFrame:
    """(e, tail, w, d): for each element the last element of its list and the sums of w and d on the way there.
    succ: (e, nxt, w, d, first, last), one row per element but the last of each list."""
    start, gone = written(succ), []
    whole = F.col("first") & F.col("last")
    ranks = lambda rows: rows.select("e", F.col("nxt").alias("tail"), "w", "d")
    now, done = start.df.where(~whole), [ranks(start.df.where(whole))]
    size, round_no = now.count(), 0
    while size > at_most:
        priority = lambda c, k=round_no: F.xxhash64(c, F.lit(k))
        # A row whose successor has the lower priority asks it to go; a row with the lower priority may be asked.
        asks = (priority("nxt") < priority("e")) & ~F.col("last")
        mates = now.where(asks).select("e", F.col("nxt").alias("m"), F.col("w").alias("pw"), F.col("d").alias("pd"), F.col("first").alias("mate_first"))
        heads = now.where(~asks).select(F.col("e").alias("m"), "nxt", "w", "d", "first", "last")
        joined = written(mates.join(heads, "m", "full").select("e", "m", "nxt", "w", "d", "pw", "pd", "first", "mate_first", "last"))
        both = F.col("e").isNotNull() & F.col("nxt").isNotNull()
        gone.append((joined, joined.df.where(both).select(F.col("m").alias("e"), "nxt", "w", "d")))
        step = lambda own, past: F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col(past), F.lit(0))
        now = joined.df.select(
            F.coalesce("e", "m").alias("e"), F.coalesce("nxt", "m").alias("nxt"), step("w", "pw").alias("w"), step("d", "pd").alias("d"),
            F.coalesce("mate_first", "first").alias("first"), F.coalesce("last", F.lit(False)).alias("last"),
        )
        done.append(ranks(now.where(whole)))
        now = now.where(~whole)
        size, round_no = now.count(), round_no + 1
    ranked = now.select("e", "nxt", "w", "d").repartition(1).mapInPandas(_rank_all, "e long, tail long, w long, d long")
    for rows in done:
        ranked = ranked.unionByName(rows)
    tables = [written(ranked)]
    start.drop()
    for joined, out in reversed(gone):
        known = tables[-1].df
        ahead = known.select(F.col("e").alias("nxt"), F.col("tail").alias("t"), F.col("w").alias("aw"), F.col("d").alias("ad"))
        back = out.join(ahead, "nxt", "left").select(
            "e", F.coalesce("t", "nxt").alias("tail"), (F.col("w") + F.coalesce("aw", F.lit(0))).alias("w"), (F.col("d") + F.coalesce("ad", F.lit(0))).alias("d")
        )
        tables.append(written(known.unionByName(back)))
        tables[-2].drop()
        joined.drop()
    return tables[-1].df


def intervals(pairs: DataFrame, at_most: int = RANK_LOCALLY) -> DataFrame:
    """(name, parent, root, depth, entry, leave) of every name. entry < x.entry <= x.leave < leave holds for exactly the
    descendants x of a name under the same root. Nodes in or below a ring: root '', depth -1, entry and leave null."""
    pairs = written(pairs).df
    names = pairs.select(F.col("child").alias("name")).union(pairs.select("parent")).distinct()
    ids = _numbered(names).df
    by_child = pairs.join(ids.select(F.col("name").alias("child"), F.col("id")), "child")
    up = by_child.join(ids.select(F.col("name").alias("parent"), F.col("id").alias("parent_id")), "parent").select("id", "parent_id")
    up = written(ids.select("id").join(up, "id", "left").select("id", F.col("parent_id").alias("parent"))).df
    ringed = peel(up).df.select("id").withColumn("ringed", F.lit(True))
    tree = written(up.join(ringed, "id", "left_anti")).df
    ranks = rank(_tour(tree).select("e", "nxt", F.lit(1).cast("long").alias("w"), F.col("w").alias("d"), "first", "last"), at_most)
    # From an element to the root's exit: w steps, and d = depth of the exit (0) - depth of the element.
    spots = ranks.select(F.shiftright("e", 1).alias("id"), (F.col("e") % 2).alias("side"), F.shiftright("tail", 1).alias("root_id"), "w", "d")
    entering = F.col("side") == 0
    per_node = written(
        spots.groupBy("id").agg(
            F.max("root_id").alias("root_id"),
            F.max(F.when(entering, F.col("w"))).alias("w_in"),
            F.coalesce(F.max(F.when(~entering, F.col("w"))), F.lit(0)).alias("w_out"),
            F.max(F.when(entering, -F.col("d"))).alias("depth"),
        )
    ).df
    roots = per_node.where(F.col("id") == F.col("root_id")).select("root_id", F.col("w_in").alias("span"))
    roots = roots.join(ids.select(F.col("id").alias("root_id"), F.col("name").alias("root")), "root_id")
    named = ids.join(up, "id").join(per_node, "id", "left").join(roots, "root_id", "left")
    named = named.join(ids.select(F.col("id").alias("parent"), F.col("name").alias("parent_name")), "parent", "left")
    return named.select(
        "name", F.col("parent_name").alias("parent"), F.coalesce("root", F.lit("")).alias("root"), F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"),
        (F.col("span") - F.col("w_in")).alias("entry"), (F.col("span") - F.col("w_out")).alias("leave"), "span",
    )


#: No tour has 2^LEVELS positions. Cells above 2^CELL positions are divided.
LEVELS, CELL = 40, 13


def ancestors(spans: DataFrame) -> DataFrame:
    """(name, ancestor, steps): every node with every ancestor; read the other way, every node with all its descendants.
    spans: intervals(...).

    The positions of a tour are cut into cells of 2^level; an ancestor covers its interval with at most two cells a level, and
    a node is looked up in its one cell of each level, so the containment of intervals becomes an equality join."""
    placed = spans.where(F.col("entry").isNotNull())
    inner = placed.where(F.col("leave") > F.col("entry") + 1)
    covers = inner.select("root", F.col("name").alias("ancestor"), F.col("depth").alias("above"), F.explode(_cells("entry + 1", "leave")).alias("cell"))
    covers = covers.select("root", "ancestor", "above", "cell.level", "cell.at", F.explode(F.sequence(F.lit(0), _salts(F.col("cell.level")) - 1)).alias("salt"))
    top = F.expr("sequence(0, cast(ceil(log2(span + 1)) as int))")
    looked = placed.select("root", "name", "depth", "entry", F.explode(top).alias("level"))
    looked = looked.select("root", "name", "depth", F.col("level").cast("long").alias("level"), F.expr("shiftright(entry, level)").alias("at"), F.pmod(F.xxhash64("name"), _salts(F.col("level"))).cast("int").alias("salt"))
    return looked.join(covers, ["root", "level", "at", "salt"]).select("name", "ancestor", (F.col("depth") - F.col("above")).alias("steps"))


def _salts(level):
    """Into how many parts the nodes of a cell are divided: those of a large cell all look up the same few covers, so these are
    repeated, a row for every CELL nodes it can be joined with."""
    return F.least(F.pow(F.lit(2.0), F.greatest(level - CELL, F.lit(0))), F.lit(1024.0)).cast("int")


def _cells(lo: str, hi: str):
    """The cells (level, at) of powers of two that together cover [lo, hi)."""
    first, end = f"shiftright({lo} + shiftleft(1L, k) - 1, k)", f"shiftright({hi}, k)"
    cell = lambda odd, at: f"if({first} < {end} and ({odd} & 1L) = 1L, named_struct('level', cast(k as bigint), 'at', {at}), null)"
    return F.expr(f"filter(flatten(transform(sequence(0, {LEVELS}), k -> array({cell(first, first)}, {cell(end, end + ' - 1')}))), c -> c is not null)")


def paths(spans: DataFrame, above: DataFrame, separator: str = " > ") -> DataFrame:
    """(name, root, depth, path): the names from the root down to the node; the path of a node in or below a ring is null."""
    way = above.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("order"), "ancestor"))).alias("way"))
    steps = F.transform(F.coalesce("way", F.array().cast("array<struct<order:bigint,ancestor:string>>")), lambda x: x["ancestor"])
    path = F.array_join(F.concat(steps, F.array("name")), separator)
    return spans.select("name", "root", "depth").join(way, "name", "left").select("name", "root", "depth", F.when(F.col("depth") >= 0, path).alias("path"))
