"""Graph queries: the package call graph, the symbol call graph, and the notes' links resolved by title."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import graph as G
from tracewell.operators import hierarchy
from tracewell.operators import reports as R
from tracewell.plans.frames import WITH, anchors, edges, notes
from tracewell.plans.links import _TRIM
from tracewell.plans.notes import _P, _links
from tracewell.plans.reports import _CALLS
from tracewell.runtime import stripped, table

NOW = "2026-06-01 00:00:00"


def packages(spark, d):
    c = R.call_rows(edges(spark, d), anchors(spark, d))
    return c.where("caller_pkg <> '' and callee_pkg <> ''").select(F.col("caller_pkg").alias("src"), F.col("callee_pkg").alias("dst"))


def symbols(spark, d):
    c = R.call_rows(edges(spark, d), anchors(spark, d))
    return c.select(F.col("caller_fqn").alias("src"), F.col("callee_fqn").alias("dst"))


def seeds(spark, d) -> dict[str, float]:
    """The three packages with most edges, the first with double weight."""
    ends = G.degrees(packages(spark, d)).orderBy(F.desc(F.col("inbound") + F.col("outbound")), "node").limit(3)
    return {r["node"]: 1.0 + (i == 0) for i, r in enumerate(ends.collect())}


def roots(spark, d, *more: str):
    return spark.createDataFrame([(k,) for k in [*list(seeds(spark, d))[:2], *more]], "root string")


def link_targets(spark, d):
    """(src, target, dst): every written link with the one note of that title, or null."""
    n = notes(spark, d)
    links = n.where(F.contains("text", F.lit("[["))).select(F.col("path").alias("src"), F.explode(T.wikilinks(F.col("text"))).alias("l")).select("src", F.lower("l.target").alias("target")).distinct()
    titles = n.where("title is not null").groupBy(F.lower("title").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("dst"))
    return links.join(titles, "target", "left").select("src", "target", F.when(F.col("n") == 1, F.col("dst")).alias("dst"), F.coalesce("n", F.lit(0)).alias("candidates"))


def note_links(spark, d):
    """All links between notes of a title, whichever note of that title is meant (so the graph is not empty where titles repeat)."""
    n = notes(spark, d)
    links = n.where(F.contains("text", F.lit("[["))).select(F.col("path").alias("src"), F.explode(T.wikilinks(F.col("text"))).alias("l")).select("src", F.lower("l.target").alias("target")).distinct()
    titles = n.where("title is not null").groupBy(F.lower("title").alias("target")).agg(F.min("path").alias("dst"))
    return links.join(titles, "target").select("src", "dst").where("src <> dst")


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


def graph_page_rank(spark, d):
    return _round(G.page_rank(packages(spark, d)), "rank")


def graph_page_rank_symbols(spark, d):
    return _round(G.page_rank(symbols(spark, d)), "rank")


def graph_personal_rank(spark, d):
    w = packages(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return _round(G.personal_rank(w, seeds(spark, d)), "rank")


def graph_personal_candidates(spark, d):
    """The restart walk over a bounded neighbourhood of the seeds: two steps, 250 edges a node; scores over the best non-seed, 0.05 at least, the first 25."""
    e = packages(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    start = seeds(spark, d)
    near = G.expand(both, spark.createDataFrame([(k,) for k in start], "root string"), 2, 250).select("node").distinct()
    inside = both.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    r = G.personal_rank(inside, start).where(~F.col("node").isin(list(start)))
    r = r.withColumn("score", F.round(F.col("rank") / r.agg(F.max("rank")).scalar(), 9))
    return r.where("score >= 0.05").orderBy(F.desc("score"), "node").limit(25).select("node", "score")


def graph_hits(spark, d):
    return _round(G.hits(packages(spark, d)), "hub", "authority")


def graph_degrees(spark, d):
    return G.degrees(symbols(spark, d))


def graph_orphans(spark, d):
    return G.orphans(anchors(spark, d).where("fqn <> ''").select(F.col("fqn").alias("node")).distinct(), symbols(spark, d))


def graph_components(spark, d):
    return G.components(note_links(spark, d))


def graph_clusters(spark, d):
    """Packages clustered where they call each other often enough."""
    strong = packages(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return G.components(strong)


def graph_label_propagation(spark, d):
    return G.label_propagation(note_links(spark, d))


def graph_strong_components(spark, d):
    return G.strong_components(symbols(spark, d))


def _confident(spark, d):
    e = packages(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") >= 4, "extracted").when(F.col("n") >= 2, "inferred").otherwise("ambiguous")
    return e.select("src", "dst", F.lit("calls").alias("kind"), label.alias("confidence"), F.when(F.col("n") % 5 == 0, 0.9).otherwise(0.0).alias("score"))


def graph_best_path(spark, d):
    """From the package with most edges to the one with fewest."""
    start, end = list(seeds(spark, d))[:1], G.degrees(packages(spark, d)).orderBy(F.col("inbound") + F.col("outbound"), "node").limit(1).collect()
    return G.best_path(_confident(spark, d), start[0] if start else "", end[0]["node"] if end else "", 4)


def graph_edge_betweenness(spark, d):
    return _round(G.edge_betweenness(packages(spark, d)), "score")


def _scored(spark, d):
    """Scores of packages: type by their top folder, community by their first two letters below it."""
    e = packages(spark, d)
    ranks = G.hits(e).join(G.degrees(e), "node")
    kind = F.when(F.col("node").startswith("apps."), "note").otherwise("code")
    return ranks.select("node", kind.alias("type"), F.regexp_extract("node", r"\.([a-z]).*$", 1).alias("community"), "inbound", "outbound", F.round("authority", 9).alias("authority"))


def graph_surprising(spark, d):
    return _round(G.surprising(_confident(spark, d), _scored(spark, d)), "surprise")


def graph_bridges(spark, d):
    c = _scored(spark, d).select("node", "community")
    return G.bridges(packages(spark, d), c)


def graph_communities(spark, d):
    return _round(G.community_summary(_scored(spark, d), packages(spark, d)), "density")


def graph_mutual(spark, d):
    return G.mutual(packages(spark, d))


def graph_min_degree(spark, d):
    return G.min_degree(symbols(spark, d), 3)


def graph_recency(spark, d):
    times = notes(spark, d).select(F.col("path").alias("node"), F.col("updated_at").cast("timestamp").alias("at"))
    return G.recency(note_links(spark, d), times, NOW, 60, 7, 5).select("node", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def graph_expand(spark, d):
    return G.expand(packages(spark, d).where("src <> dst"), roots(spark, d, "nowhere"), 2)


def graph_bounded_edges(spark, d):
    e = packages(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    focus = e.select(F.col("src").alias("focus")).distinct()
    return G.bounded_edges(e, focus, 3, [F.desc("n"), F.asc("src"), F.asc("dst")]).select("focus", "direction", "src", "dst", "degree", "place")


def graph_collapsed(spark, d):
    return G.collapsed(packages(spark, d), 1)


def graph_limited(spark, d):
    e = packages(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return G.limited(e, F.desc("n"), 40)


def graph_parent_cycles(spark, d):
    """Each ring of parents once, from its first name on."""
    spans = hierarchy.intervals(hierarchy.links(table(spark, d, "super_edges")))
    ringed = spans.where("depth = -1 and parent is not null").select(F.col("name").alias("src"), F.col("parent").alias("dst"))
    strong = G.strong_components(ringed)
    rings = strong.where("size > 1").select("node", "component", "size")
    selves = ringed.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(1).cast("long").alias("size"))
    return rings.unionByName(selves).groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"))


def graph_backlinks(spark, d):
    """Notes that link to each note, without those tagged #todo."""
    quiet = notes(spark, d).where(T.has_tag(F.coalesce(T.all_tags(F.col("text")), F.array().cast("array<string>")), "todo")).select(F.col("path").alias("src"))
    return note_links(spark, d).join(quiet, "src", "left_anti").groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("referrers"))


def graph_broken_links(spark, d):
    return link_targets(spark, d).where("candidates = 0").select("src", "target")


def graph_link_resolution(spark, d):
    """Links by whether one note, several or none bear the title."""
    l = link_targets(spark, d)
    return l.groupBy(F.when(F.col("candidates") == 0, "broken").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous").alias("state")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("src").alias("notes"))


def graph_merge_suggestions(spark, d):
    """Notes with one normalised name, each beside the first of them."""
    n = notes(spark, d).select("path", T.normal_name(F.regexp_replace("path", r"-\d+\.md$", "")).alias("name"))
    first = F.min("path").over(Window.partitionBy("name"))
    return n.withColumn("first", first).where("path <> first").select("name", "first", "path")


def graph_stale_notes(spark, d):
    age = F.datediff(F.lit(NOW).cast("date"), F.col("updated_at").cast("date"))
    return notes(spark, d).where(age > 180).select("path", age.alias("age"))


def graph_ancestors(spark, d):
    """All supertypes of each symbol along inheritance edges of any kind, however far and ring-safe; names without surrounding white space."""
    e = table(spark, d, "super_edges").select(stripped(F.col("child_fqn")).alias("src"), stripped(F.col("parent_fqn")).alias("dst"))
    return G.reached(e.where("src <> '' and dst <> ''"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("graph_") and callable(f)}

_PKG = _CALLS + ", pk AS MATERIALIZED (SELECT caller_pkg AS src, callee_pkg AS dst FROM call WHERE caller_pkg <> '' AND callee_pkg <> ''), pe AS MATERIALIZED (SELECT DISTINCT src, dst FROM pk), pw AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM pk GROUP BY ALL), pn AS MATERIALIZED (SELECT src AS node FROM pe UNION SELECT dst FROM pe), sy AS MATERIALIZED (SELECT DISTINCT caller_fqn AS src, callee_fqn AS dst FROM call WHERE caller_fqn IS NOT NULL AND callee_fqn IS NOT NULL)"
_NOTE = f"WITH wl AS MATERIALIZED (SELECT DISTINCT path AS src, lower(trim(regexp_extract(regexp_extract(regexp_extract(l, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1), '^([^|]*)', 1), '^([^#]*)', 1))) AS target FROM (SELECT path, l FROM ({_links}) x JOIN documents USING (doc_id))), ti AS (SELECT lower(title) AS target, count(*) AS n, min(path) AS dst FROM documents WHERE title IS NOT NULL GROUP BY 1), nl AS MATERIALIZED (SELECT src, dst FROM wl JOIN ti USING (target) WHERE src <> dst)"


def _rank_sql(start: str, e: str, nodes: str, teleport: str, rounds: int) -> str:
    """PageRank unrolled: e (src, dst, w), nodes (node, p)."""
    out = f"{start}, ee AS MATERIALIZED ({e}), oo AS MATERIALIZED (SELECT src, sum(w) AS t FROM ee GROUP BY 1), nn AS MATERIALIZED ({nodes}), r0 AS MATERIALIZED (SELECT node, p AS rank FROM nn)"
    for i in range(rounds):
        out += f", r{i + 1} AS MATERIALIZED (SELECT n.node, 0.85 * coalesce(f.f, 0) + (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM oo))) * n.p AS rank FROM nn n LEFT JOIN (SELECT dst, sum(rank * w / t) AS f FROM ee JOIN oo USING (src) JOIN r{i} ON node = src GROUP BY 1) f ON f.dst = n.node)"
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


#: Seeds: the packages with most edges; the other end of the best path: the one with fewest.
_SEED = """, dd AS MATERIALIZED (SELECT node, count(*) AS n FROM (SELECT src AS node FROM pe UNION ALL SELECT dst FROM pe) GROUP BY 1),
sd AS MATERIALIZED (SELECT node, k, CASE WHEN k = 1 THEN 2.0 ELSE 1.0 END AS v FROM (SELECT node, row_number() OVER (ORDER BY n DESC, node) AS k FROM dd) WHERE k <= 3)"""


def _hits_sql(tail: str, start: str) -> str:
    out = start + ", h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM pn)"
    for i in range(30):
        out += f""", a{i} AS MATERIALIZED (SELECT n.node, coalesce(s, 0) AS a FROM pn n LEFT JOIN (SELECT dst, sum(hub) AS s FROM pe JOIN h{i} ON node = src GROUP BY 1) ON dst = n.node),
b{i} AS MATERIALIZED (SELECT n.node, n.a, coalesce(s, 0) AS h FROM a{i} n LEFT JOIN (SELECT src, sum(a) AS s FROM pe JOIN a{i} ON node = dst GROUP BY 1) ON src = n.node),
h{i + 1} AS MATERIALIZED (SELECT node, h / nullif((SELECT sqrt(sum(h * h)) FROM b{i}), 0) AS hub, a / nullif((SELECT sqrt(sum(a * a)) FROM b{i}), 0) AS authority FROM b{i})"""
    return out + tail


_SCORED = ", dg AS (SELECT node, sum(i) AS inbound, sum(o) AS outbound FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM pe UNION ALL SELECT src, 0, 1 FROM pe) GROUP BY 1), sc AS MATERIALIZED (SELECT node, CASE WHEN node LIKE 'apps.%' THEN 'note' ELSE 'code' END AS type, regexp_extract(node, '\\.([a-z]).*$', 1) AS community, inbound, outbound, round(authority, 9) AS authority FROM h30 JOIN dg USING (node))"
_CONF = ", cf AS MATERIALIZED (SELECT src, dst, 'calls' AS kind, CASE WHEN n >= 4 THEN 1.0 WHEN n >= 2 THEN 0.7 ELSE 0.2 END AS lab, n FROM pw WHERE src <> dst), cv AS MATERIALIZED (SELECT src, dst, kind, CASE WHEN n % 5 = 0 THEN 0.9 ELSE lab END AS v FROM cf)"
_both = "SELECT src, dst, min(1 - v) AS c FROM (SELECT src, dst, v FROM cv UNION ALL SELECT dst, src, v FROM cv) GROUP BY 1, 2"


def _path_sql() -> str:
    out = _PKG + _SEED + _CONF + f", bo AS MATERIALIZED ({_both}), l0 AS (SELECT node, 0.0 AS cost, node AS path FROM sd WHERE k = 1)"
    for i in range(4):
        out += f", l{i + 1} AS MATERIALIZED (SELECT node, min(ROW(cost, path)) AS b, b[1] AS cost, b[2] AS path FROM (SELECT dst AS node, round(cost + c, 9) AS cost, path || ' > ' || dst AS path FROM l{i} JOIN bo ON bo.src = node) GROUP BY 1)"
    return out + " SELECT cost, hops, path FROM (" + " UNION ALL ".join(f"SELECT node, cost, {i} AS hops, path FROM l{i}" for i in range(1, 5)) + ") WHERE node = (SELECT node FROM dd ORDER BY n, node LIMIT 1) ORDER BY cost, hops, path LIMIT 1"


def _core_sql(least: int, rounds: int) -> str:
    out = _PKG + ", k0 AS MATERIALIZED (SELECT * FROM sy)"
    for i in range(rounds):
        out += f", g{i} AS MATERIALIZED (SELECT node FROM (SELECT src AS node FROM k{i} UNION ALL SELECT dst FROM k{i}) GROUP BY 1 HAVING count(*) >= {least}), k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} WHERE src IN (SELECT node FROM g{i}) AND dst IN (SELECT node FROM g{i}))"
    return out + f" SELECT src, dst FROM k{rounds}"


_COMP = "{0}, bi AS MATERIALIZED (SELECT src, dst FROM ({1}) x UNION SELECT dst, src FROM ({1}) y), wk AS (SELECT src AS node, src AS hit FROM bi UNION SELECT wk.node, bi.dst FROM wk JOIN bi ON bi.src = wk.hit) SELECT node, min(hit) AS component FROM wk GROUP BY 1"
_TAGGED = _P.removeprefix("WITH ").rstrip().replace("n AS MATERIALIZED", "tg AS MATERIALIZED", 1)
_RINGS = f"""WITH RECURSIVE link AS (SELECT child, min(parent) AS parent FROM (SELECT {_TRIM('child_fqn')} AS child, {_TRIM('parent_fqn')} AS parent FROM super_edges WHERE lower({_TRIM('kind')}) = 'extends') WHERE child <> '' AND parent <> '' GROUP BY 1),
w AS (SELECT child AS a, parent AS hit FROM link UNION SELECT a, l.parent FROM w JOIN link l ON l.child = w.hit), r AS (SELECT a FROM w WHERE hit = a), g AS (SELECT r.a, min(w.hit) AS component FROM r JOIN w ON w.a = r.a WHERE w.hit IN (SELECT a FROM r) GROUP BY 1)
SELECT component, count(*) AS members, string_agg(a, ',' ORDER BY a) AS nodes FROM g GROUP BY 1"""

SQL = {
    "graph_page_rank": _rank_sql(_PKG, "SELECT src, dst, 1.0 AS w FROM pe", "SELECT node, 1.0 / (SELECT count(*) FROM pn) AS p FROM pn", "", 30),
    "graph_page_rank_symbols": _rank_sql(_PKG, "SELECT src, dst, 1.0 AS w FROM sy", "SELECT node, 1.0 / (SELECT count(*) FROM (SELECT src AS node FROM sy UNION SELECT dst FROM sy)) AS p FROM (SELECT src AS node FROM sy UNION SELECT dst FROM sy)", "", 30),
    "graph_backlinks": _NOTE + ", " + _TAGGED + " SELECT dst AS note, count(*) AS referrers FROM nl WHERE src NOT IN (SELECT path FROM tg WHERE len(list_filter(tags, lambda t: t = 'todo' OR t LIKE 'todo/%')) > 0) GROUP BY 1",
    "graph_parent_cycles": _RINGS,
    "graph_personal_rank": _rank_sql(_PKG + _SEED, "SELECT src, dst, n::DOUBLE AS w FROM pw", "SELECT node, coalesce(v, 0) / (SELECT sum(v) FROM sd) AS p FROM pn LEFT JOIN sd USING (node)", "", 15),
    "graph_hits": _hits_sql(" SELECT node, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h30", _PKG),
    "graph_degrees": _PKG + " SELECT node, sum(i) AS inbound, sum(o) AS outbound FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM sy UNION ALL SELECT src, 0, 1 FROM sy) GROUP BY 1",
    "graph_orphans": _PKG + " SELECT DISTINCT fqn AS node, CASE WHEN fqn IN (SELECT dst FROM sy) THEN 'dead_end' ELSE 'orphan' END AS state FROM anchor WHERE fqn <> '' AND fqn NOT IN (SELECT src FROM sy)",
    "graph_components": _COMP.format(_NOTE.replace("WITH ", "WITH RECURSIVE ", 1), "SELECT src, dst FROM nl"),
    "graph_clusters": _COMP.format(_PKG.replace("WITH ", "WITH RECURSIVE ", 1), "SELECT src, dst FROM pw WHERE src <> dst AND n >= 3"),
    "graph_best_path": _path_sql(),
    "graph_surprising": _hits_sql(_SCORED + _CONF + """, su AS (SELECT e.src, e.dst, e.kind, round(1 + 2 * (1 - v) + CASE WHEN s.community <> d.community AND s.community <> '' AND d.community <> '' THEN 2 ELSE 0 END + CASE WHEN s.type <> d.type THEN 2 ELSE 0 END
  + CASE WHEN least(s.inbound + s.outbound, d.inbound + d.outbound) <= 2 AND greatest(s.inbound + s.outbound, d.inbound + d.outbound) >= 8 THEN 1.5 ELSE 0 END + CASE WHEN s.authority < 0.1 AND d.authority < 0.1 THEN 1 ELSE 0 END, 9) AS surprise,
  CASE WHEN s.community <> '' AND d.community <> '' THEN least(s.community, d.community) || '|' || greatest(s.community, d.community) ELSE e.src || '||' || e.dst END AS pair
  FROM cv e LEFT JOIN sc s ON s.node = e.src LEFT JOIN sc d ON d.node = e.dst WHERE NOT coalesce(s.outbound > 50 AND s.inbound < 3, false) AND NOT coalesce(d.outbound > 50 AND d.inbound < 3, false))
SELECT src, dst, kind, surprise FROM su QUALIFY row_number() OVER (PARTITION BY pair ORDER BY surprise DESC, src, dst) = 1""", _PKG),
    "graph_bridges": _PKG + """, cm AS (SELECT node, regexp_extract(node, '\\.([a-z]).*$', 1) AS community FROM pn), cr AS (SELECT src, dst, a.community AS ca, b.community AS cb FROM pe JOIN cm a ON a.node = src JOIN cm b ON b.node = dst WHERE a.community <> b.community)
SELECT * FROM (SELECT community, node, count(*) AS crossing FROM (SELECT ca AS community, src AS node FROM cr UNION ALL SELECT cb, dst FROM cr) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY community ORDER BY crossing DESC, node) <= 5""",
    "graph_communities": _hits_sql(_SCORED + " SELECT community, count(*) AS members, arg_min(node, ROW(-authority, node)) AS anchor, round(CASE WHEN count(*) > 1 THEN sum(inbound + outbound) / count(*) / (count(*) - 1) ELSE 0 END, 9) AS density FROM sc GROUP BY 1", _PKG),
    "graph_mutual": _PKG + " SELECT src, dst FROM pe a WHERE EXISTS (SELECT 1 FROM pe b WHERE b.src = a.dst AND b.dst = a.src)",
    "graph_min_degree": _core_sql(3, 24),
    "graph_recency": _NOTE + f""", tm AS (SELECT path AS node, least(updated_at, TIMESTAMP '{NOW}') AS ts FROM documents WHERE updated_at IS NOT NULL), bi AS (SELECT src, dst FROM nl UNION SELECT dst, src FROM nl),
nr AS (SELECT src AS node, ts - INTERVAL 7 DAY AS ts FROM (SELECT src, dst, ts, row_number() OVER (PARTITION BY src ORDER BY ts DESC, dst) AS k FROM bi JOIN tm ON tm.node = dst) WHERE k <= 5 AND ts >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY)
SELECT node, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "at" FROM (SELECT * FROM tm UNION ALL SELECT * FROM nr) GROUP BY 1""",
    "graph_expand": _PKG + _SEED + """, rt AS (SELECT node AS root FROM sd WHERE k <= 2 UNION ALL SELECT 'nowhere'), x AS (SELECT src, dst FROM pe WHERE src <> dst), s1 AS (SELECT DISTINCT root, dst AS node FROM rt JOIN x ON src = root), s2 AS (SELECT DISTINCT root, dst AS node FROM s1 JOIN x ON src = node)
SELECT root, node, min(steps) AS steps FROM (SELECT root, root AS node, 0 AS steps FROM rt UNION ALL SELECT root, node, 1 FROM s1 UNION ALL SELECT root, node, 2 FROM s2) GROUP BY 1, 2""",
    "graph_bounded_edges": _PKG + """ SELECT * FROM (SELECT focus, direction, src, dst, count(*) OVER (PARTITION BY focus, direction) AS degree, row_number() OVER (PARTITION BY focus, direction ORDER BY n DESC, src, dst) AS place FROM
(SELECT src AS focus, 'out' AS direction, src, dst, n FROM pw UNION ALL SELECT dst, 'in', src, dst, n FROM pw WHERE dst IN (SELECT src FROM pw))) WHERE place <= 3""",
    "graph_collapsed": _PKG + " SELECT split_part(src, '.', 1) AS src, split_part(dst, '.', 1) AS dst, count(*) AS weight FROM pk WHERE split_part(src, '.', 1) <> split_part(dst, '.', 1) GROUP BY 1, 2",
    "graph_limited": _PKG + " SELECT src, dst, n FROM pw ORDER BY n DESC, src, dst LIMIT 40",
    "graph_broken_links": _NOTE + " SELECT src, target FROM wl WHERE target NOT IN (SELECT target FROM ti)",
    "graph_link_resolution": _NOTE + " SELECT CASE WHEN n IS NULL THEN 'broken' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, count(*) AS links, count(DISTINCT src) AS notes FROM wl LEFT JOIN ti USING (target) GROUP BY 1",
    "graph_merge_suggestions": r"WITH n AS (SELECT path, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(path, '-\d+\.md$', ''), '^.*/', '')), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM documents) SELECT * FROM (SELECT name, min(path) OVER (PARTITION BY name) AS first, path FROM n) WHERE path <> first",
    "graph_stale_notes": f"SELECT path, date_diff('day', updated_at::DATE, DATE '{NOW[:10]}') AS age FROM documents WHERE date_diff('day', updated_at::DATE, DATE '{NOW[:10]}') > 180",
    "graph_ancestors": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT {_TRIM('child_fqn')} AS src, {_TRIM('parent_fqn')} AS dst FROM super_edges) WHERE src <> '' AND dst <> ''),
w AS (SELECT src AS root, dst AS node, 1 AS steps FROM e UNION SELECT root, dst, steps + 1 FROM w JOIN e ON src = node WHERE steps <= (SELECT count(DISTINCT src) FROM e))
SELECT root, node, min(steps) AS steps FROM w WHERE root <> node GROUP BY 1, 2""",
}
