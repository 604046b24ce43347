"""More retrieval lanes, graph walks and path resolution over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import graph as G
from tracewell.operators import ranking as K
from tracewell.operators import reports as R
from tracewell.operators import search as Q
from tracewell.operators import typed as Y
from tracewell.operators.rules import glob_join
from tracewell.plans import graphs as P
from tracewell.plans.frames import WITH, anchors, edges, notes
from tracewell.plans.graphs import _NOTE, _PKG, _SEED, note_links, packages
from tracewell.plans.notes import _ftags
from tracewell.plans.search import _BM, COLUMNS, WORDS
from tracewell.runtime import table

NAMED_CODE = r"`((?:apps|libs|services|plugins|tools)/[A-Za-z0-9_/.-]+)`"


def code_mentions(spark, d):
    """(note, path): code files a note names in backticks; the folder and first word are what a file is known by."""
    n = notes(spark, d).select(F.col("path").alias("note"), F.explode(F.regexp_extract_all("text", F.lit(NAMED_CODE), 1)).alias("named")).distinct()
    return n


def search_code_references(spark, d):
    """Notes by how many code files they name, and files by how many notes name them: both lanes of one join-free pass."""
    m = code_mentions(spark, d)
    by_note = m.groupBy(F.col("note").alias("handle")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("note"))
    return by_note.unionByName(m.groupBy(F.col("named").alias("handle")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("code")))


def search_code_anchors(spark, d):
    """Notes bound to code by rules: a note's kind binds a glob; the symbols below it are its anchors, at most 50 by name."""
    rules = spark.createDataFrame([("decision", "services/**"), ("runbook", "tools/**/*.py"), ("code_doc", "libs/*/*.go")], "doc_kind string, glob string")
    files = glob_join(anchors(spark, d).where("path is not null and fqn <> ''").select("path", "fqn"), rules)
    return K.top_per_group(files.select("doc_kind", "fqn", "path").distinct(), ["doc_kind"], [F.asc("fqn"), F.asc("path")], 50).select("doc_kind", "fqn", "rank")


def search_implementers(spark, d):
    """Implementers as evidence of score 1 for the names they implement, ten per name."""
    s = table(spark, d, "super_edges").where("kind = 'implements' and child_fqn is not null and parent_fqn is not null").select("parent_fqn", "child_fqn").distinct()
    lane = Q.evidence(s, "child_fqn", "parent_fqn", "implements_edge", "refs", F.lit(1.0))
    return K.top_per_group(lane, ["owner"], [F.asc("handle")], 10).select("owner", "handle", "score")


REMARK = r"(?m)(?://|#)\s*(TODO|FIXME|HACK|NOTE|keep)\b[^\n]*"


def search_rationale(spark, d):
    """Remarks in code comments by their words, weighed by kind: todo and fixme more than others."""
    lines = notes(spark, d).select("path", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(REMARK))
    kind = F.lower(F.regexp_extract("line", r"(?://|#)\s*(TODO|FIXME|HACK|NOTE|keep)\b", 1))
    boost = F.when(kind.isin("fixme", "todo"), 1.0).when(kind == "hack", 0.9).otherwise(0.7)
    hit = T.match_score(F.col("line"), ["drop", "missing", "alias"])
    return lines.select("path", kind.alias("kind"), F.round(hit * boost, 6).alias("score")).where("score > 0").groupBy("path", "kind").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


def search_local_docs(spark, d):
    """Notes near given ones: the same folder first, then the same kind; the seeds themselves left out."""
    n = notes(spark, d).select("path", "doc_kind", F.substring_index("path", "/", 1).alias("folder"))
    seeds = n.orderBy("path").limit(5)
    near = n.join(seeds.select("folder").distinct().withColumn("same_folder", F.lit(1)), "folder", "left").join(seeds.select("doc_kind").distinct().withColumn("same_kind", F.lit(1)), "doc_kind", "left")
    near = near.join(seeds.select("path"), "path", "left_anti")
    score = F.when(F.col("same_folder") == 1, 0.6).otherwise(0.0) + F.when(F.col("same_kind") == 1, 0.2).otherwise(0.0)
    return near.select("path", F.round(score, 6).alias("score")).where("score > 0")


def search_symbol_probe(spark, d):
    """Symbols whose name is a word of the query, exactly or as one of its tokens."""
    words = ["hash", "edge", "weight", "plan"]
    a = anchors(spark, d).where("fqn <> ''").withColumn("t", T.tokens(F.col("name")))
    hits = F.size(F.array_intersect("t", F.array(*map(F.lit, words))))
    return a.select("fqn", "lang", hits.alias("hits")).where("hits >= 1").distinct()


def search_auto_expand(spark, d):
    """The best lexical hits become seeds (8 in all, 4 a kind); what they link to comes in with 0.6 of their score, the best of each."""
    s = Q.bm25(notes(spark, d), "doc_id", COLUMNS, WORDS).join(notes(spark, d).select("doc_id", "path", "doc_kind"), "doc_id").withColumn("score", F.round("score", 6))
    seeds = K.top_per_group(s, ["doc_kind"], [F.desc("score"), F.asc("doc_id")], 4).orderBy(F.desc("score"), "doc_id").limit(8)
    out = note_links(spark, d).join(seeds.select(F.col("path").alias("src"), "score"), "src").groupBy("dst").agg(F.round(F.max("score") * 0.6, 6).alias("score"))
    return out.join(seeds.select(F.col("path").alias("dst")), "dst", "left_anti")


def search_enriched(spark, d):
    """Packages called from the seeds with graph evidence: authority and hub over the best, the community shared with a seed, and the
    mean confidence of the edges to the seeds."""
    e, scores = P._confident(spark, d), P._scored(spark, d)
    seeds = list(P.seeds(spark, d))
    touching = e.where(F.col("src").isin(seeds) & ~F.col("dst").isin(seeds)).select(F.col("dst").alias("node"), "confidence", "score")
    touching = touching.unionByName(e.where(F.col("dst").isin(seeds) & ~F.col("src").isin(seeds)).select(F.col("src").alias("node"), "confidence", "score"))
    from tracewell.functions.scalars import confidence

    mean = touching.groupBy("node").agg(F.avg(confidence(F.col("confidence"), F.col("score"))).alias("confidence"))
    own = scores.where(F.col("node").isin(seeds)).select("community").distinct().withColumn("shared", F.lit(0.7))
    rows = mean.join(scores, "node").join(own, "community", "left")
    return rows.select("node", F.round(F.col("authority") / scores.agg(F.max("authority")).scalar(), 6).alias("authority"), F.coalesce("shared", F.lit(0.0)).alias("community"), F.round("confidence", 6).alias("confidence"))


def search_overview(spark, d):
    """A list in which enough code comes first: of the first 40 symbols and notes by words, up to three code hits move into the first 8."""
    a = anchors(spark, d).where("fqn <> ''").select(F.col("fqn").alias("handle"), F.lit("code").alias("kind"), T.match_score(F.col("name"), ["hash", "plan", "note"]).alias("score"))
    n = notes(spark, d).select(F.col("path").alias("handle"), F.lit("note").alias("kind"), T.match_score(F.col("title"), ["hash", "quality", "note", "block"]).alias("score"))
    top = a.unionByName(n).where("score > 0").withColumn("score", F.round("score", 6)).distinct().orderBy(F.desc("score"), "handle").limit(40)
    w = Window.orderBy(F.desc("score"), "handle")
    placed = top.withColumn("place", F.row_number().over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "handle")))
    moved = F.when((F.col("kind") == "code") & (F.col("nth") <= 3), F.least("place", 5 + F.col("nth"))).otherwise(F.col("place"))
    return placed.select("handle", "kind", F.row_number().over(Window.orderBy(moved, F.when(F.col("kind") == "code", 0).otherwise(1), "place")).alias("place"))


def search_note_connections(spark, d):
    """Notes by their chunks' hits: the best score, the hits and the sum of the three best, per note."""
    c = table(spark, d, "intel_chunks_new").where("owner_row_id is not null").select("chunk_id", "owner_row_id", T.match_score(F.coalesce("breadcrumb", F.lit("")), ["search", "quality", "links", "data"]).alias("score")).where("score > 0").distinct()
    best = K.top_per_group(c, ["owner_row_id"], [F.desc("score"), F.asc("chunk_id")], 3)
    n = c.groupBy("owner_row_id").agg(F.count(F.lit(1)).alias("hits"))
    return best.groupBy("owner_row_id").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 6).alias("three")).join(n, "owner_row_id")


def search_title_typos(spark, d):
    """Titles by concept words; a note with none of them counts 0.55 if a word is one slip away."""
    words = ["qualty", "search", "migraton"]
    n = notes(spark, d).select("path", T.tokens(F.col("title")).alias("t"))
    exact = T.coverage(F.col("t"), [[w] for w in words])

    def slipped(word: str):
        return F.exists("t", lambda t: T.typo_of(F.lit(word), t))

    near = slipped(words[0]) | slipped(words[1]) | slipped(words[2])
    score = F.when(exact > 0, exact).when(F.coalesce(near, F.lit(False)), 0.55).otherwise(0.0)
    return n.select("path", F.round(score, 6).alias("score")).where("score > 0")


def graph_walk(spark, d):
    """From given packages both ways in two steps; of a pair's edges the structural (called twice or more) wins."""
    e = packages(spark, d).where("src <> dst").groupBy("src", "dst").agg((F.count(F.lit(1)) >= 2).alias("structural"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "structural")).groupBy("src", "dst").agg(F.max("structural").alias("structural"))
    reached = G.expand(both, P.roots(spark, d), 2).where("steps > 0")
    first = both.select(F.col("src").alias("root"), F.col("dst").alias("node"), "structural")
    return reached.join(first, ["root", "node"], "left").select("root", "node", "steps", F.coalesce("structural", F.lit(False)).alias("structural"))


def graph_profiles(spark, d):
    """A local graph by profile: notes only, or with the code they name; edges by kind."""
    links = note_links(spark, d).select("src", "dst", F.lit("wikilink").alias("kind"))
    code = code_mentions(spark, d).select(F.col("note").alias("src"), F.col("named").alias("dst"), F.lit("coderef").alias("kind"))
    profiles = spark.createDataFrame([("NOTES_ONLY", "wikilink"), ("CODE_AWARE", "wikilink"), ("CODE_AWARE", "coderef")], "profile string, kind string")
    return links.unionByName(code).join(F.broadcast(profiles), "kind").groupBy("profile", "kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


def graph_all_edges(spark, d):
    """All document edges of every kind in one frame, with weights."""
    from tracewell.functions.scalars import edge_weight

    links = note_links(spark, d).select("src", "dst", F.lit("wikilink").alias("kind"))
    code = code_mentions(spark, d).select(F.col("note").alias("src"), F.col("named").alias("dst"), F.lit("coderef").alias("kind"))
    a = anchors(spark, d)
    c = edges(spark, d).join(a.select(F.col("anchor_id").alias("src_id"), F.col("path").alias("src")), "src_id").join(a.select(F.col("anchor_id").alias("dst_id"), F.col("path").alias("dst")), "dst_id").select("src", "dst", "kind").where("src <> dst")
    both = links.unionByName(code).unionByName(c).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    return both.select("src", "dst", "kind", F.round(edge_weight(F.col("kind"), F.col("n")), 6).alias("weight"))


def fn_fuzzy_paths(spark, d):
    """What a written path means among the files: the same but for case; else the one file of that name; else the one that holds most
    of its steps; else it is ambiguous."""
    asked = table(spark, d, "symbols").where("file is not null").select(F.col("file").alias("asked")).distinct()
    files = table(spark, d, "files").select("path").distinct()
    base = lambda c: F.lower(F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "^.*/", ""))
    a = asked.select("asked", F.lower("asked").alias("low"), base("asked").alias("name"))
    f = files.select("path", F.lower("path").alias("low"), base("path").alias("name"))
    exact = a.join(f.groupBy("low").agg(F.min("path").alias("same"), F.count(F.lit(1)).alias("n_same")), "low", "left")
    steps = lambda c: F.split(F.lower(F.translate(F.trim(c), "\\", "/")), "/")
    named = a.join(f.select("path", "name"), "name").withColumn("shared", F.size(F.array_intersect(steps("asked"), steps("path"))))
    best = R.best_rows(named, ["asked"], [F.desc("shared")]).groupBy("asked").agg(F.count(F.lit(1)).alias("best"), F.min("path").alias("by_steps"))
    count = named.groupBy("asked").agg(F.count(F.lit(1)).alias("named"), F.min("path").alias("by_name"))
    out = exact.join(count, "asked", "left").join(best, "asked", "left")
    path = F.when(F.col("n_same") == 1, F.col("same")).when(F.col("named") == 1, F.col("by_name")).when(F.col("best") == 1, F.col("by_steps"))
    state = F.when(path.isNotNull(), "resolved").when(F.col("named").isNull(), "not_found").otherwise("ambiguous")
    return out.select("asked", path.alias("path"), state.alias("state"))


def check_broken_placeholders(spark, d):
    """Unresolved links by note: broken, or placeholders if nothing but capitals or a question mark is written."""
    b = P.link_targets(spark, d).where("candidates = 0")
    kind = F.when(F.col("target").rlike(r"^\W*$|^(todo|tbd|xxx)\b"), "placeholder").otherwise("broken")
    return b.groupBy("src", kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"))


def check_code_frontmatter(spark, d):
    """Code notes without tags in their frontmatter."""
    return notes(spark, d).where("doc_kind = 'code_doc'").where(F.coalesce(F.size(T.front_tags(F.col("text"))), F.lit(0)) <= 0).select("path")


def typed_link_targets(spark, d):
    """Notes that link to a note given by title, if exactly one note bears it."""
    names = notes(spark, d).where("title is not null").select(F.col("title").alias("name")).distinct()
    one = Y.resolved(names, notes(spark, d)).where("path is not null").select(F.col("path").alias("dst"))
    return note_links(spark, d).join(one, "dst", "left_semi").groupBy("dst").agg(F.count(F.lit(1)).alias("sources"))


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("search", "graph", "fn", "check", "typed") and callable(f)}

_tok = lambda c: f"list_transform(list_filter(string_split(regexp_replace(regexp_replace(coalesce({c}, ''), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda t: strlen(t) >= 2), lambda t: lower(t))"
_ms = lambda c, ws: "(" + " + ".join(f"contains(lower({c}), '{w}')::INT" for w in ws) + f") / {float(len(ws))}"
_MENT = f"cm AS MATERIALIZED (SELECT DISTINCT path AS note, unnest(regexp_extract_all(text, '{NAMED_CODE}', 1)) AS named FROM documents)"
SQL = {
    "search_code_references": f"WITH {_MENT} SELECT note AS handle, count(*) AS n, 'note' AS side FROM cm GROUP BY 1 UNION ALL SELECT named, count(*), 'code' FROM cm GROUP BY 1",
    "search_code_anchors": WITH + r""", r(doc_kind, re) AS (VALUES ('decision', '^services/.*$'), ('runbook', '^tools/(?:.*/)?[^/]*\.py$'), ('code_doc', '^libs/[^/]*/[^/]*\.go$'))
SELECT doc_kind, fqn, row_number() OVER (PARTITION BY doc_kind ORDER BY fqn, path) AS rank FROM (SELECT DISTINCT doc_kind, fqn, path FROM anchor JOIN r ON regexp_matches(path, re) WHERE fqn <> '') QUALIFY rank <= 50""",
    "search_implementers": "SELECT parent_fqn AS owner, child_fqn AS handle, 1.0 AS score FROM (SELECT DISTINCT parent_fqn, child_fqn FROM super_edges WHERE kind = 'implements' AND child_fqn IS NOT NULL AND parent_fqn IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY parent_fqn ORDER BY child_fqn) <= 10",
    "search_rationale": r"WITH l AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT path, line, lower(regexp_extract(line, '(?://|#)\s*(TODO|FIXME|HACK|NOTE|keep)\b', 1)) AS kind FROM l WHERE regexp_matches(line, '(?://|#)\s*(TODO|FIXME|HACK|NOTE|keep)\b')), s AS (SELECT path, kind, round(" + _ms("line", ["drop", "missing", "alias"]) + " * CASE WHEN kind IN ('fixme', 'todo') THEN 1.0 WHEN kind = 'hack' THEN 0.9 ELSE 0.7 END, 6) AS score FROM k) SELECT path, kind, max(score) AS score, count(*) AS n FROM s WHERE score > 0 GROUP BY 1, 2",
    "search_local_docs": "WITH n AS (SELECT path, doc_kind, split_part(path, '/', 1) AS folder FROM documents), s AS (SELECT * FROM n ORDER BY path LIMIT 5) SELECT * FROM (SELECT path, round(CASE WHEN folder IN (SELECT folder FROM s) THEN 0.6 ELSE 0 END + CASE WHEN doc_kind IN (SELECT doc_kind FROM s) THEN 0.2 ELSE 0 END, 6) AS score FROM n WHERE path NOT IN (SELECT path FROM s)) WHERE score > 0",
    "search_symbol_probe": WITH + f" SELECT DISTINCT fqn, lang, len(list_intersect({_tok('name')}, ['hash', 'edge', 'weight', 'plan'])) AS hits FROM anchor WHERE fqn <> '' AND len(list_intersect({_tok('name')}, ['hash', 'edge', 'weight', 'plan'])) > 0",
    "search_auto_expand": _NOTE + ", " + _BM.removeprefix("WITH ") + """, s AS (SELECT path, doc_kind, doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id)), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY score DESC, doc_id) <= 4), sd AS (SELECT * FROM t ORDER BY score DESC, doc_id LIMIT 8)
SELECT dst, round(max(score) * 0.6, 6) AS score FROM nl JOIN sd ON sd.path = nl.src WHERE dst NOT IN (SELECT path FROM sd) GROUP BY 1""",
    "search_overview": WITH + ", u AS (SELECT DISTINCT * FROM (SELECT fqn AS handle, 'code' AS kind, round(" + _ms("name", ["hash", "plan", "note"]) + ", 6) AS score FROM anchor WHERE fqn <> '' UNION ALL SELECT path, 'note', round(" + _ms("title", ["hash", "quality", "note", "block"]) + ", 6) FROM documents) WHERE score > 0 ORDER BY score DESC, handle LIMIT 40), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, handle) AS place, row_number() OVER (PARTITION BY kind ORDER BY score DESC, handle) AS nth FROM u) SELECT handle, kind, row_number() OVER (ORDER BY CASE WHEN kind = 'code' AND nth <= 3 THEN least(place, 5 + nth) ELSE place END, CASE WHEN kind = 'code' THEN 0 ELSE 1 END, place) AS place FROM p",
    "search_note_connections": "WITH c AS (SELECT DISTINCT chunk_id, owner_row_id, " + _ms("coalesce(breadcrumb, '')", ["search", "quality", "links", "data"]) + " AS score FROM intel_chunks_new WHERE owner_row_id IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY owner_row_id ORDER BY score DESC, chunk_id) AS k FROM c WHERE score > 0) SELECT owner_row_id, round(max(score), 6) AS best, round(sum(score) FILTER (k <= 3), 6) AS three, count(*) AS hits FROM h GROUP BY 1",
    "search_title_typos": f"""WITH t AS (SELECT path, {_tok('title')} AS t FROM documents), s AS (SELECT path, (list_contains(t, 'qualty')::INT + list_contains(t, 'search')::INT + list_contains(t, 'migraton')::INT) / 3.0 AS e, len(list_filter(t, lambda w: length(w) >= 5 AND (damerau_levenshtein('qualty', w) <= 1 OR damerau_levenshtein('search', w) <= 1 OR damerau_levenshtein('migraton', w) <= 1))) AS n FROM t)
SELECT * FROM (SELECT path, round(CASE WHEN e > 0 THEN e WHEN n > 0 THEN 0.55 ELSE 0 END, 6) AS score FROM s) WHERE score > 0""",
    "graph_walk": _PKG + _SEED + """, b AS MATERIALIZED (SELECT src, dst, max(st) AS structural FROM (SELECT src, dst, n >= 2 AS st FROM pw WHERE src <> dst UNION ALL SELECT dst, src, n >= 2 FROM pw WHERE src <> dst) GROUP BY 1, 2), rt AS (SELECT node AS root FROM sd WHERE k <= 2),
s1 AS (SELECT root, dst AS node FROM rt JOIN b ON src = root), s2 AS (SELECT DISTINCT root, dst AS node FROM s1 JOIN b ON src = node), u AS (SELECT root, node, 1 AS steps FROM s1 UNION ALL SELECT root, node, 2 FROM s2 WHERE node <> root AND (root, node) NOT IN (SELECT (root, node) FROM s1))
SELECT u.root, u.node, u.steps, coalesce(b.structural, false) AS structural FROM u LEFT JOIN b ON b.src = u.root AND b.dst = u.node""",
    "graph_profiles": _NOTE + f", {_MENT}, e AS (SELECT src, 'wikilink' AS kind FROM nl UNION ALL SELECT note, 'coderef' FROM cm), p(profile, kind) AS (VALUES ('NOTES_ONLY', 'wikilink'), ('CODE_AWARE', 'wikilink'), ('CODE_AWARE', 'coderef')) SELECT profile, kind, count(*) AS edges, count(DISTINCT src) AS sources FROM e JOIN p USING (kind) GROUP BY 1, 2",
    "graph_all_edges": _NOTE + f", {_MENT}, " + WITH.removeprefix("WITH ") + """, e AS (SELECT src, dst, 'wikilink' AS kind FROM nl UNION ALL SELECT note, named, 'coderef' FROM cm UNION ALL SELECT a.path, b.path, e.kind FROM edge e JOIN anchor a ON a.anchor_id = e.src_id JOIN anchor b ON b.anchor_id = e.dst_id WHERE a.path <> b.path)
SELECT src, dst, kind, round(CASE kind WHEN 'wikilink' THEN count(*) WHEN 'coderef' THEN count(*) WHEN 'calls' THEN 0.25 * least(count(*), 5) WHEN 'type_ref' THEN 0.15 * least(count(*), 4) WHEN 'member_ref' THEN 0.12 * least(count(*), 4) ELSE 0 END, 6) AS weight FROM e GROUP BY 1, 2, 3""",
    "fn_fuzzy_paths": r"""WITH a AS (SELECT DISTINCT file AS asked, lower(file) AS low, replace(trim(file), '\', '/') AS c FROM symbols WHERE file IS NOT NULL), f AS (SELECT DISTINCT path FROM files),
sm AS (SELECT lower(path) AS low, min(path) AS same, count(*) AS n FROM f GROUP BY 1), nm AS (SELECT asked, path, len(list_intersect(string_split(lower(c), '/'), string_split(lower(path), '/'))) AS shared FROM a JOIN f ON lower(regexp_replace(c, '^.*/', '')) = lower(regexp_replace(path, '^.*/', ''))),
g AS (SELECT asked, count(*) AS named, min(path) AS by_name, count(*) FILTER (shared = m) AS best, min(path) FILTER (shared = m) AS by_steps FROM (SELECT *, max(shared) OVER (PARTITION BY asked) AS m FROM nm) GROUP BY 1),
o AS (SELECT asked, CASE WHEN sm.n = 1 THEN same WHEN named = 1 THEN by_name WHEN best = 1 THEN by_steps END AS path, named FROM a LEFT JOIN sm USING (low) LEFT JOIN g USING (asked)) SELECT asked, path, CASE WHEN path IS NOT NULL THEN 'resolved' WHEN named IS NULL THEN 'not_found' ELSE 'ambiguous' END AS state FROM o""",
    "check_code_frontmatter": f"SELECT path FROM documents WHERE doc_kind = 'code_doc' AND coalesce(len({_ftags}), 0) = 0",
    "typed_link_targets": _NOTE + ", one AS (SELECT dst FROM ti WHERE n = 1) SELECT dst, count(*) AS sources FROM nl WHERE dst IN (SELECT dst FROM one) GROUP BY 1",
    "check_broken_placeholders": _NOTE + r" SELECT src, CASE WHEN regexp_matches(target, '^\W*$|^(todo|tbd|xxx)\b') THEN 'placeholder' ELSE 'broken' END AS kind, count(*) AS links FROM wl WHERE target NOT IN (SELECT target FROM ti) GROUP BY 1, 2",
}
