"""Reports, joins and set operations over the code tables. Type references stand for mentions, member references for links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import reports as R
from tracewell.plans.frames import WITH, anchors, edges, ref_files, refs, targets
from tracewell.runtime import table

MENTION, LINK, SPARSE = "type_ref", "member_ref", 0.60
EXCLUDED = ["HashBlock", "load_views"]


def _all(spark, d):
    return edges(spark, d), refs(spark, d), targets(spark, d), anchors(spark, d)


def agg_language_counts(spark, d):
    return R.language_counts(anchors(spark, d))


def agg_call_resolution(spark, d):
    r = R.call_resolution(refs(spark, d), targets(spark, d), anchors(spark, d))
    return r.withColumn("rate", F.round("rate", 6))


def agg_ref_kinds(spark, d):
    return R.ref_kinds(refs(spark, d), targets(spark, d))


def agg_unresolved_callees(spark, d):
    return R.unresolved_callees(refs(spark, d), targets(spark, d), anchors(spark, d), 5, EXCLUDED)


def agg_directory_distribution(spark, d):
    return R.directory_distribution(anchors(spark, d))


def agg_doc_coverage(spark, d):
    e, r, t, a = _all(spark, d)
    return R.doc_coverage(e, r, t, a, MENTION, LINK)


def agg_doc_coverage_full(spark, d):
    e, r, t, a = _all(spark, d)
    return R.doc_coverage(e, r, t, a, MENTION, LINK, limit=None, threshold=0.95)


def agg_complexity(spark, d):
    e, _, _, a = _all(spark, d)
    return R.complexity(e, a, min_lines=2).withColumn("score", F.round("score", 4))


def agg_package_hotspots(spark, d):
    e, r, t, a = _all(spark, d)
    return R.package_hotspots(e, r, t, a, MENTION, threshold=0.95)


def agg_file_hotspots(spark, d):
    e, r, t, a = _all(spark, d)
    return R.file_hotspots(e, r, t, ref_files(spark, d), a, threshold=0.95)


def _remarks(spark, d):
    """Remarks stand on anchors: kind by id, the symbol a part of some fqn."""
    kinds = F.element_at(F.array(*map(F.lit, ["fixme", "todo", "hack", "important", "note"])), (F.col("anchor_id") % 5 + 1).cast("int"))
    symbol = F.when(F.col("anchor_id") % 2 == 0, F.col("name")).otherwise(F.col("fqn"))
    return anchors(spark, d).select(F.col("anchor_id").alias("rationale_id"), "path", symbol.alias("symbol_fqn"), kinds.alias("kind"), "start_line", F.concat(F.lit("see "), F.col("fqn")).alias("content"))


def agg_rationale_attention(spark, d):
    e, _, _, a = _all(spark, d)
    return R.rationale_attention(_remarks(spark, d), e, a, MENTION, LINK)


def agg_doc_stats(spark, d):
    e, _, _, a = _all(spark, d)
    # The names asked for: the first of each language.
    asked = {r["lang"]: r["fqn"] for r in a.where("fqn <> '' and lang in ('ts', 'php', 'go')").groupBy("lang").agg(F.min("fqn").alias("fqn")).collect()}
    out = R.doc_stats(a, e, "", [], MENTION, LINK)
    for lang, fqn in sorted(asked.items()):
        out = out.unionByName(R.doc_stats(a, e, lang, [fqn], MENTION, LINK))
    return out


def agg_coupling(spark, d):
    e, _, _, a = _all(spark, d)
    return R.coupling(e, a, 3)


def agg_having_orphan_anchors(spark, d):
    """Files that are left without any called symbol."""
    e, _, _, a = _all(spark, d)
    counted = a.join(e.where("kind = 'calls'").select(F.col("dst_id").alias("anchor_id"), F.lit(1).alias("hit")).distinct(), "anchor_id", "left")
    return counted.groupBy("path").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("symbols")).where("hits = 0").select("path", "symbols")


def agg_population(spark, d):
    """Rows per table, and how many are without a partner."""
    a, t = anchors(spark, d), targets(spark, d)
    parts = [
        a.agg(F.lit("anchors").alias("domain"), F.count(F.lit(1)).alias("n")),
        t.agg(F.lit("targets").alias("domain"), F.count(F.lit(1)).alias("n")),
        t.join(a, (a["lang"] == t["dst_lang"]) & (a["fqn"] == t["dst_fqn"]), "left_anti").agg(F.lit("targets_without_anchor").alias("domain"), F.count(F.lit(1)).alias("n")),
        table(spark, d, "files").select("path").distinct().join(a.select("path"), "path", "left_anti").agg(F.lit("files_without_symbol").alias("domain"), F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_call_edges(spark, d):
    e, _, _, a = _all(spark, d)
    return R.call_rows(e, a).select("caller_fqn", "callee_fqn", "caller_path", "callee_path")


def join_external_uses(spark, d):
    """Uses of targets that no local symbol defines (anti-join), with their files."""
    _, r, t, a = _all(spark, d)
    outside = t.join(a, (a["lang"] == t["dst_lang"]) & (a["fqn"] == t["dst_fqn"]), "left_anti")
    uses = r.join(outside, F.col("dst_target_id") == F.col("target_id")).join(ref_files(spark, d), F.col("src_file_id") == F.col("file_id"), "left")
    return uses.groupBy("dst_lang", "dst_fqn").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("path").alias("files"))


def join_typed_owners(spark, d):
    """Chunks owned by a note that is there (semi-join)."""
    c = table(spark, d, "intel_chunks_new")
    return c.join(table(spark, d, "documents").select(F.col("doc_id").alias("owner_row_id")), "owner_row_id", "left_semi").groupBy("owner_type").agg(F.count(F.lit(1)).alias("n"))


def join_polymorphic_owner(spark, d):
    """The path of each chunk's owner: a note's, a symbol's or a file's, whichever the owner type names."""
    c = table(spark, d, "intel_chunks_new").select("id", "owner_row_id", F.lower(F.trim("owner_type")).alias("owner_type")).distinct()
    owners = table(spark, d, "documents").select(F.lit("doc_section").alias("owner_type"), F.col("doc_id").alias("owner_row_id"), "path")
    owners = owners.unionByName(table(spark, d, "documents").select(F.lit("ontology_node").alias("owner_type"), F.col("doc_id").alias("owner_row_id"), "path"))
    owners = owners.unionByName(anchors(spark, d).select(F.lit("anchor").alias("owner_type"), F.col("anchor_id").alias("owner_row_id"), "path"))
    return c.join(owners, ["owner_type", "owner_row_id"], "left").groupBy("owner_type").agg(F.count(F.lit(1)).alias("n"), F.count("path").alias("placed"))


def join_children(spark, d):
    """Direct children of every parent that is an indexed symbol."""
    s = table(spark, d, "super_edges").select("child_fqn", "parent_fqn", "kind").distinct()
    known = anchors(spark, d).select(F.col("fqn").alias("parent_fqn")).distinct()
    return s.join(known, "parent_fqn", "left_semi")


def join_implementers(spark, d):
    """At most three implementers of each name, by name."""
    from pyspark.sql import Window

    s = table(spark, d, "super_edges").where("kind in ('implements', 'extends') and parent_fqn is not null").select("child_fqn", "parent_fqn").distinct()
    met = s.join(anchors(spark, d).where("fqn <> ''").groupBy("fqn").agg(F.min("anchor_id").alias("anchor_id")), F.col("child_fqn") == F.col("fqn"))
    rank = F.row_number().over(Window.partitionBy("parent_fqn").orderBy("child_fqn"))
    return met.withColumn("rank", rank).where("rank <= 3").select("parent_fqn", "child_fqn", "rank", "anchor_id")


def join_glob_rules(spark, d):
    """Symbols under the rules' globs: a rule's fixed beginning limits the comparison, its regex decides. The rules are few and given."""
    from tracewell.operators.rules import glob_join

    rules = spark.createDataFrame([(1, "apps/**/*.py"), (2, "libs/*/*_1*.go"), (3, "services/**"), (4, "**/vault_*.ts")], "rule_id int, glob string")
    return glob_join(anchors(spark, d).where("path is not null").select("path").distinct(), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))


def join_shared_formats(spark, d):
    """Pairs of kinds that share a naming format in some language."""
    fmt = F.regexp_replace(F.regexp_replace("name", "[0-9]+", "9"), "[A-Z][a-z]+|[a-z]+", "w")
    f = anchors(spark, d).select("kind", F.col("lang"), fmt.alias("format")).distinct()
    a, b = f.select("kind", "lang", "format"), f.select(F.col("kind").alias("other"), "lang", "format")
    return a.join(b, ["lang", "format"]).where(F.col("kind") < F.col("other")).groupBy("kind", "other").agg(F.countDistinct("format").alias("formats"))


def set_usage_union(spark, d):
    """All usage rows: calls and type references of a symbol in one list, repeated rows kept."""
    e, _, _, a = _all(spark, d)
    e = e.withColumnRenamed("kind", "kind_e")
    one = lambda k: e.where(F.col("kind_e") == k).join(a.select("anchor_id", "fqn"), F.col("dst_id") == F.col("anchor_id")).groupBy("fqn").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
    return one("calls").unionByName(one("type_ref"))


def set_relations_union(spark, d):
    """Distinct relations of calls and inheritance between packages."""
    e, _, _, a = _all(spark, d)
    calls = R.call_rows(e, a).select(F.col("caller_pkg").alias("src"), F.col("callee_pkg").alias("dst"))
    pkg = lambda c: F.substring_index(F.col(c), ".", 2)
    inherits = table(spark, d, "super_edges").where("child_fqn is not null and parent_fqn is not null").select(pkg("child_fqn").alias("src"), pkg("parent_fqn").alias("dst"))
    return calls.union(inherits).distinct()


def set_intersect_subtract(spark, d):
    """Paths with symbols and references but no class."""
    a = anchors(spark, d)
    used = ref_files(spark, d).select("path")
    return a.select("path").intersect(used).subtract(a.where("kind = 'class'").select("path"))


def set_purge(spark, d):
    """Symbols whose file is not on the keep list (a live file)."""
    keep = table(spark, d, "files").where("deleted_at is null").select("path")
    return anchors(spark, d).where("path is not null").join(keep, "path", "left_anti").select("anchor_id", "path")


_CALLS = WITH + """,
call AS (SELECT c.anchor_id AS caller_id, c.lang AS caller_lang, c.path AS caller_path, c.fqn AS caller_fqn, c.pkg AS caller_pkg, k.anchor_id AS callee_id, k.lang AS callee_lang,
  k.path AS callee_path, k.fqn AS callee_fqn, k.pkg AS callee_pkg FROM edge e JOIN anchor c ON c.anchor_id = e.src_id JOIN anchor k ON k.anchor_id = e.dst_id WHERE e.kind = 'calls'),
rawcall AS (SELECT r.src_file_id, t.* FROM ref r JOIN target t ON t.target_id = r.dst_target_id WHERE r.ref_kind = 'calls'),
names AS (SELECT DISTINCT lang, fqn FROM anchor WHERE fqn <> ''),
rate AS (SELECT r.dst_lang AS lang, count(*) AS extracted, count(n.fqn) AS resolved FROM rawcall r LEFT JOIN names n ON n.lang = r.dst_lang AND n.fqn = r.dst_fqn GROUP BY 1),
men AS (SELECT dst_id AS anchor_id, count(*) AS mentions FROM edge WHERE kind = 'type_ref' GROUP BY 1),
lin AS (SELECT dst_id AS anchor_id, count(*) AS links FROM edge WHERE kind = 'member_ref' GROUP BY 1)"""


def _coverage(threshold, tail):
    return _CALLS + f""",
al AS (SELECT callee_lang AS lang, callee_fqn AS fqn, count(*) AS calls, count(DISTINCT caller_path) AS callers, 0 AS fallback FROM call WHERE callee_fqn <> '' GROUP BY 1, 2
  UNION ALL SELECT dst_lang, dst_fqn, count(*), count(DISTINCT src_file_id), 1 FROM rawcall WHERE dst_fqn <> '' AND dst_lang IN (SELECT lang FROM rate WHERE resolved / extracted < {threshold}) GROUP BY 1, 2),
best AS (SELECT * FROM al QUALIFY rank() OVER (PARTITION BY lang, fqn ORDER BY calls DESC, callers DESC, fallback) = 1)
SELECT u.lang, coalesce(a.kind, '') AS kind, u.fqn, coalesce(a.path, '') AS path, u.calls, u.callers, coalesce(m.mentions, 0) AS mentions, coalesce(l.links, 0) AS links,
  CASE WHEN a.anchor_id IS NULL THEN 0 ELSE 1 END AS resolved, u.fallback
FROM best u LEFT JOIN anchor a ON a.lang = u.lang AND a.fqn = u.fqn LEFT JOIN men m ON m.anchor_id = a.anchor_id LEFT JOIN lin l ON l.anchor_id = a.anchor_id {tail}"""


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("agg", "join", "set") and callable(f)}
SQL = {
    "agg_language_counts": WITH + "SELECT lang, count(*) AS symbols, count(DISTINCT path) AS files FROM anchor GROUP BY lang",
    "agg_call_resolution": _CALLS + "SELECT lang, extracted, resolved, extracted - resolved AS unresolved, round(resolved / extracted, 6) AS rate FROM rate",
    "agg_ref_kinds": WITH + "SELECT t.dst_lang AS lang, count(*) FILTER (ref_kind = 'calls') AS calls, count(*) FILTER (ref_kind = 'type_ref') AS type_ref, count(*) FILTER (ref_kind = 'member_ref') AS member_ref FROM ref r JOIN target t ON t.target_id = r.dst_target_id GROUP BY 1",
    "agg_unresolved_callees": _CALLS + f"""SELECT * FROM (SELECT dst_lang AS lang, dst_name AS name, count(*) AS calls, row_number() OVER (PARTITION BY dst_lang ORDER BY count(*) DESC, dst_name) AS rank
FROM rawcall r LEFT JOIN names n ON n.lang = r.dst_lang AND n.fqn = r.dst_fqn WHERE n.fqn IS NULL AND dst_name NOT IN ('{EXCLUDED[0]}', '{EXCLUDED[1]}') GROUP BY 1, 2) WHERE rank <= 5""",
    "agg_directory_distribution": WITH + "SELECT CASE WHEN instr(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '.' END AS dir, lang, count(DISTINCT path) AS files FROM anchor GROUP BY 1, 2 ORDER BY files DESC, dir, lang NULLS FIRST LIMIT 50",
    "agg_doc_coverage": _coverage(0.6, "ORDER BY u.calls DESC, resolved DESC, u.fallback, mentions, u.fqn, u.lang, path LIMIT 25"),
    "agg_doc_coverage_full": _coverage(0.95, ""),
    "agg_complexity": _CALLS + """,
ci AS (SELECT callee_lang AS lang, callee_fqn AS fqn, count(*) AS calls_in, count(DISTINCT caller_path) AS callers FROM call WHERE callee_fqn <> '' GROUP BY 1, 2),
co AS (SELECT caller_lang AS lang, caller_fqn AS fqn, count(*) AS calls_out, count(DISTINCT callee_fqn) AS callees FROM call WHERE caller_fqn <> '' AND callee_fqn <> '' GROUP BY 1, 2)
SELECT a.lang, a.kind, a.fqn, a.path, end_line - start_line + 1 AS span_lines, coalesce(calls_in, 0) AS calls_in, coalesce(callers, 0) AS callers, coalesce(calls_out, 0) AS calls_out, coalesce(callees, 0) AS callees,
  round((end_line - start_line + 1) * (1 + coalesce(callers, 0)) * (1 + coalesce(callees, 0) / 5.0), 4) AS score
FROM anchor a LEFT JOIN ci USING (lang, fqn) LEFT JOIN co USING (lang, fqn) WHERE a.kind IN ('function', 'method') AND a.fqn <> '' AND end_line - start_line + 1 >= 2
ORDER BY score DESC, span_lines DESC, callers DESC, callees DESC, a.path NULLS FIRST, a.fqn, a.lang LIMIT 25""",
    "agg_package_hotspots": _CALLS + """,
st AS (SELECT callee_lang AS lang, coalesce(callee_pkg, '') AS pkg, count(*) AS calls, count(DISTINCT caller_path) AS callers, count(DISTINCT callee_fqn) AS used_symbols, 0 AS fallback FROM call WHERE callee_fqn <> '' GROUP BY 1, 2),
docs AS (SELECT lang, pkg, count(*) AS n FROM (SELECT DISTINCT callee_lang AS lang, coalesce(callee_pkg, '') AS pkg, callee_fqn AS fqn FROM call) c
  WHERE EXISTS (SELECT 1 FROM anchor a JOIN men ON men.anchor_id = a.anchor_id WHERE a.lang = c.lang AND a.fqn = c.fqn) GROUP BY 1, 2),
fb AS (SELECT dst_lang AS lang, dst_pkg AS pkg, count(*) AS calls, count(DISTINCT src_file_id) AS callers, count(DISTINCT dst_fqn) AS used_symbols, 1 AS fallback FROM rawcall
  WHERE dst_fqn <> '' AND dst_lang IN (SELECT lang FROM rate WHERE resolved / extracted < 0.95) GROUP BY 1, 2),
al AS (SELECT * FROM st UNION ALL SELECT * FROM fb WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.lang = fb.lang AND st.pkg = fb.pkg))
SELECT al.*, coalesce((SELECT n FROM docs d WHERE d.lang = al.lang AND d.pkg = al.pkg), 0) AS documented_symbols FROM al ORDER BY callers DESC, calls DESC, fallback, pkg NULLS FIRST, lang LIMIT 25""",
    "agg_file_hotspots": _CALLS + """,
al AS (SELECT callee_lang AS lang, caller_path AS file, count(*) AS calls, count(DISTINCT coalesce(callee_pkg, '')) AS deps, count(DISTINCT callee_fqn) AS used_symbols, 0 AS fallback FROM call WHERE caller_path <> '' AND callee_fqn <> '' GROUP BY 1, 2
  UNION ALL SELECT dst_lang, f.path, count(*), count(DISTINCT dst_pkg), count(DISTINCT dst_fqn), 1 FROM rawcall r JOIN ref_file f ON f.file_id = r.src_file_id
  WHERE dst_fqn <> '' AND dst_lang IN (SELECT lang FROM rate WHERE resolved / extracted < 0.95) GROUP BY 1, 2)
SELECT * EXCLUDE (k) FROM (SELECT *, rank() OVER (PARTITION BY lang, file ORDER BY deps DESC, calls DESC, used_symbols DESC, fallback) AS k FROM al) WHERE k = 1 ORDER BY deps DESC, calls DESC, fallback, file NULLS FIRST, lang NULLS FIRST LIMIT 25""",
    "agg_rationale_attention": _CALLS + """,
rem AS (SELECT anchor_id AS rationale_id, path, CASE WHEN anchor_id % 2 = 0 THEN name ELSE fqn END AS symbol_fqn, ['fixme', 'todo', 'hack', 'important', 'note'][anchor_id % 5 + 1] AS kind, start_line, 'see ' || fqn AS content FROM anchor),
ci AS (SELECT callee_id AS anchor_id, count(*) AS calls, count(DISTINCT caller_path) AS callers FROM call GROUP BY 1),
st AS (SELECT a.fqn, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(mentions, 0) AS mentions, coalesce(links, 0) AS links FROM anchor a LEFT JOIN ci USING (anchor_id) LEFT JOIN men USING (anchor_id) LEFT JOIN lin USING (anchor_id) WHERE a.fqn <> ''),
sfx AS (SELECT array_to_string(list_slice(string_split(fqn, '.'), i, len(string_split(fqn, '.'))), '.') AS symbol_fqn, max(calls) AS calls, max(callers) AS callers, max(mentions) AS mentions, max(links) AS links
  FROM (SELECT *, unnest(range(1, len(string_split(fqn, '.')) + 1)) AS i FROM st) GROUP BY 1)
SELECT r.path, coalesce(r.symbol_fqn, '') AS symbol_fqn, r.kind, r.start_line, r.content, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(mentions, 0) AS mentions, coalesce(links, 0) AS links
FROM rem r LEFT JOIN sfx USING (symbol_fqn) ORDER BY coalesce(nullif(list_position(['fixme', 'todo', 'hack', 'important'], r.kind), 0), 5), callers DESC, calls DESC, r.path NULLS FIRST, r.start_line, r.content LIMIT 25""",
    "agg_doc_stats": _CALLS + "SELECT fqn, coalesce(kind, '') AS kind, coalesce(path, '') AS path, coalesce(mentions, 0) AS mentions, coalesce(links, 0) AS links FROM anchor LEFT JOIN men USING (anchor_id) LEFT JOIN lin USING (anchor_id) WHERE (lang, fqn) IN (SELECT lang, min(fqn) FROM anchor WHERE fqn <> '' AND lang IN ('ts', 'php', 'go') GROUP BY 1)",
    "agg_coupling": _CALLS + """,
pr AS (SELECT caller_pkg, callee_pkg, count(*) AS calls FROM call WHERE caller_pkg <> callee_pkg GROUP BY 1, 2),
tp AS (SELECT caller_pkg, callee_pkg, string_agg(callee_fqn, ',' ORDER BY k) AS top_symbols FROM (SELECT caller_pkg, callee_pkg, callee_fqn, row_number() OVER (PARTITION BY caller_pkg, callee_pkg ORDER BY count(*) DESC, callee_fqn NULLS FIRST) AS k FROM call WHERE caller_pkg <> callee_pkg GROUP BY 1, 2, 3) WHERE k <= 3 GROUP BY 1, 2)
SELECT p.*, EXISTS (SELECT 1 FROM pr q WHERE q.caller_pkg = p.callee_pkg AND q.callee_pkg = p.caller_pkg) AS both_ways, t.top_symbols FROM pr p JOIN tp t USING (caller_pkg, callee_pkg)""",
    "agg_having_orphan_anchors": _CALLS + "SELECT path, count(*) AS symbols FROM anchor LEFT JOIN (SELECT DISTINCT dst_id FROM edge WHERE kind = 'calls') e ON e.dst_id = anchor_id GROUP BY path HAVING count(dst_id) = 0",
    "agg_population": WITH + """SELECT 'anchors' AS domain, count(*) AS n FROM anchor UNION ALL SELECT 'targets', count(*) FROM target
UNION ALL SELECT 'targets_without_anchor', count(*) FROM target t WHERE NOT EXISTS (SELECT 1 FROM anchor a WHERE a.lang = t.dst_lang AND a.fqn = t.dst_fqn)
UNION ALL SELECT 'files_without_symbol', count(DISTINCT path) FROM files f WHERE NOT EXISTS (SELECT 1 FROM anchor a WHERE a.path = f.path)""",
    "join_call_edges": _CALLS + "SELECT caller_fqn, callee_fqn, caller_path, callee_path FROM call",
    "join_external_uses": WITH + """SELECT dst_lang, dst_fqn, count(*) AS uses, count(DISTINCT f.path) AS files FROM ref r JOIN target t ON t.target_id = r.dst_target_id LEFT JOIN ref_file f ON f.file_id = r.src_file_id
WHERE NOT EXISTS (SELECT 1 FROM anchor a WHERE a.lang = t.dst_lang AND a.fqn = t.dst_fqn) GROUP BY 1, 2""",
    "join_typed_owners": "SELECT owner_type, count(*) AS n FROM intel_chunks_new WHERE owner_row_id IN (SELECT doc_id FROM documents) GROUP BY 1",
    "join_polymorphic_owner": WITH + """, c AS (SELECT DISTINCT id, owner_row_id, lower(trim(owner_type)) AS owner_type FROM intel_chunks_new)
SELECT owner_type, count(*) AS n, count(coalesce(d.path, a.path)) AS placed FROM c LEFT JOIN documents d ON d.doc_id = owner_row_id AND owner_type IN ('doc_section', 'ontology_node') LEFT JOIN anchor a ON a.anchor_id = owner_row_id AND owner_type = 'anchor' GROUP BY 1""",
    "join_children": WITH + "SELECT DISTINCT child_fqn, parent_fqn, kind FROM super_edges WHERE parent_fqn IN (SELECT fqn FROM anchor)",
    "join_implementers": WITH + """SELECT * FROM (SELECT parent_fqn, child_fqn, row_number() OVER (PARTITION BY parent_fqn ORDER BY child_fqn) AS rank, anchor_id FROM
(SELECT DISTINCT child_fqn, parent_fqn FROM super_edges WHERE kind IN ('implements', 'extends') AND parent_fqn IS NOT NULL) s JOIN (SELECT fqn, min(anchor_id) AS anchor_id FROM anchor WHERE fqn <> '' GROUP BY 1) a ON a.fqn = s.child_fqn) WHERE rank <= 3""",
    "join_glob_rules": WITH + r""", rule(rule_id, re) AS (VALUES (1, '^apps/(?:.*/)?[^/]*\.py$'), (2, '^libs/[^/]*/[^/]*_1[^/]*\.go$'), (3, '^services/.*$'), (4, '^(?:.*/)?vault_[^/]*\.ts$'))
SELECT rule_id, count(*) AS files FROM rule JOIN (SELECT DISTINCT path FROM anchor WHERE path IS NOT NULL) ON regexp_matches(path, re) GROUP BY 1""",
    "join_shared_formats": WITH + """, f AS (SELECT DISTINCT kind, lang, regexp_replace(regexp_replace(name, '[0-9]+', '9', 'g'), '[A-Z][a-z]+|[a-z]+', 'w', 'g') AS format FROM anchor)
SELECT a.kind, b.kind AS other, count(DISTINCT a.format) AS formats FROM f a JOIN f b ON a.lang = b.lang AND a.format = b.format AND a.kind < b.kind GROUP BY 1, 2""",
    "set_usage_union": WITH + "SELECT fqn, e.kind, count(*) AS n FROM edge e JOIN anchor a ON a.anchor_id = e.dst_id WHERE e.kind IN ('calls', 'type_ref') GROUP BY 1, 2",
    "set_relations_union": _CALLS + """SELECT caller_pkg AS src, callee_pkg AS dst FROM call UNION SELECT array_to_string(string_split(child_fqn, '.')[1:2], '.'), array_to_string(string_split(parent_fqn, '.')[1:2], '.') FROM super_edges WHERE child_fqn IS NOT NULL AND parent_fqn IS NOT NULL""",
    "set_intersect_subtract": WITH + "SELECT path FROM anchor INTERSECT SELECT path FROM ref_file EXCEPT SELECT path FROM anchor WHERE kind = 'class'",
    "set_purge": WITH + "SELECT anchor_id, path FROM anchor WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files WHERE deleted_at IS NULL)",
}
