"""Queries over documents as notes: the filter language, tags, properties and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import chunks as C
from tracewell.functions import scalars as S
from tracewell.functions import text as T
from tracewell.operators import filters as L
from tracewell.plans.frames import WITH, anchors, notes
from tracewell.runtime import table

NOW = "2026-06-01"


def parsed(spark, d):
    """Notes with tags and the properties the filters ask for."""
    n = notes(spark, d)
    front = F.array(*[F.struct(F.lit(k).alias("key"), T.front_value(F.col("text"), k).alias("value")) for k in ("type", "status", "owner")])
    return n.select("doc_id", "path", "title", "doc_kind", "updated_at", F.coalesce(T.all_tags(F.col("text")), F.array().cast("array<string>")).alias("tags"), F.filter(F.coalesce(front, F.array().cast(parsed.kind)), lambda p: p["value"] != "").alias("properties"))


parsed.kind = "array<struct<key:string,value:string>>"

FILTERS = {
    "filter_tag": ("tag:graph", "or"),
    "filter_tag_hierarchy": ("tag:infra or tag:area", "or"),
    "filter_property": ("type:note and not status:draft", "or"),
    "filter_path": ("meetings runbooks", "or"),
    "filter_find": ("find:d/access-rules find:search.*quality", "or"),
    "filter_combined": ("(tag:review or tag:q3) and not (status:Superseded or guides)", "and"),
}


def _filter(name):
    def run(spark, d):
        return L.listed(parsed(spark, d), *FILTERS[name]).select("path")

    run.__name__ = name
    return run


def filter_by_sets(spark, d):
    return L.listed_by_sets(parsed(spark, d), ["tag:graph", "status:draft"], "meetings")


def filter_ordered_terms(spark, d):
    n = notes(spark, d)
    terms = n.select(F.col("doc_id").alias("note_id"), F.posexplode(T.tokens(F.col("title"))).alias("ordinal", "token")).withColumn("scope", F.lit("title"))
    return L.ordered_terms(terms, ["s", "q", "b"], "title")


def agg_tag_rollup(spark, d):
    """Own and aggregate counts of notes per tag and its prefixes."""
    t = parsed(spark, d).select("doc_id", F.explode("tags").alias("tag"))
    own = t.groupBy("tag").agg(F.countDistinct("doc_id").alias("own"))
    whole = t.select("doc_id", F.explode(T.tag_prefixes(F.col("tag"))).alias("tag")).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))
    return whole.join(own, "tag", "left").select("tag", F.coalesce("own", F.lit(0)).alias("own"), "notes")


def _properties(spark, d):
    return parsed(spark, d).select("doc_id", F.explode("properties").alias("p")).select("doc_id", "p.*")


def _values(spark, d):
    """(key, at, value): every value of every frontmatter key of every note; at is 0 for the first of a note's list."""
    p = notes(spark, d).select(F.explode(T.front_properties(F.col("text"))).alias("p"))
    return p.select("p.key", F.posexplode("p.values").alias("at", "value"))


def agg_property_profile(spark, d):
    """Per frontmatter key: notes that have it, different values (of lists: items) and their types."""
    p = _values(spark, d).withColumn("type", S.inferred_type(F.col("value")))
    return p.groupBy("key").agg(F.count_if(F.col("at") == 0).alias("n"), F.countDistinct("value").alias("values"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), (F.countDistinct("value") <= 20).alias("enum_like"))


def agg_property_lookup(spark, d):
    p = _properties(spark, d).where((F.col("key") == "status") & (L.normal_value(F.col("value")) == "open"))
    return notes(spark, d).join(p.select("doc_id"), "doc_id", "left_semi").select("path")


def fn_slugs(spark, d):
    t = F.col("title")
    return notes(spark, d).select("doc_id", T.slug(t).alias("slug"), T.web_slug(t).alias("web"), T.heading_key(t).alias("key"), T.normal_name(F.col("path")).alias("name"))


def fn_hashtags(spark, d):
    return notes(spark, d).where("text is not null").select("doc_id", F.array_join(T.hashtags(F.col("text")), ",").alias("tags"))


def fn_front_tags(spark, d):
    return notes(spark, d).where("text is not null").select("doc_id", F.array_join(T.front_tags(F.col("text")), ",").alias("tags"))


def fn_wikilinks(spark, d):
    links = notes(spark, d).select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("l")).select("doc_id", "l.*")
    return links.groupBy("doc_id", "target", "heading", "block", "alias", "embed").agg(F.count(F.lit(1)).alias("n"))


def fn_markdown_links(spark, d):
    return notes(spark, d).select("doc_id", F.explode(T.markdown_links(F.col("text"))).alias("l")).select("doc_id", "l.*").groupBy("doc_id", "label", "href").agg(F.count(F.lit(1)).alias("n"))


def fn_headings(spark, d):
    h = notes(spark, d).select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("ord", "h"))
    return h.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("h.level").cast("long").alias("level"), "h.heading")


def fn_inline_properties(spark, d):
    return notes(spark, d).select("doc_id", F.explode(T.inline_properties(F.col("text"))).alias("p")).select("doc_id", "p.*").distinct()


def fn_block_ids(spark, d):
    f = table(spark, d, "note_fragment_targets").where("target_kind = 'block'")
    return f.select("note_id", T.block_id(F.concat(F.lit("see "), "target_text")).alias("block")).distinct()


def fn_tokens(spark, d):
    t = anchors(spark, d).select(F.explode(T.tokens(F.col("name"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def fn_variants(spark, d):
    t = notes(spark, d).select(F.explode(T.tokens(F.col("title"))).alias("token")).distinct()
    return t.select("token", F.array_join(T.variants(F.col("token")), ",").alias("variants"))


def fn_concept_coverage(spark, d):
    groups = T.term_groups("how are blocks indexed in the index and the quality of notes".split())
    return notes(spark, d).select("doc_id", F.round(T.coverage(T.tokens(F.col("title")), groups), 6).alias("coverage")).where("coverage > 0")


def fn_match_score(spark, d):
    return notes(spark, d).select("doc_id", F.round(T.match_score(F.col("title"), ["rule", "heading", "id"]), 6).alias("score")).where("score > 0")


def fn_jaccard(spark, d):
    n = notes(spark, d).select("doc_id", T.tokens(F.col("title")).alias("a"), T.tokens(F.regexp_replace("path", r"\.md$", "")).alias("b"))
    return n.select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def fn_typos(spark, d):
    """Title words one slip away from a query word, swaps included."""
    w = notes(spark, d).select(F.explode(T.tokens(F.col("title"))).alias("word")).distinct()
    out = None
    for q in ("serach", "qualty", "migrations", "onboardign", "tempxlate"):
        part = w.where(T.typo_of(F.lit(q), F.col("word"))).select(F.lit(q).alias("query"), "word")
        out = part if out is None else out.union(part)
    return out


def fn_split_overlap(spark, d):
    n = notes(spark, d).where("text is not null")
    w = n.select("doc_id", F.posexplode(T.split_overlap(F.col("text"), 2800, 300)).alias("k", "part"))
    return w.select("doc_id", F.col("k").cast("long").alias("k"), F.length("part").cast("long").alias("size"), F.md5("part").alias("md5"))


def fn_text_hash(spark, d):
    return notes(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


def fn_trimmed(spark, d):
    return notes(spark, d).where("title is not null").select("doc_id", T.trimmed(F.col("title"), 18).alias("short"))


def fn_content_dates(spark, d):
    return notes(spark, d).where("text is not null").select("doc_id", T.date_of_content(F.col("text"), F.col("path"), F.col("updated_at"), NOW).alias("date"))


def fn_typed_scalars(spark, d):
    """Times and numbers written in several ways, brought to canonical text."""
    m = table(spark, d, "agent_messages").select("created_at").distinct()
    return m.select("created_at", S.typed(F.col("created_at"), "datetime").alias("datetime"), S.typed(F.substring("created_at", 1, 10), "date").alias("date"), S.typed(F.col("created_at"), "int").alias("int"))


def fn_property_types(spark, d):
    p = _values(spark, d)
    return p.select("value").distinct().select("value", S.inferred_type(F.col("value")).alias("type"))


def fn_json_fields(spark, d):
    """A field of JSON text through a variant."""
    m = table(spark, d, "agent_messages").where("context_json is not null").select("id", "context_json").distinct()
    v = F.try_parse_json("context_json")
    return m.select("id", F.try_variant_get(v, "$.path", "string").alias("path"), F.try_variant_get(v, "$.sel", "bigint").alias("sel"))


def fn_list_fields(spark, d):
    """Ordered lists from rows with ordinals."""
    f = table(spark, d, "note_fragment_targets").select("note_id", "ordinal", "target_norm").distinct()
    return f.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "target_norm"))), lambda x: x["target_norm"]), ";").alias("targets"))


def fn_next_id(spark, d):
    """The next number of each file name format."""
    parts = F.regexp_extract("path", r"([a-z-]+)-(\d+)\.md$", 1), F.regexp_extract("path", r"([a-z-]+)-(\d+)\.md$", 2)
    n = notes(spark, d).select(parts[0].alias("format"), parts[1].try_cast("bigint").alias("n")).where("n is not null")
    return n.groupBy("format").agg((F.max("n") + 1).alias("next"))


def fn_edge_weights(spark, d):
    r = table(spark, d, "intel_symbol_refs").groupBy("src_file_id", "ref_kind").agg(F.count(F.lit(1)).alias("n"))
    return r.select("src_file_id", "ref_kind", F.round(S.edge_weight(F.col("ref_kind"), F.col("n")), 6).alias("weight"))


def fn_confidence(spark, d):
    n = notes(spark, d).select("doc_id", F.element_at(F.array(*map(F.lit, ["inferred", " Ambiguous", "extracted", None])), (F.col("doc_id") % 4 + 1).cast("int")).alias("label"), ((F.col("doc_id") % 7) / 5.0 - 0.2).cast("double").alias("score"))
    return n.select("doc_id", F.round(S.confidence(F.col("label"), F.col("score")), 6).alias("confidence"), F.round(1 - S.confidence(F.col("label"), F.col("score")), 6).alias("cost"), F.round(S.surprise_factor(F.col("label"), F.col("score")), 6).alias("surprise"))


def fn_proximity(spark, d):
    a = anchors(spark, d).where("path is not null").select("path").distinct()
    return a.select("path", S.proximity(F.col("path"), ["apps/anchor/deterministic_1334.ts", "libs/wikilink_1.go", "services"]).cast("long").alias("proximity"))


def fn_path_classes(spark, d):
    a = anchors(spark, d).where("path is not null").select("path").distinct()
    return a.select("path", S.is_test_path(F.col("path")).alias("test"), S.doc_class(F.regexp_replace("path", "^libs/", "docs/hubs/"), F.lit("note")).alias("class"))


def fn_community_ids(spark, d):
    g = notes(spark, d).where("doc_kind is not null").groupBy(F.col("doc_kind").alias("label")).agg(F.array_sort(F.collect_set("path")).alias("m"))
    return g.select("label", F.concat(F.lit("c"), F.substring(F.sha1(F.concat(F.col("label"), F.lit("|"), F.element_at("m", 1), F.lit("|"), F.array_join("m", ";"), F.lit(";")).cast("binary")), 1, 8)).alias("community"))


def fn_chunks(spark, d):
    """Heading-aware chunks; the scan keeps state, so it runs on Arrow batches."""
    return C.chunked(notes(spark, d))


def fn_masked_code(spark, d):
    return notes(spark, d).select("doc_id", C.mask_code(F.col("text")).alias("text"))


def fn_frontmatter_json(spark, d):
    return notes(spark, d).select("doc_id", C.frontmatter_json(F.col("text")).alias("front"))


def fn_unified_diff(spark, d):
    n = notes(spark, d).where("text is not null")
    after = F.lag("text").over(Window.partitionBy("title").orderBy("doc_id"))
    return n.withColumn("old", after).where("old is not null").select("doc_id", C.unified_diff(F.col("old"), F.col("text")).alias("diff"))


def agg_note_statistics(spark, d):
    """Notes in all, with how many are stale (an active status, not updated for 30 days; never updated is never stale)."""
    n = notes(spark, d).select("updated_at", T.front_value(F.col("text"), "status").alias("status"))
    stale = F.lower("status").isin("open", "draft") & (F.col("updated_at") < F.lit(NOW).cast("timestamp") - F.expr("interval 30 days"))
    return n.agg(F.count(F.lit(1)).alias("notes"), F.sum(F.when(stale, 1).otherwise(0)).alias("stale"), F.sum(F.when(F.col("status") != "", 1).otherwise(0)).alias("with_status"))


def agg_month_histogram(spark, d):
    """Rows per month, newest first, undated last."""
    n = notes(spark, d).groupBy(F.date_format("updated_at", "yyyy-MM").alias("month"), "doc_kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return n.orderBy(F.desc_nulls_last("month"), "doc_kind")


QUERIES = {k: _filter(k) for k in FILTERS} | {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("agg", "fn", "filter") and callable(f)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_FRONT = T.FRONTMATTER
_front = f"regexp_extract(text, {_q(_FRONT)}, 1)"
_value = lambda k: f"regexp_extract({_front}, {_q('(?m)^' + k + r':[ \t]*([^\n\r]*?)[ \t]*\r?$')}, 1)"
_body = f"regexp_replace(text, {_q(_FRONT)}, '')"
_clean = f"regexp_replace(regexp_replace({_body}, {_q(T.FENCED)}, ' ', 'g'), {_q(T.INLINE_CODE)}, ' ', 'g')"
_normal = lambda t: f"lower(regexp_replace(trim({t}), '^#+', ''))"
_dist = lambda x: f"list_distinct({x})"
_first = lambda x: f"(SELECT list(v ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT unnest({x}) AS v, unnest(range(len({x}))) AS k) GROUP BY v))"
_hash = f"list_filter(list_transform(regexp_extract_all({_clean}, {_q(T.HASHTAG)}, 1), lambda t: {_normal('t')}), lambda t: regexp_matches(t, '\\p{{L}}'))"
_ftags = "list_filter(list_transform(string_split(regexp_replace(" + _value("tags") + r""", '^\[|\]$', '', 'g'), ','), lambda t: """ + _normal("regexp_replace(t, '[\"'']', '', 'g')") + "), lambda t: t <> '')"
_P = f"""WITH n AS MATERIALIZED (SELECT doc_id, path, title, doc_kind, updated_at, text, {_value('type')} AS type, {_value('status')} AS status, {_value('owner')} AS owner,
  coalesce(list_concat({_ftags}, {_hash}), []) AS tags FROM documents)
"""
_tag = lambda w: f"len(list_filter(tags, lambda t: t = '{w}' OR t LIKE '{w}/%')) > 0"
_nv = lambda c: rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({c}), '^[\"'']|[\"'']$', '', 'g'), '^\[\[|\]\]$', '', 'g'), '\|.*$', '')))"
_under = lambda p: f"(path = '{p}' OR path LIKE '{p}/%')"
_tok = lambda c: f"list_transform(list_filter(string_split(regexp_replace(regexp_replace({c}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda t: strlen(t) >= 2), lambda t: lower(t))"
_bare = lambda v: rf"regexp_replace(regexp_replace(trim({v}), '^\"(.*)\"$', '\1'), '^''(.*)''$', '\1')"
#: Every top-level front matter key with its values: a scalar, or the items of a list; of repeated keys the first holds.
_VALUES = f"""WITH f AS (SELECT doc_id, {_front} AS f FROM documents),
k AS (SELECT doc_id, unnest(regexp_extract_all(f, {_q(T._FRONT_KEY)}, 1)) AS key, unnest(regexp_extract_all(f, {_q(T._FRONT_KEY)}, 2)) AS v, unnest(regexp_extract_all(f, {_q(T._FRONT_KEY)}, 3)) AS block, unnest(range(len(regexp_extract_all(f, {_q(T._FRONT_KEY)}, 1)))) AS i FROM f),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1),
r AS (SELECT doc_id, key, CASE WHEN v LIKE '[_%]' AND v NOT LIKE '[[%' THEN regexp_extract_all(v[2:-2], {_q(T._ITEM)}, 1) WHEN v = '[]' THEN [] WHEN v = '' THEN regexp_extract_all(block, '\n[ \t]*-[ \t]+([^\n\r]*)', 1) ELSE [v] END AS raw FROM o),
p AS (SELECT doc_id, key, unnest(list_filter(list_transform(raw, lambda x: {_bare('x')}), lambda x: x <> '')) AS value FROM r)
"""
_kind = lambda t: rf"CASE WHEN lower(trim({t})) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(trim({t}), '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches(trim({t}), '^[+-]?[0-9]*\.[0-9]+$') THEN 'float' WHEN regexp_matches(trim({t}), '^\[\[[^\[\]]+\]\]$') THEN 'wikilink' WHEN regexp_matches(trim({t}), '^(?i:https?)://[^\s]+$') THEN 'url' WHEN regexp_matches(trim({t}), '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}') THEN 'datetime' WHEN regexp_matches(trim({t}), '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'date' ELSE 'string' END"
_links = f"SELECT doc_id, unnest(regexp_extract_all({_clean}, {_q('(' + T.WIKILINK + ')')}, 1)) AS l FROM documents"

SQL = {
    "filter_tag": _P + f"SELECT path FROM n WHERE {_tag('graph')}",
    "filter_tag_hierarchy": _P + f"SELECT path FROM n WHERE {_tag('infra')} OR {_tag('area')}",
    "filter_property": _P + f"SELECT path FROM n WHERE {_nv('type')} = 'note' AND coalesce({_nv('status')}, '') <> 'draft'",
    "filter_path": f"SELECT path FROM documents WHERE {_under('meetings')} OR {_under('runbooks')}",
    "filter_find": "SELECT path FROM documents WHERE (path LIKE '%/%' AND lower(path) LIKE 'd%' AND regexp_matches(regexp_replace(lower(path), '^[^/]*/', ''), 'access-rules')) OR regexp_matches(lower(path), 'search\\.\\*quality')",
    "filter_combined": _P + f"SELECT path FROM n WHERE ({_tag('review')} OR {_tag('q3')}) AND NOT (coalesce({_nv('status')}, '') = 'superseded' OR {_under('guides')})",
    "filter_by_sets": _P + f"SELECT path FROM n WHERE {_tag('graph')} UNION SELECT path FROM n WHERE {_nv('status')} = 'draft' EXCEPT SELECT path FROM n WHERE {_under('meetings')}",
    "filter_ordered_terms": f"""WITH t AS (SELECT doc_id, unnest({_tok('title')}) AS w, unnest(range(len({_tok('title')}))) AS k FROM documents)
SELECT DISTINCT a.doc_id AS note_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.k > a.k JOIN t c ON c.doc_id = a.doc_id AND c.k > b.k WHERE a.w LIKE 's%' AND b.w LIKE 'q%' AND c.w LIKE 'b%'""",
    "agg_tag_rollup": _P + """, t AS (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM n), p AS (SELECT DISTINCT doc_id, array_to_string(string_split(tag, '/')[1:i], '/') AS tag FROM (SELECT *, unnest(range(1, len(string_split(tag, '/')) + 1)) AS i FROM t))
SELECT p.tag, coalesce(any_value(o.own), 0) AS own, count(*) AS notes FROM p LEFT JOIN (SELECT tag, count(*) AS own FROM t GROUP BY 1) o USING (tag) GROUP BY p.tag""",
    "agg_property_profile": _VALUES + f"SELECT key, count(DISTINCT doc_id) AS n, count(DISTINCT value) AS \"values\", string_agg(DISTINCT {_kind('value')}, ',' ORDER BY {_kind('value')}) AS types, count(DISTINCT value) <= 20 AS enum_like FROM p GROUP BY key",
    "agg_property_lookup": _P + f"SELECT path FROM n WHERE {_nv('status')} = 'open'",
    "fn_slugs": r"""SELECT doc_id, regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_ -]', '', 'g'), ' ', '-') AS web,
  trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]', ' ', 'g'), ' +', ' ', 'g')) AS key, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\.md$', '')), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM documents""",
    "fn_hashtags": f"SELECT doc_id, coalesce(array_to_string({_first('h')}, ','), '') AS tags FROM (SELECT doc_id, {_hash} AS h FROM documents WHERE text IS NOT NULL)",
    "fn_front_tags": f"SELECT doc_id, array_to_string({_ftags}, ',') AS tags FROM documents WHERE text IS NOT NULL",
    "fn_wikilinks": rf"""WITH l AS ({_links}), i AS (SELECT *, regexp_extract(l, '\[\[([^\[\]\n]+)\]\]', 1) AS t FROM l), s AS (SELECT *, regexp_extract(t, '^([^|]*)', 1) AS spot FROM i), a AS (SELECT *, regexp_extract(spot, '#(.*)$', 1) AS a FROM s)
SELECT doc_id, trim(regexp_extract(spot, '^([^#]*)', 1)) AS target, CASE WHEN a LIKE '^%' THEN '' ELSE trim(a) END AS heading, CASE WHEN a LIKE '^%' THEN trim(a[2:]) ELSE '' END AS block, trim(regexp_extract(t, '\|(.*)$', 1)) AS alias, l LIKE '!%' AS embed, count(*) AS n FROM a GROUP BY ALL""",
    "fn_markdown_links": rf"SELECT doc_id, regexp_extract(l, '^\[([^\[\]\n]*)\]', 1) AS label, regexp_extract(l, '\(([^()\s]+)\)$', 1) AS href, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_clean}, {_q('(' + T.MDLINK + ')')}, 1)) AS l FROM documents) GROUP BY ALL",
    "fn_headings": f"""WITH b AS (SELECT doc_id, regexp_replace({_body}, {_q(T.FENCED)}, ' ', 'g') AS b FROM documents), h AS (SELECT doc_id, regexp_extract_all(b, {_q(T.HEADING)}, 1) AS h, regexp_extract_all(b, {_q(T.HEADING)}, 2) AS t FROM b)
SELECT doc_id, unnest(range(len(h))) AS ord, length(unnest(h)) AS level, trim(unnest(t)) AS heading FROM h""",
    "fn_inline_properties": f"""WITH c AS (SELECT doc_id, {_clean} AS c FROM documents) SELECT DISTINCT doc_id, lower(trim(k)) AS key, trim(v) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(c, {_q(T.PROPERTY)}, 1)) AS k, unnest(regexp_extract_all(c, {_q(T.PROPERTY)}, 2)) AS v FROM c)""",
    "fn_block_ids": f"SELECT DISTINCT note_id, regexp_extract('see ' || target_text, {_q(T.BLOCK_ID)}, 1) AS block FROM note_fragment_targets WHERE target_kind = 'block'",
    "fn_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_tok('name')}) AS token FROM (SELECT id, min(name) AS name FROM symbols WHERE id IS NOT NULL GROUP BY 1)) GROUP BY 1",
    "fn_variants": f"""WITH w AS (SELECT DISTINCT unnest({_tok('title')}) AS token FROM documents), g AS (SELECT token, CASE WHEN token IN ('embedded', 'embedding', 'embeddings', 'embedder', 'embedders') THEN ['embed', 'embedded', 'embedding', 'embeddings']
  WHEN token = 'embed' THEN ['embedded', 'embedding', 'embeddings'] WHEN token IN ('note', 'notes') THEN ['note', 'notes'] WHEN token IN ('indexed', 'indexing', 'indexes') THEN ['index', 'indexed', 'indexing'] ELSE [] END AS more,
  CASE WHEN token LIKE '%ies' AND strlen(token) > 3 THEN token[:-4] || 'y' WHEN token LIKE '%s' AND strlen(token) > 3 THEN token[:-2] END AS one FROM w)
SELECT token, array_to_string(list_concat([token], CASE WHEN one IS NOT NULL THEN [one] ELSE [] END, list_filter(more, lambda m: m <> token AND m IS DISTINCT FROM one)), ',') AS variants FROM g""",
    "fn_path_classes": WITH + r""", a AS (SELECT DISTINCT path, lower(path) AS l, lower(regexp_replace(path, '^libs/', 'docs/hubs/')) AS m FROM anchor WHERE path IS NOT NULL)
SELECT path, regexp_matches(l, '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(l, '(_test\.go|(^|/)test_[^/]*\.py|_test\.py|\.(test|spec)\.[jt]sx?|tests?\.cs|test\.php)$') AS test, CASE WHEN trim(m) = '' THEN 'none' WHEN m LIKE 'docs/hubs/%' THEN 'hub' WHEN regexp_matches(m, '^\.(codex|claude|cursor)/|/templates/skills/') THEN 'generated' WHEN m IN ('readme.md', 'agents.md', 'claude.md') THEN 'repo_global' WHEN regexp_matches(m, '(^|/)context\.md$') THEN 'module' ELSE 'none' END AS class FROM a""",
    "fn_proximity": WITH + r""", s(seed, home, depth) AS (VALUES ('apps/anchor/deterministic_1334.ts', 'apps/anchor', 2), ('libs/wikilink_1.go', 'libs', 1), ('services', '', 0)), a AS (SELECT DISTINCT path, CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, string_split(path, '/') AS st FROM anchor WHERE path IS NOT NULL),
k AS (SELECT path, seed, depth, folder, home, len(list_filter(range(1, len(string_split(seed, '/')) + 1), lambda i: len(st) >= i AND st[1:i] = string_split(seed, '/')[1:i])) AS shared FROM a, s)
SELECT path, max(CASE WHEN path = '' THEN 0 WHEN path = seed THEN 4 WHEN folder = home OR path LIKE seed || '/%' OR seed LIKE path || '/%' THEN 3 WHEN depth > 0 AND shared >= depth THEN 2 WHEN depth = 0 AND shared >= 1 THEN 1 ELSE 0 END) AS proximity FROM k GROUP BY 1""",
    "fn_concept_coverage": f"SELECT * FROM (SELECT doc_id, round((list_has_any(t, ['index', 'indexed', 'indexing'])::INT + list_has_any(t, ['quality'])::INT + list_has_any(t, ['block', 'blocks'])::INT + list_has_any(t, ['note', 'notes'])::INT) / 4.0, 6) AS coverage FROM (SELECT doc_id, {_tok('title')} AS t FROM documents)) WHERE coverage > 0",
    "fn_match_score": "SELECT * FROM (SELECT doc_id, round((contains(lower(title), 'rule')::INT + contains(lower(title), 'heading')::INT + contains(lower(title), 'id')::INT) / 3.0, 6) AS score FROM documents) WHERE score > 0",
    "fn_jaccard": f"""WITH t AS (SELECT doc_id, {_tok('title')} AS a, {_tok("regexp_replace(path, '\\.md$', '')")} AS b FROM documents), u AS (SELECT doc_id, {_first('a')} AS a, {_first('b')} AS b FROM t)
SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE round(coalesce(len(list_intersect(a[1:20], b[1:20])) / len(list_distinct(list_concat(a[1:20], b[1:20]))), 0), 6) END AS jaccard FROM u""",
    "fn_typos": f"SELECT q AS query, w AS word FROM (SELECT DISTINCT unnest({_tok('title')}) AS w FROM documents), (VALUES ('serach'), ('qualty'), ('migrations'), ('onboardign'), ('tempxlate')) v(q) WHERE length(w) >= 5 AND damerau_levenshtein(q, w) <= 1",
    "fn_split_overlap": "SELECT doc_id, k, length(part) AS size, md5(part) AS md5 FROM (SELECT doc_id, k, substring(text, k * 2500 + 1, 2800) AS part FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 300) / 2500.0)::BIGINT, 1))) AS k FROM documents WHERE text IS NOT NULL))",
    "fn_text_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "fn_trimmed": r"SELECT doc_id, CASE WHEN length(title) <= 18 THEN title ELSE (CASE WHEN regexp_replace(title[1:17], '\s+\S*\z', '') = '' THEN title[1:17] ELSE regexp_replace(title[1:17], '\s+\S*\z', '') END) || '…' END AS short FROM documents WHERE title IS NOT NULL",
    "fn_content_dates": f"""WITH b AS (SELECT doc_id, path, {_front} AS f, {_body} AS b FROM documents WHERE text IS NOT NULL), h AS (SELECT *, list_filter(list_transform(regexp_extract_all(regexp_replace(b, {_q(T.FENCED)}, ' ', 'g'), {_q(T.HEADING)}, 2), lambda x: regexp_extract(x, {_q(T.DATE)}, 1)), lambda x: x <> '') AS l FROM b)
SELECT doc_id, CASE WHEN x IS NOT NULL THEN least(x, '{NOW}') END AS date FROM (SELECT doc_id, coalesce(nullif(regexp_extract(f, {_q('(?m)^(?:date|created|updated):[ ' + chr(92) + 't]*["' + chr(39) + ']?((?:19|20)' + chr(92) + 'd' + chr(92) + 'd-' + chr(92) + 'd' + chr(92) + 'd-' + chr(92) + 'd' + chr(92) + 'd)')}, 1), ''), nullif(regexp_extract(regexp_replace(path, '^.*/', ''), {_q(T.DATE.replace(chr(92) + 'b', ''))}, 1), ''),
  l[len(l)], nullif(regexp_extract(array_to_string(string_split(b, chr(10))[1:5], chr(10)), {_q(T.DATE)}, 1), '')) AS x FROM h)""",
    "fn_typed_scalars": r"""WITH m AS (SELECT DISTINCT created_at FROM agent_messages), x AS (SELECT created_at, trim(created_at) AS t, regexp_extract(trim(created_at), '^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(?::\d\d)?)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)?$', ['day', 'clock', 'frac', 'zone']) AS p FROM m)
SELECT created_at, strftime(TRY_CAST(p.day || ' ' || CASE WHEN length(p.clock) = 5 THEN p.clock || ':00' ELSE p.clock END AS TIMESTAMP) - CASE WHEN length(p.zone) = 6 THEN to_minutes((CASE WHEN p.zone[1] = '-' THEN -1 ELSE 1 END) * (p.zone[2:3]::INT * 60 + p.zone[5:6]::INT)) ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%S') || '.' || rpad(p.frac, 9, '0') || 'Z' AS datetime,
  CASE WHEN regexp_matches(trim(created_at[1:10]), '^\d{4}-\d\d-\d\d$') THEN strftime(TRY_CAST(trim(created_at[1:10]) AS DATE), '%Y-%m-%d') END AS date, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN CAST(TRY_CAST(t AS BIGINT) AS VARCHAR) END AS int FROM x""",
    "fn_property_types": _VALUES + f"SELECT DISTINCT value, {_kind('value')} AS type FROM p",
    "fn_json_fields": "SELECT DISTINCT id, context_json ->> '$.path' AS path, TRY_CAST(context_json ->> '$.sel' AS BIGINT) AS sel FROM agent_messages WHERE context_json IS NOT NULL",
    "fn_list_fields": "SELECT note_id, string_agg(target_norm, ';' ORDER BY ordinal NULLS FIRST, target_norm NULLS FIRST) AS targets FROM (SELECT DISTINCT note_id, ordinal, target_norm FROM note_fragment_targets) GROUP BY 1",
    "fn_next_id": r"SELECT format, max(n) + 1 AS next FROM (SELECT regexp_extract(path, '([a-z-]+)-(\d+)\.md$', 1) AS format, TRY_CAST(regexp_extract(path, '([a-z-]+)-(\d+)\.md$', 2) AS BIGINT) AS n FROM documents) WHERE n IS NOT NULL GROUP BY 1",
    "fn_edge_weights": "SELECT src_file_id, ref_kind, round(CASE lower(trim(ref_kind)) WHEN 'calls' THEN 0.25 * least(n, 5) WHEN 'type_ref' THEN 0.15 * least(n, 4) WHEN 'member_ref' THEN 0.12 * least(n, 4) WHEN 'imports' THEN 0.1 * least(n, 3) WHEN 'tests' THEN 0.08 * least(n, 3) ELSE 0 END, 6) AS weight FROM (SELECT src_file_id, ref_kind, count(*) AS n FROM intel_symbol_refs GROUP BY 1, 2)",
    "fn_confidence": """WITH x AS (SELECT doc_id, (doc_id % 7) / 5.0 - 0.2 AS s, ['inferred', ' Ambiguous', 'extracted', NULL][doc_id % 4 + 1] AS l FROM documents), c AS (SELECT doc_id, CASE WHEN s > 0 THEN least(s, 1.0) WHEN lower(trim(l)) = 'inferred' THEN 0.7 WHEN lower(trim(l)) = 'ambiguous' THEN 0.2 ELSE 1.0 END AS c FROM x)
SELECT doc_id, round(c, 6) AS confidence, round(1 - c, 6) AS cost, round(1 + 2 * (1 - c), 6) AS surprise FROM c""",
    "fn_community_ids": "SELECT doc_kind AS label, 'c' || sha1(doc_kind || '|' || min(path) || '|' || string_agg(DISTINCT path, ';' ORDER BY path) || ';')[1:8] AS community FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1",
    "agg_note_statistics": _P + f"SELECT count(*) AS notes, count(*) FILTER (lower(status) IN ('open', 'draft') AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS stale, count(*) FILTER (status <> '') AS with_status FROM n",
    "agg_month_histogram": "SELECT strftime(updated_at, '%Y-%m') AS month, doc_kind, count(*) AS n, min(path) AS first FROM documents GROUP BY 1, 2",
}
