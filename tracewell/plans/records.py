"""Typed records over parts: p_brand, p_type, p_size and p_retailprice as fields; and over documents, chunks and the code tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import typed as Y
from tracewell.plans.frames import WITH, anchors, notes
from tracewell.runtime import table

SCHEMA = Y.Schema({"Big": {"brand": "string", "kind": "string", "size": "int", "price": "real", "near": "link"}, "Small": {"brand": "string", "kind": "string", "size": "int", "price": "real", "near": "link"}}, {"Part": ("Big", "Small")})


def nodes(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") > 25, "Big").otherwise("Small").alias("type_name"), F.concat(F.lit("parts/"), F.lower("p_brand"), F.lit(".md")).alias("note_path"), (F.col("p_partkey") * 10).alias("start_byte"), F.col("p_name").alias("title"))


def values(spark, d):
    """brand is absent where the key divides by 7, an authored null where by 11; kind is a list of the words of type and name."""
    p = table(spark, d, "part").withColumn("type_name", F.when(F.col("p_size") > 25, "Big").otherwise("Small"))
    row = lambda name, kind, norm, num, ordinal, presence="value", target=None: F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("value_kind"), norm.alias("value_norm"), num.cast("double").alias("value_num"), F.lit(target).cast("long").alias("target_node_id") if not isinstance(target, F.Column) else target.cast("long").alias("target_node_id"), F.lit(ordinal).alias("ordinal"), (F.lit(presence) if isinstance(presence, str) else presence).alias("presence"))
    null = F.lit(None)
    words = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    rows = F.concat(
        F.when(F.col("p_partkey") % 7 == 0, F.array().cast("array<struct<field_name:string,value_kind:string,value_norm:string,value_num:double,target_node_id:bigint,ordinal:int,presence:string>>")).otherwise(
            F.array(row("brand", "string", F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.lower("p_brand")), null, 0, F.when(F.col("p_partkey") % 11 == 0, "null").otherwise("value")))
        ),
        F.transform(words, lambda w: row("kind", "string", w, null, 0)),
        F.array(row("size", "int", F.col("p_size").cast("string"), F.col("p_size"), 0), row("price", "real", F.lit(""), F.col("p_retailprice"), 0), row("near", "link", F.lit(""), null, 0, "value", F.col("p_partkey") % 50 + 1)),
    )
    return p.select(F.col("p_partkey").alias("node_id"), "type_name", F.explode(rows).alias("v")).select("node_id", "type_name", "v.*")


PLANS = {
    "typed_eq": Y.Plan(("Big",), (Y.Filter("brand", "eq", ("brand#12",)),), first=1_000_000),
    "typed_in": Y.Plan(("Big", "Small"), (Y.Filter("size", "in", (3, 14, 45), "int"),), first=1_000_000),
    "typed_range": Y.Plan(("Big", "Small"), (Y.Filter("price", "gte", (950.0,), "real"), Y.Filter("price", "lt", (1000.0,), "real")), first=1_000_000),
    "typed_neq_list": Y.Plan(("Small",), (Y.Filter("kind", "neq", ("widget",)),), first=1_000_000),
    "typed_contains": Y.Plan(("Small",), (Y.Filter("kind", "contains", ("idg",)),), first=1_000_000),
    "typed_exists": Y.Plan(("Big",), (Y.Filter("brand", "exists"),), first=1_000_000),
    "typed_missing": Y.Plan(("Big",), (Y.Filter("brand", "missing"),), first=1_000_000),
    "typed_link": Y.Plan(("Big", "Small"), (Y.Filter("near", "eq", (7,), "link"),), first=1_000_000),
    "typed_path": Y.Plan(("Big",), path="parts/brand#12.md", first=1_000_000),
    "typed_page": Y.Plan(("Big", "Small"), (Y.Filter("kind", "eq", ("ring",)),), (Y.Sort("brand"), Y.Sort("price", True, "real")), 15, 30),
    "typed_page_list_sort": Y.Plan(("Big",), (), (Y.Sort("kind", True), Y.Sort("size", False, "int")), 25, 5),
}


def _typed(name):
    def run(spark, d):
        SCHEMA.check(PLANS[name])
        out = Y.page(nodes(spark, d), values(spark, d), PLANS[name])
        return out.select("node_id", "type_name", "note_path", "title")

    run.__name__ = name
    return run


def typed_selection(spark, d):
    """Fields under other names, in the order asked for."""
    rows = nodes(spark, d).where("type_name = 'Big'").select("node_id", "title")
    return Y.selected(rows, values(spark, d), {"cost": ("price", "real"), "words": ("kind", "string"), "maker": ("brand", "string"), "extent": ("size", "int")})


def typed_field_counts(spark, d):
    return Y.field_counts(values(spark, d), "kind")


def typed_summaries(spark, d):
    issues = values(spark, d).where("field_name = 'brand' and presence = 'null'").select("node_id")
    return Y.type_summaries(nodes(spark, d), issues)


def typed_totals(spark, d):
    """Notes, typed ones, issues: one pass with left joins."""
    n = notes(spark, d).select("doc_id", T.front_value(F.col("text"), "type").alias("type"), T.front_value(F.col("text"), "status").alias("status"))
    return n.agg(F.count(F.lit(1)).alias("notes"), F.sum(F.when(F.col("type") != "", 1).otherwise(0)).alias("typed"), F.sum(F.when((F.col("type") != "") & (F.col("status") == ""), 1).otherwise(0)).alias("issues"))


def typed_relation_counts(spark, d):
    l = table(spark, d, "lineitem")
    by_part = l.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    returned = l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    return Y.relation_counts(nodes(spark, d).select("node_id"), [by_part, returned])


def typed_reverse(spark, d):
    """For each node the nodes that link to it, counted."""
    v = values(spark, d).where("field_name = 'near'")
    return nodes(spark, d).join(v.select(F.col("target_node_id").alias("node_id"), F.col("node_id").alias("from")), "node_id").groupBy("node_id", "title").agg(F.count(F.lit(1)).alias("referrers"))


def typed_resolution(spark, d):
    names = notes(spark, d).select(F.explode(F.array("title", "path", F.regexp_replace("path", r"^.*/|\.md$", ""))).alias("name")).where("name is not null").distinct()
    return Y.resolved(names, notes(spark, d))


def typed_sections(spark, d):
    """Chunks inside each body chunk of the same document, by byte ranges: an equality join on the document with a range residual."""
    c = table(spark, d, "intel_chunks_new").where("owner_row_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("owner_row_id", "granularity", "start_byte", "end_byte"), F.struct("updated_at", "id")).alias("c")).select("chunk_id", "c.*")
    outer = c.where("lower(trim(granularity)) = 'body'").select(F.col("chunk_id").alias("outer_id"), "owner_row_id", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    inside = c.join(outer, "owner_row_id").where((F.col("start_byte") >= F.col("s")) & (F.col("start_byte") < F.col("e")) & (F.col("chunk_id") != F.col("outer_id")))
    return inside.groupBy("outer_id").agg(F.count(F.lit(1)).alias("inside"))


def check_identifiers(spark, d):
    return anchors(spark, d).where("fqn <> ''").groupBy("lang", "fqn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lang", "fqn", "n", F.sha2(F.concat_ws("|", F.lit("identifiers"), "lang", "fqn"), 256).alias("issue"))


def check_companion_docs(spark, d):
    """Folders of code without a note of that folder's last name."""
    folders = anchors(spark, d).where("path like '%/%'").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    words = notes(spark, d).select(F.explode(T.tokens(F.col("title"))).alias("word")).distinct()
    return folders.withColumn("word", F.regexp_extract("folder", "([^/]+)$", 1)).join(words, "word", "left_anti").select("folder")


def check_required_fields(spark, d):
    """Typed notes without a status, as issue rows."""
    n = notes(spark, d).select("path", T.front_value(F.col("text"), "type").alias("type"), T.front_value(F.col("text"), "status").alias("status"))
    return n.where("type <> '' and status = ''").select("path", "type", F.sha2(F.concat_ws("|", F.lit("required"), "path", F.lit("status")), 256).alias("issue"))


def check_issue_counts(spark, d):
    parts = [check_identifiers(spark, d).select(F.lit("identifiers").alias("check"), "issue"), check_required_fields(spark, d).select(F.lit("required").alias("check"), "issue")]
    return parts[0].unionByName(parts[1]).groupBy("check").agg(F.count(F.lit(1)).alias("issues"))


QUERIES = {k: _typed(k) for k in PLANS} | {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("typed", "check") and callable(f)}

_N = """WITH nd AS (SELECT p_partkey AS node_id, CASE WHEN p_size > 25 THEN 'Big' ELSE 'Small' END AS type_name, 'parts/' || lower(p_brand) || '.md' AS note_path, p_partkey * 10 AS start_byte, p_name AS title,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE lower(p_brand) END AS brand, string_split(lower(concat_ws(' ', p_type, p_name)), ' ') AS kind, p_size AS size, p_retailprice AS price, p_partkey % 50 + 1 AS near, p_partkey FROM part) """
_S = lambda where: _N + f"SELECT node_id, type_name, note_path, title FROM nd WHERE {where}"
_front = lambda k: r"regexp_extract(regexp_extract(text, '" + T.FRONTMATTER + r"', 1), '(?m)^" + k + r":[ \t]*([^\n\r]*?)[ \t]*\r?$', 1)"
_F = f"WITH n AS (SELECT path, {_front('type')} AS type, {_front('status')} AS status FROM documents) "
_dup = "SELECT lang, fqn, count(*) AS n, sha256('identifiers|' || lang || '|' || fqn) AS issue FROM anchor WHERE fqn <> '' GROUP BY 1, 2 HAVING count(*) > 1"
_req = "SELECT path, type, sha256('required|' || path || '|status') AS issue FROM n WHERE type <> '' AND status = ''"
SQL = {
    "typed_eq": _S("type_name = 'Big' AND brand = 'brand#12'"),
    "typed_in": _S("size IN (3, 14, 45)"),
    "typed_range": _S("price >= 950 AND price < 1000"),
    "typed_neq_list": _S("type_name = 'Small' AND NOT list_contains(kind, 'widget')"),
    "typed_contains": _S("type_name = 'Small' AND len(list_filter(kind, lambda k: contains(k, 'idg'))) > 0"),
    "typed_exists": _S("type_name = 'Big' AND brand IS NOT NULL"),
    "typed_missing": _S("type_name = 'Big' AND brand IS NULL"),
    "typed_link": _S("near = 7"),
    "typed_path": _S("type_name = 'Big' AND (note_path = 'parts/brand#12.md' OR note_path LIKE 'parts/brand#12.md/%')"),
    "typed_page": _S("list_contains(kind, 'ring') ORDER BY brand NULLS LAST, price DESC NULLS LAST, note_path, start_byte, node_id LIMIT 15 OFFSET 30"),
    "typed_page_list_sort": _S("type_name = 'Big' ORDER BY list_max(kind) DESC NULLS LAST, size NULLS LAST, note_path, start_byte, node_id LIMIT 25 OFFSET 5"),
    "typed_selection": _N + "SELECT node_id, title, price AS cost, array_to_string(list_sort(kind), ',') AS words, nullif(brand, '') AS maker, size::DOUBLE AS extent FROM nd WHERE type_name = 'Big'",
    "typed_field_counts": _N + "SELECT k AS value_norm, count(DISTINCT node_id) AS nodes FROM (SELECT node_id, unnest(kind) AS k FROM nd) GROUP BY 1",
    "typed_summaries": _N + "SELECT type_name, count(*) AS nodes, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 11 = 0) AS issues, array_to_string(list(title ORDER BY note_path, start_byte)[1:3], '; ') AS preview FROM nd GROUP BY 1",
    "typed_totals": _F + "SELECT count(*) AS notes, count(*) FILTER (type <> '') AS typed, count(*) FILTER (type <> '' AND status = '') AS issues FROM n",
    "typed_relation_counts": "SELECT p_partkey AS node_id, (SELECT count(DISTINCT d) FROM (SELECT l_partkey, l_suppkey AS d FROM lineitem UNION ALL SELECT l_partkey, l_suppkey + 1000000 FROM lineitem WHERE l_returnflag = 'R') WHERE l_partkey = p_partkey) AS n FROM part",
    "typed_reverse": _N + "SELECT a.node_id, a.title, count(*) AS referrers FROM nd a JOIN nd b ON b.near = a.node_id GROUP BY 1, 2",
    "typed_resolution": r"""WITH nm AS (SELECT DISTINCT name FROM (SELECT unnest([title, path, regexp_replace(path, '^.*/|\.md$', '', 'g')]) AS name FROM documents) WHERE name IS NOT NULL),
fm AS (SELECT path, unnest([1, 2, 3, 4]) AS rank, lower(trim(unnest([path, regexp_replace(path, '\.md$', ''), regexp_replace(regexp_replace(path, '^.*/', ''), '\.md$', ''), coalesce(title, '')]))) AS form FROM documents),
mt AS (SELECT name, rank, count(DISTINCT path) AS candidates, min(path) AS path FROM nm JOIN fm ON form = lower(trim(name)) WHERE form <> '' GROUP BY 1, 2)
SELECT n.name, CASE WHEN m.candidates = 1 THEN m.path END AS path, m.rank, coalesce(m.candidates, 0) AS candidates FROM nm n LEFT JOIN (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1) m USING (name)""",
    "typed_sections": "WITH c AS (SELECT * FROM intel_chunks_new WHERE owner_row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) = 1) SELECT o.chunk_id AS outer_id, count(*) AS inside FROM c o JOIN c i ON i.owner_row_id = o.owner_row_id AND i.start_byte >= o.start_byte AND i.start_byte < o.end_byte AND i.chunk_id <> o.chunk_id WHERE lower(trim(o.granularity)) = 'body' GROUP BY 1",
    "check_identifiers": WITH + _dup,
    "check_companion_docs": WITH + r", w AS (SELECT DISTINCT unnest(list_transform(list_filter(string_split(regexp_replace(regexp_replace(title, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{Nd}]+', ' ', 'g'), ' '), lambda t: strlen(t) >= 2), lambda t: lower(t))) AS word FROM documents) SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM anchor WHERE path LIKE '%/%' AND regexp_extract(regexp_replace(path, '/[^/]*$', ''), '([^/]+)$', 1) NOT IN (SELECT word FROM w WHERE word IS NOT NULL)",
    "check_required_fields": _F + _req,
    "check_issue_counts": WITH + ", " + _F.removeprefix("WITH ") + f"SELECT 'identifiers' AS \"check\", count(*) AS issues FROM ({_dup}) HAVING count(*) > 0 UNION ALL SELECT 'required', count(*) FROM ({_req}) HAVING count(*) > 0",
}
