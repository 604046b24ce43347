"""Queries over the given link tables: hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import hierarchy, orphans
from tracewell.runtime import table

REFERENCES = [
    orphans.Reference("intel_symbol_refs", "dst_target_id", "intel_symbol_ref_targets", "target_id"),
    orphans.Reference("intel_symbol_refs", "src_file_id", "intel_symbol_ref_files", "file_id"),
    orphans.Reference("note_fragment_targets", "note_id", "notes", "id", parent_epoch=True),
    orphans.Reference("symbols", "file", "files", "path", path=True),
]


def _spans(spark, d):
    return hierarchy.intervals(hierarchy.links(table(spark, d, "super_edges")))


def p2_found(spark, d):
    """Names that are a child, with their topmost ancestor and depth; '' and -1 in or below a ring."""
    spans = _spans(spark, d)
    return spans.where(F.col("parent").isNotNull()).select(F.col("name").alias("node_fqn"), F.col("root").alias("root_fqn"), "depth")


def p2_paths(spark, d):
    spans = _spans(spark, d)
    return hierarchy.paths(spans, hierarchy.ancestors(spans)).select(F.col("name").alias("node_fqn"), F.col("root").alias("root_fqn"), "depth", "path")


def p2_descendants(spark, d):
    return hierarchy.ancestors(_spans(spark, d)).select(F.col("ancestor").alias("node_fqn"), F.col("name").alias("descendant_fqn"), "steps")


def _tables(spark, d):
    return {n: table(spark, d, n) for r in REFERENCES for n in (r.ref_table, r.parent_table)}


def p4_found(spark, d):
    """The distinct orphan references per key and month."""
    return orphans.orphans(_tables(spark, d), REFERENCES)


def p4_report(spark, d):
    return orphans.orphan_report(_tables(spark, d), REFERENCES)


_TRIM = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

_WALK = f"""
WITH RECURSIVE link AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT {_TRIM('child_fqn')} AS child, {_TRIM('parent_fqn')} AS parent FROM super_edges WHERE lower({_TRIM('kind')}) = 'extends')
  WHERE child <> '' AND parent <> '' GROUP BY child),
root AS (SELECT DISTINCT parent AS node FROM link WHERE parent NOT IN (SELECT child FROM link)),
down AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM root
  UNION ALL
  SELECT l.child, d.root, d.depth + 1, d.path || ' > ' || l.child FROM down d JOIN link l ON l.parent = d.node),
node AS (SELECT child AS node FROM link UNION SELECT parent FROM link)
"""


def _found_sql(ref: orphans.Reference) -> str:
    def canon(c):
        plain = rf"regexp_replace(regexp_replace(replace({_TRIM(c)}, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g')"
        for _ in range(4):
            plain = rf"regexp_replace({plain}, '(^|/)[^/.][^/]*/\.\./', '\1')"
        return plain

    key, pkey = (canon(ref.ref_field), canon(ref.parent_field)) if ref.path else (f"CAST({ref.ref_field} AS VARCHAR)", f"CAST({ref.parent_field} AS VARCHAR)")
    at = f"CAST(to_timestamp({ref.parent_time}) AT TIME ZONE 'UTC' AS TIMESTAMP)" if ref.parent_epoch else ref.parent_time
    return f"""
SELECT '{ref.ref_table}' AS ref_table, '{ref.ref_field}' AS ref_field, r.k AS missing_key, coalesce(strftime(r.at, '%Y-%m'), 'unknown') AS period,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' ELSE 'late' END AS state
FROM (SELECT {key} AS k, {ref.ref_time} AS at FROM {ref.ref_table} WHERE {ref.ref_field} IS NOT NULL) r
LEFT JOIN (SELECT {pkey} AS k, min({at}) AS first_at, bool_and(deleted_at IS NOT NULL) AS gone FROM {ref.parent_table} WHERE {ref.parent_field} IS NOT NULL GROUP BY 1) p ON p.k = r.k
WHERE p.k IS NULL OR p.gone OR p.first_at > r.at"""


_ORPHAN_ROWS = " UNION ALL ".join(_found_sql(r) for r in REFERENCES)

QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p4_found, p4_report)}
SQL = {
    "p2_found": _WALK + "SELECT l.child AS node_fqn, coalesce(d.root, '') AS root_fqn, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth FROM link l LEFT JOIN down d ON d.node = l.child",
    "p2_paths": _WALK + "SELECT n.node AS node_fqn, coalesce(d.root, '') AS root_fqn, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth, d.path FROM node n LEFT JOIN down d ON d.node = n.node",
    "p2_descendants": _WALK.replace("\nnode AS", "\nover AS (SELECT child AS low, parent AS high, 1 AS steps FROM link WHERE child IN (SELECT node FROM down)"
        " UNION ALL SELECT o.low, l.parent, o.steps + 1 FROM over o JOIN link l ON l.child = o.high),\nnode AS")
        + "SELECT high AS node_fqn, low AS descendant_fqn, CAST(steps AS BIGINT) AS steps FROM over",
    "p4_found": f"SELECT DISTINCT * FROM ({_ORPHAN_ROWS})",
    "p4_report": f"SELECT ref_table, ref_field, period, state, count(DISTINCT missing_key) AS orphan_keys, CAST(count(*) AS BIGINT) AS orphan_rows FROM ({_ORPHAN_ROWS}) GROUP BY ALL",
}
