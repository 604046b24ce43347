"""Frames the queries read: the given tables brought to one row per key, with the columns the operators expect; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import table


def _one(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key: of repeated rows the smallest value of each column."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in cols])


def anchors(spark, d) -> DataFrame:
    """Code anchors: symbols with a line span made of id and name, as the tables hold none."""
    rows = _one(table(spark, d, "symbols"), "id", ["lang", "kind", "file", "pkg", "name", "fqn"])
    start = F.col("id") % 97 + 1
    return rows.select(F.col("id").alias("anchor_id"), "lang", "kind", F.col("file").alias("path"), "pkg", "name", "fqn", start.alias("start_line"), (start + F.length("name")).alias("end_line"))


#: A target without a symbol of its name stands for one of its package, out of so many by its id.
MATES = 8


def targets(spark, d) -> DataFrame:
    """Reference targets. None of the given ones is an indexed symbol, so call graphs would be empty: one whose (language, fqn) is no
    symbol's stands for the symbol of its language and package with the smallest id of those whose id leaves the same rest by MATES.
    What has neither stays as it is and is unresolved."""
    t = _one(table(spark, d, "intel_symbol_ref_targets"), "target_id", ["dst_lang", "dst_pkg", "dst_name", "dst_fqn", "dst_member"])
    a = anchors(spark, d).where("fqn <> ''")
    exact = a.select(F.col("lang").alias("dst_lang"), F.col("fqn").alias("dst_fqn"), F.lit(True).alias("exact")).distinct()
    mates = a.where("pkg <> ''").groupBy(F.col("lang").alias("dst_lang"), F.col("pkg").alias("dst_pkg"), (F.col("anchor_id") % MATES).alias("rest")).agg(F.min(F.struct("anchor_id", "name", "fqn")).alias("mate"))
    rows = t.withColumn("rest", F.col("target_id") % MATES).join(exact, ["dst_lang", "dst_fqn"], "left").join(mates, ["dst_lang", "dst_pkg", "rest"], "left")
    own = lambda c, m: F.when(F.col("exact").isNull(), F.coalesce(F.col(f"mate.{m}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return rows.select("target_id", "dst_lang", "dst_pkg", own("dst_name", "name"), own("dst_fqn", "fqn"), "dst_member")


def ref_files(spark, d) -> DataFrame:
    return _one(table(spark, d, "intel_symbol_ref_files"), "file_id", ["path"])


def refs(spark, d) -> DataFrame:
    return table(spark, d, "intel_symbol_refs").select("src_file_id", "owner_symbol_id", "owner_fqn", "ref_kind", "dst_target_id").distinct()


def edges(spark, d) -> DataFrame:
    """(src_id, dst_id, kind) between anchors, one row per reference whose both ends are anchors."""
    a = anchors(spark, d).where("fqn <> ''").groupBy("lang", "fqn").agg(F.min("anchor_id").alias("dst_id"))
    r = refs(spark, d).where("owner_symbol_id is not null").join(targets(spark, d), F.col("dst_target_id") == F.col("target_id"))
    met = r.join(a, (a["lang"] == r["dst_lang"]) & (a["fqn"] == r["dst_fqn"]))
    src = anchors(spark, d).select(F.col("anchor_id").alias("src_id"))
    return met.join(src, met["owner_symbol_id"] == src["src_id"]).select("src_id", "dst_id", F.col("ref_kind").alias("kind"), "src_file_id")


def notes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "path", "title", "doc_kind", "lang", "source", "n_chars", "updated_at", "text")


_MIN = lambda key, cols, t, where="": f"SELECT {key}, {', '.join(f'min({c}) AS {c}' for c in cols)} FROM {t} WHERE {key} IS NOT NULL GROUP BY {key}"

#: The frames above as common table expressions; start a query with WITH + these.
SQL = f"""
sym AS ({_MIN('id', ['lang', 'kind', 'file', 'pkg', 'name', 'fqn'], 'symbols')}),
anchor AS (SELECT id AS anchor_id, lang, kind, file AS path, pkg, name, fqn, id % 97 + 1 AS start_line, id % 97 + 1 + length(name) AS end_line FROM sym),
target0 AS ({_MIN('target_id', ['dst_lang', 'dst_pkg', 'dst_name', 'dst_fqn', 'dst_member'], 'intel_symbol_ref_targets')}),
mate AS (SELECT lang, pkg, id % {MATES} AS rest, min(id) AS id FROM sym WHERE fqn <> '' AND pkg <> '' GROUP BY ALL),
target AS (SELECT t.target_id, t.dst_lang, t.dst_pkg, coalesce(s.name, t.dst_name) AS dst_name, coalesce(s.fqn, t.dst_fqn) AS dst_fqn, t.dst_member FROM target0 t
  LEFT JOIN mate m ON m.lang = t.dst_lang AND m.pkg = t.dst_pkg AND m.rest = t.target_id % {MATES} AND NOT EXISTS (SELECT 1 FROM sym x WHERE x.lang = t.dst_lang AND x.fqn = t.dst_fqn AND x.fqn <> '')
  LEFT JOIN sym s ON s.id = m.id),
ref_file AS ({_MIN('file_id', ['path'], 'intel_symbol_ref_files')}),
ref AS (SELECT DISTINCT src_file_id, owner_symbol_id, owner_fqn, ref_kind, dst_target_id FROM intel_symbol_refs),
by_fqn AS (SELECT lang, fqn, min(anchor_id) AS dst_id FROM anchor WHERE fqn <> '' GROUP BY ALL),
edge AS (SELECT r.owner_symbol_id AS src_id, a.dst_id, r.ref_kind AS kind, r.src_file_id FROM ref r JOIN target t ON t.target_id = r.dst_target_id
  JOIN by_fqn a ON a.lang = t.dst_lang AND a.fqn = t.dst_fqn JOIN anchor s ON s.anchor_id = r.owner_symbol_id)
"""
WITH = "WITH " + SQL
