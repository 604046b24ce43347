"""Analytic reports over code anchors, references and edges.

Inputs are frames: anchors (anchor_id, lang, kind, path, pkg, name, fqn, start_line, end_line), edges (src_id, dst_id, kind),
refs (src_file_id, owner_symbol_id, owner_fqn, ref_kind, dst_target_id), targets (target_id, dst_lang, dst_pkg, dst_name, dst_fqn),
files (file_id, path). Distinct counts aggregate partially before the shuffle; reports with a limit end in one top-k.
A null or empty fqn is no symbol. Missing counts are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A language whose share of resolved calls is below this is ranked by raw references too.
SPARSE = 0.60

zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
_named = lambda: F.col("fqn").isNotNull() & (F.col("fqn") != "")


def language_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("lang").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("path").alias("files"))


def _calls(refs: DataFrame, targets: DataFrame) -> DataFrame:
    return refs.where(F.col("ref_kind") == "calls").join(targets, F.col("dst_target_id") == F.col("target_id"))


def _known(calls: DataFrame, anchors: DataFrame) -> DataFrame:
    """calls with `known`: whether the callee is an indexed symbol."""
    names = anchors.where(_named()).select(F.col("lang").alias("dst_lang"), F.col("fqn").alias("dst_fqn"), F.lit(1).alias("known")).distinct()
    return calls.join(names, ["dst_lang", "dst_fqn"], "left")


def call_resolution(refs: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per language: calls extracted, resolved and not, and the rate."""
    rows = _known(_calls(refs, targets), anchors).groupBy("dst_lang").agg(F.count(F.lit(1)).alias("extracted"), F.sum(zero("known")).alias("resolved"))
    rate = F.when(F.col("extracted") > 0, F.col("resolved") / F.col("extracted")).otherwise(0.0)
    return rows.select(F.col("dst_lang").alias("lang"), "extracted", "resolved", (F.col("extracted") - F.col("resolved")).alias("unresolved"), rate.alias("rate"))


def ref_kinds(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per language: how many references of each kind, in one pass."""
    kind = lambda k: F.sum(F.when(F.col("ref_kind") == k, 1).otherwise(0)).alias(k)
    rows = refs.join(targets, F.col("dst_target_id") == F.col("target_id"))
    return rows.groupBy(F.col("dst_lang").alias("lang")).agg(kind("calls"), kind("type_ref"), kind("member_ref"))


def unresolved_callees(refs: DataFrame, targets: DataFrame, anchors: DataFrame, top: int, exclude: list[str]) -> DataFrame:
    """The most called names without a symbol, per language; excluded names are left out before the cut."""
    rows = _known(_calls(refs, targets), anchors).where(F.col("known").isNull() & ~F.col("dst_name").isin(exclude))
    counted = rows.groupBy(F.col("dst_lang").alias("lang"), F.col("dst_name").alias("name")).agg(F.count(F.lit(1)).alias("calls"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("calls"), "name"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def directory_distribution(symbols: DataFrame, limit: int = 50) -> DataFrame:
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    rows = symbols.groupBy(folder.alias("dir"), "lang").agg(F.countDistinct("path").alias("files"))
    return rows.orderBy(F.desc("files"), "dir", "lang").limit(limit)


def call_rows(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Call edges resolved to both anchors: caller_* and callee_* columns."""
    side = lambda p: anchors.select(*[F.col(c).alias(f"{p}_{c}") for c in ("anchor_id", "lang", "path", "fqn", "pkg")])
    calls = edges.where(F.col("kind") == "calls")
    return calls.join(side("caller"), F.col("src_id") == F.col("caller_anchor_id")).join(side("callee"), F.col("dst_id") == F.col("callee_anchor_id"))


def _sparse(refs, targets, anchors, threshold) -> DataFrame:
    rates = call_resolution(refs, targets, anchors)
    return rates.where((F.col("extracted") > 0) & (F.col("rate") < threshold)).select(F.col("lang").alias("dst_lang"))


def _fallback(refs, targets, anchors, threshold) -> DataFrame:
    return _calls(refs, targets).where(F.coalesce("dst_fqn", F.lit("")) != "").join(_sparse(refs, targets, anchors, threshold), "dst_lang", "left_semi")


def best_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of each key that no other row beats; ties all stay."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def _counted(edges: DataFrame, kind: str, name: str) -> DataFrame:
    return edges.where(F.col("kind") == kind).groupBy(F.col("dst_id").alias("anchor_id")).agg(F.count(F.lit(1)).alias(name))


def doc_coverage(edges, refs, targets, anchors, mention_kind: str, link_kind: str, limit: int | None = 25, threshold: float = SPARSE, path_prefix: str | None = None) -> DataFrame:
    """Symbols by how much they are called, with how often documents mention and link them. Of the resolved count and, in sparse
    languages, the raw count of a symbol the stronger holds."""
    rows = call_rows(edges, anchors).where(F.coalesce("callee_fqn", F.lit("")) != "")
    if path_prefix is not None:
        rows = rows.where(F.col("caller_path").startswith(path_prefix))
    resolved = rows.groupBy(F.col("callee_lang").alias("lang"), F.col("callee_fqn").alias("fqn")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("caller_path").alias("callers"), F.lit(0).alias("fallback")
    )
    raw = _fallback(refs, targets, anchors, threshold).groupBy(F.col("dst_lang").alias("lang"), F.col("dst_fqn").alias("fqn")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("src_file_id").alias("callers"), F.lit(1).alias("fallback")
    )
    usage = best_rows(resolved.unionByName(raw), ["lang", "fqn"], [F.desc("calls"), F.desc("callers"), F.asc("fallback")])
    where = anchors.select("anchor_id", "lang", "fqn", "kind", "path")
    full = usage.join(where, ["lang", "fqn"], "left").join(_counted(edges, mention_kind, "mentions"), "anchor_id", "left").join(_counted(edges, link_kind, "links"), "anchor_id", "left")
    out = full.select(
        "lang", F.coalesce("kind", F.lit("")).alias("kind"), "fqn", F.coalesce("path", F.lit("")).alias("path"), "calls", "callers",
        zero("mentions").alias("mentions"), zero("links").alias("links"), F.col("anchor_id").isNotNull().cast("int").alias("resolved"), "fallback",
    )
    order = [F.desc("calls"), F.desc("resolved"), F.asc("fallback"), F.asc("mentions"), F.asc("fqn"), F.asc("lang"), F.asc("path")]
    return out.orderBy(*order).limit(limit) if limit is not None else out


def complexity(edges, anchors, limit: int | None = 25, min_lines: int = 0) -> DataFrame:
    calls = call_rows(edges, anchors).where((F.coalesce("callee_fqn", F.lit("")) != "") & (F.coalesce("callee_lang", F.lit("")) != ""))
    into = calls.groupBy(F.col("callee_lang").alias("lang"), F.col("callee_fqn").alias("fqn")).agg(F.count(F.lit(1)).alias("calls_in"), F.countDistinct("caller_path").alias("callers"))
    out = calls.where(F.coalesce("caller_fqn", F.lit("")) != "").groupBy(F.col("caller_lang").alias("lang"), F.col("caller_fqn").alias("fqn")).agg(F.count(F.lit(1)).alias("calls_out"), F.countDistinct("callee_fqn").alias("callees"))
    lines = F.when((F.col("end_line") >= F.col("start_line")) & (F.col("start_line") > 0), F.col("end_line") - F.col("start_line") + 1).otherwise(1)
    base = anchors.where(_named() & F.col("kind").isin("function", "method")).withColumn("span_lines", lines).where(F.col("span_lines") >= min_lines)
    full = base.join(into, ["lang", "fqn"], "left").join(out, ["lang", "fqn"], "left")
    full = full.select("lang", "kind", "fqn", "path", "span_lines", *[zero(c).alias(c) for c in ("calls_in", "callers", "calls_out", "callees")])
    score = F.col("span_lines") * (1 + F.col("callers")) * (1 + F.col("callees") / 5.0)
    full = full.withColumn("score", score.cast("double"))
    return full.orderBy(F.desc("score"), F.desc("span_lines"), F.desc("callers"), F.desc("callees"), "path", "fqn", "lang").limit(limit) if limit is not None else full


def package_hotspots(edges, refs, targets, anchors, mention_kind: str, limit: int | None = 25, threshold: float = SPARSE) -> DataFrame:
    calls = call_rows(edges, anchors).where((F.coalesce("callee_fqn", F.lit("")) != "") & (F.coalesce("callee_lang", F.lit("")) != ""))
    rows = calls.select(F.col("callee_lang").alias("lang"), F.coalesce("callee_pkg", F.lit("")).alias("pkg"), F.col("caller_path").alias("file"), F.col("callee_fqn").alias("fqn"), F.col("dst_id").alias("anchor_id"))
    stats = rows.groupBy("lang", "pkg").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("file").alias("callers"), F.countDistinct("fqn").alias("used_symbols"), F.lit(0).alias("fallback"))
    # Several anchors may share (lang, fqn); a symbol is documented if any of them is mentioned.
    shared = anchors.where(_named()).select("lang", "fqn", "anchor_id")
    mentioned = shared.join(_counted(edges, mention_kind, "m").select("anchor_id"), "anchor_id", "left_semi").select("lang", "fqn").distinct().withColumn("documented", F.lit(1))
    docs = rows.select("lang", "pkg", "fqn").distinct().join(mentioned, ["lang", "fqn"]).groupBy("lang", "pkg").agg(F.sum("documented").alias("documented_symbols"))
    raw = _fallback(refs, targets, anchors, threshold).groupBy(F.col("dst_lang").alias("lang"), F.col("dst_pkg").alias("pkg")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("src_file_id").alias("callers"), F.countDistinct("dst_fqn").alias("used_symbols"), F.lit(1).alias("fallback")
    )
    whole = stats.unionByName(raw.join(stats, ["lang", "pkg"], "left_anti"))
    out = whole.join(docs, ["lang", "pkg"], "left").select("lang", "pkg", "calls", "callers", "used_symbols", zero("documented_symbols").alias("documented_symbols"), "fallback")
    return out.orderBy(F.desc("callers"), F.desc("calls"), "fallback", "pkg", "lang").limit(limit) if limit is not None else out


def file_hotspots(edges, refs, targets, files, anchors, limit: int | None = 25, threshold: float = SPARSE) -> DataFrame:
    rows = call_rows(edges, anchors).where((F.coalesce("caller_path", F.lit("")) != "") & (F.coalesce("callee_fqn", F.lit("")) != ""))
    resolved = rows.groupBy(F.col("callee_lang").alias("lang"), F.col("caller_path").alias("file")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct(F.coalesce("callee_pkg", F.lit(""))).alias("deps"), F.countDistinct("callee_fqn").alias("used_symbols"), F.lit(0).alias("fallback")
    )
    raw = _fallback(refs, targets, anchors, threshold).join(files, F.col("src_file_id") == F.col("file_id")).groupBy(F.col("dst_lang").alias("lang"), F.col("path").alias("file")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("dst_pkg").alias("deps"), F.countDistinct("dst_fqn").alias("used_symbols"), F.lit(1).alias("fallback")
    )
    best = best_rows(resolved.unionByName(raw), ["lang", "file"], [F.desc("deps"), F.desc("calls"), F.desc("used_symbols"), F.asc("fallback")])
    return best.orderBy(F.desc("deps"), F.desc("calls"), "fallback", "file", "lang").limit(limit) if limit is not None else best


#: The order in which kinds of remarks ask for attention; other kinds come last.
REMARKS = ["fixme", "todo", "hack", "important"]


def rationale_attention(remarks, edges, anchors, mention_kind: str, link_kind: str, limit: int | None = 25) -> DataFrame:
    """Remarks (rationale_id, path, symbol_fqn, kind, start_line, content) with the largest counts of the anchors whose fqn is
    the remark's symbol or ends with it behind a dot. The suffix match is an equality join on exploded suffixes."""
    calls = call_rows(edges, anchors).groupBy(F.col("dst_id").alias("anchor_id")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("caller_path").alias("callers"))
    stats = anchors.where(_named()).select("anchor_id", "fqn").join(calls, "anchor_id", "left").join(_counted(edges, mention_kind, "mentions"), "anchor_id", "left").join(_counted(edges, link_kind, "links"), "anchor_id", "left")
    steps = F.split("fqn", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "."))).alias("symbol_fqn")
    names = ("calls", "callers", "mentions", "links")
    by_suffix = stats.select(suffix, *[zero(c).alias(c) for c in names]).groupBy("symbol_fqn").agg(*[F.max(c).alias(c) for c in names])
    out = remarks.join(by_suffix, "symbol_fqn", "left").select("path", F.coalesce("symbol_fqn", F.lit("")).alias("symbol_fqn"), "kind", "start_line", "content", *[zero(c).alias(c) for c in names])
    urgency = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REMARKS)), F.col("kind")), F.lit(0)), F.lit(len(REMARKS) + 1))
    return out.orderBy(urgency, F.desc("callers"), F.desc("calls"), "path", "start_line", "content").limit(limit) if limit is not None else out


def doc_stats(anchors, edges, lang: str, fqns: list[str], mention_kind: str, link_kind: str) -> DataFrame:
    rows = anchors.where((F.col("lang") == lang) & F.col("fqn").isin(fqns))
    full = rows.join(_counted(edges, mention_kind, "mentions"), "anchor_id", "left").join(_counted(edges, link_kind, "links"), "anchor_id", "left")
    return full.select("fqn", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("path", F.lit("")).alias("path"), zero("mentions").alias("mentions"), zero("links").alias("links"))


def coupling(edges, anchors, top: int) -> DataFrame:
    """Calls between packages with whether they go both ways, and each pair's most called symbols."""
    rows = call_rows(edges, anchors).where(F.col("caller_pkg") != F.col("callee_pkg"))
    pairs = rows.groupBy("caller_pkg", "callee_pkg").agg(F.count(F.lit(1)).alias("calls"))
    back = pairs.select(F.col("caller_pkg").alias("callee_pkg"), F.col("callee_pkg").alias("caller_pkg"), F.lit(True).alias("both_ways"))
    symbols = rows.groupBy("caller_pkg", "callee_pkg", "callee_fqn").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("caller_pkg", "callee_pkg").orderBy(F.desc("n"), "callee_fqn"))
    tops = symbols.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("caller_pkg", "callee_pkg").agg(F.array_sort(F.collect_list(F.struct("rank", "callee_fqn"))).alias("t"))
    full = pairs.join(back, ["caller_pkg", "callee_pkg"], "left").join(tops, ["caller_pkg", "callee_pkg"], "left")
    return full.select("caller_pkg", "callee_pkg", "calls", F.coalesce("both_ways", F.lit(False)).alias("both_ways"), F.array_join(F.transform("t", lambda x: x["callee_fqn"]), ",").alias("top_symbols"))
