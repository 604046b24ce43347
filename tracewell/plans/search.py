"""Retrieval queries: lexical and vector search, lanes over notes and symbols, fusion, quality measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.functions import text as T
from tracewell.functions.stem import stemmed
from tracewell.operators import ranking as K
from tracewell.operators import reports as R
from tracewell.operators import search as Q
from tracewell.plans.frames import WITH, anchors, edges, notes, refs, ref_files, targets
from tracewell.plans.graphs import _NOTE, _PKG, _SEED, note_links, packages, roots
from tracewell.plans.notes import _P
from tracewell.plans.reports import _CALLS
from tracewell.runtime import table, written

WORDS = Q.query_words("search quality of the offline sync index")
COLUMNS = {"title": 2.5, "text": 0.15}
#: The stated set of queries of a search: every row whose id is divisible by this.
EVERY = 20


def _bm25(spark, d):
    return Q.bm25(notes(spark, d), "doc_id", COLUMNS, WORDS)


def search_bm25(spark, d):
    return _bm25(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def search_bm25_top(spark, d):
    return _bm25(spark, d).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def search_stemmed_words(spark, d):
    w = notes(spark, d).select(F.explode(T.tokens(F.col("title"))).alias("word")).distinct()
    return w.select("word", stemmed(F.col("word")).alias("stem"))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _near(spark, d, k):
    v = _vectors(spark, d)
    return Q.nearest_of(v, v.where(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", k)


def search_vector_top(spark, d):
    return _near(spark, d, 10).select("query", "vec_id", F.round("score", 6).alias("score"))


def search_seed_vectors(spark, d):
    """What is near to any seed but no seed: the best score of each."""
    near = _near(spark, d, 30).where(F.col("vec_id") % EVERY != 0)
    return near.groupBy("vec_id").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("seeds"))


def search_survey_by_type(spark, d):
    """Of each query's nearest the best two of each label."""
    n = _near(spark, d, 200).join(_vectors(spark, d).select("vec_id", "label"), "vec_id").withColumn("score", F.round("score", 6))
    return K.top_per_group(n, ["query", "label"], [F.desc("score"), F.asc("vec_id")], 2).select("query", "label", "vec_id", "score", "rank")


def search_diversified(spark, d):
    c = table(spark, d, "intel_chunks_new").where("owner_row_id is not null and ord is not null").groupBy("chunk_id").agg(F.max_by(F.struct("owner_row_id", "heading", "ord"), F.struct("updated_at", "id")).alias("c")).select("chunk_id", "c.*")
    hits = c.join(_bm25(spark, d).withColumnRenamed("doc_id", "owner_row_id"), "owner_row_id")
    top = hits.orderBy(F.desc(F.round("score", 6)), "owner_row_id", "ord", "chunk_id").limit(300)
    placed = top.select("chunk_id", F.col("owner_row_id").alias("owner"), F.coalesce("heading", F.lit("")).alias("heading"), F.col("ord").cast("long").alias("ord"), F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "owner_row_id", "ord", "chunk_id")).cast("long").alias("place"))
    return Q.diversified(placed, 100)


# ---- lanes


def lane_lexical(spark, d, best=None):
    best = (best or _bm25(spark, d)).join(notes(spark, d).select("doc_id", "path"), "doc_id")
    return Q.evidence(best, "path", "path", "intel_fts_match", "lexical", S.similarity_of_bm25(-F.col("score")))


def lane_title(spark, d):
    groups = [[w] for w in WORDS]
    n = notes(spark, d).withColumn("c", T.coverage(T.tokens(F.col("title")), groups)).where("c > 0")
    return Q.evidence(n, "path", "path", "note_title_match", "lexical", F.col("c"))


def lane_link_text(spark, d, links_of=None):
    """Notes by the labels others link them with: what is written on the link counts in full, a link to a hub less; noisy-or over
    the linking notes, each counted once."""
    n = notes(spark, d)
    links = n.where(F.contains("text", F.lit("[["))).select(F.col("path").alias("src"), F.explode(T.wikilinks(F.col("text"))).alias("l")).select("src", F.lower("l.target").alias("target"), F.lower(F.concat_ws(" ", "l.target", "l.alias", "l.heading")).alias("label")).distinct()
    titles = n.where("title is not null").groupBy(F.lower("title").alias("target")).agg(F.min("path").alias("dst"))
    met = links.join(titles, "target").where("src <> dst").withColumn("c", T.coverage(T.tokens(F.col("label")), [[w] for w in WORDS])).where("c > 0")
    out_count = (links_of or note_links(spark, d)).groupBy("src").agg(F.countDistinct("dst").alias("targets"))
    met = met.groupBy("src", "dst").agg(F.max("c").alias("c")).join(out_count, "src").withColumn("c", F.col("c") * F.least(F.lit(1.0), F.lit(20.0) / F.col("targets")))
    return Q.evidence(K.noisy_or(met, ["dst"], F.col("c")), "dst", "dst", "link_text_match", "lexical", F.col("score"))


def lane_graph(spark, d, best=None, links_of=None):
    """Notes the best lexical hits link to."""
    seeds = (best or _bm25(spark, d)).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(8).join(notes(spark, d).select("doc_id", "path"), "doc_id")
    out = (links_of or note_links(spark, d)).join(seeds.select(F.col("path").alias("src")), "src").select("dst").distinct()
    return Q.evidence(out, "dst", "dst", "direct_link_out", "graph", F.lit(0.6))


def _asked(spark, d):
    """The query's vector: that of the first row, as no model is at hand."""
    first = _vectors(spark, d).orderBy("vec_id").limit(1).collect()
    return {int(first[0]["vec_id"]): [float(x) for x in first[0]["embedding"]]} if first and first[0]["embedding"] and first[0]["vec_id"] is not None else {}


def lane_vector(spark, d, limit: int = 25):
    """Notes by the likeness of their vectors to the query's, the best 25 as a search asks for; a vector is a chunk of the note with
    its id, and the chunk is the handle."""
    near = Q.nearest(_vectors(spark, d), "vec_id", "embedding", _asked(spark, d), limit).withColumn("score", F.round("score", 6))
    met = near.join(notes(spark, d).select(F.col("doc_id").alias("vec_id"), "path"), "vec_id").withColumn("handle", F.concat("path", F.lit("#"), F.col("vec_id").cast("string")))
    return Q.evidence(met, "handle", "path", "note_vector_similarity", "semantic", F.col("score"), F.lit("chunk"))


def search_vector_lane(spark, d):
    return lane_vector(spark, d).select("handle", "owner", "type", "channel", "score")


def search_coalesced(spark, d):
    """The vector and title lanes, a note's handles made one before ranking."""
    both = Q.merged([lane_vector(spark, d), lane_title(spark, d)]).withColumn("whole_note", F.lit(True))
    scores = K.channel_scores(K.coalesced(both))
    return scores.select("handle", "owner", "channel", F.round("score", 6).alias("score"))


def search_bm25_filtered(spark, d):
    """Ranked with the filters inside the query: kinds, a path prefix, no tests. The statistics are those of all notes."""
    fits = notes(spark, d).where(F.col("doc_kind").isin("note", "meeting", "runbook", "decision") & F.lower("path").rlike("^[a-m]") & ~S.is_test_path(F.col("path")))
    return _bm25(spark, d).join(fits.select("doc_id", "path"), "doc_id").select("path", F.round("score", 6).alias("score"))


def sort_packed_plans(spark, d):
    """What of the best 50 notes goes into a budget of characters."""
    top = _bm25(spark, d).join(notes(spark, d).select("doc_id", "n_chars"), "doc_id").orderBy(F.desc(F.round("score", 6)), "doc_id").limit(50)
    plans = [{"id": r["doc_id"], "size": int(r["n_chars"] or 0), "utility": round(r["score"], 6)} for r in top.collect()]
    return spark.createDataFrame([(i, p["id"], p["size"]) for i, p in enumerate(K.packed_plans(plans, 20_000))], "place int, doc_id long, size long")


def sort_opened_tree(spark, d):
    """The folders of code opened first for a tree of 40 lines: a folder counts its symbols; folders are few, and the best 5,000 are read."""
    steps = F.split("path", "/")
    folder = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("folder")
    counted = anchors(spark, d).where("path like '%/%'").select(folder).groupBy("folder").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(5_000)
    scores = {r["folder"]: float(r["n"]) for r in counted.collect()}
    return spark.createDataFrame(list(enumerate(K.opened_tree(scores, 40))), "place int, folder string")


def lane_recency(spark, d):
    n = notes(spark, d).where(F.col("updated_at") >= F.lit("2026-09-01").cast("timestamp"))
    return Q.evidence(n, "path", "path", "query_specificity", "specificity", F.lit(0.3))


def _evidence(spark, d):
    """All lanes; what several of them read is made once. Read twice by what follows, so written."""
    best, links = written(_bm25(spark, d)).df, written(note_links(spark, d)).df
    lanes = [lane_lexical(spark, d, best), lane_title(spark, d), lane_link_text(spark, d, links), lane_graph(spark, d, best, links), lane_recency(spark, d)]
    return written(Q.merged(lanes)).df


def search_link_text(spark, d):
    return lane_link_text(spark, d).select("handle", F.round("score", 6).alias("score"))


def search_evidence(spark, d):
    """All lanes' evidence, bounded per handle."""
    return K.bounded(_evidence(spark, d)).select("handle", "type", "channel", F.round("score", 6).alias("score"), "in_type", "in_all")


def search_channels(spark, d):
    return K.channel_scores(K.bounded(_evidence(spark, d))).select("handle", "channel", F.round("score", 6).alias("score"))


def search_ranked(spark, d):
    out = K.ranked(K.bounded(_evidence(spark, d)), K.weights("search", seeds=False), 1, 25)
    return out.select("handle", "owner", "tier", F.round("score", 6).alias("score"))


def search_intents(spark, d):
    """The same evidence under several intents: one pass over it, weights as a small joined table."""
    rows = [(i, c, float(w)) for i in ("search", "overview", "go_to_def", "docs_for_code") for c, w in K.weights(i).items()]
    w = spark.createDataFrame(rows, "intent string, channel string, weight double")
    total = K.channel_scores(K.bounded(_evidence(spark, d))).join(F.broadcast(w), "channel").groupBy("intent", "handle").agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("score"))
    return K.top_per_group(total, ["intent"], [F.desc("score"), F.asc("handle")], 5)


def search_many_queries(spark, d):
    """Several queries at once, merged by handle with the best score of each."""
    parts = []
    for i, text in enumerate(("offline sync tag", "schema drift edge", "budget cycle")):
        parts.append(Q.bm25(notes(spark, d), "doc_id", COLUMNS, Q.query_words(text)).withColumn("query", F.lit(i)))
    both = Q.merged(parts)
    return both.groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"), F.countDistinct("query").alias("queries"))


def search_reranked(spark, d):
    r = K.ranked(K.bounded(_evidence(spark, d)), K.weights("search"), 1, 60).withColumn("place", F.row_number().over(Window.orderBy(F.desc("tier"), F.desc(F.round("score", 6)), "handle")))
    r = r.select("handle", "place", F.round("score", 6).alias("score"), (F.col("place") % 7 == 0).alias("pinned"))
    second = r.select("handle", (F.conv(F.substring(F.md5("handle"), 1, 4), 16, 10).cast("double") / 65535).alias("second"))
    return Q.reranked(r, second).select("handle", "place", F.round("score", 6).alias("score"), "pinned")


def search_call_edges(spark, d):
    """Callers and callees of given symbols, interleaved by seed, at most so many per caller and per name."""
    c = R.call_rows(edges(spark, d), anchors(spark, d)).join(F.broadcast(roots(spark, d)), F.col("callee_pkg") == F.col("root"), "left_semi").select("caller_fqn", "callee_fqn", "callee_pkg", "caller_path").distinct()
    two = K.capped_twice(c, "callee_fqn", "caller_path", [F.asc("callee_fqn"), F.asc("caller_fqn"), F.asc("caller_path")], 5, 3)
    return K.interleaved(two, "callee_pkg", "callee_pkg", [F.asc("callee_fqn"), F.asc("caller_fqn"), F.asc("caller_path")], 60).select("caller_fqn", "callee_fqn", "turn")


def search_anchor_graph(spark, d):
    """Around each symbol: callees .8, super- and subtypes .6, the best score of each pair, 50 per symbol."""
    c = R.call_rows(edges(spark, d), anchors(spark, d)).select(F.col("caller_fqn").alias("seed"), F.col("callee_fqn").alias("hit"), F.lit(0.8).alias("score"))
    s = table(spark, d, "super_edges").where("child_fqn is not null and parent_fqn is not null").select(F.col("child_fqn").alias("seed"), F.col("parent_fqn").alias("hit"), F.lit(0.6).alias("score"))
    both = Q.merged([c, s, s.select(F.col("hit").alias("seed"), F.col("seed").alias("hit"), "score")]).where("seed <> hit").groupBy("seed", "hit").agg(F.max("score").alias("score"))
    return K.top_per_group(both, ["seed"], [F.desc("score"), F.asc("hit")], 50)


def search_definitions(spark, d):
    """What a written name means: by fqn, else by symbol name; the first kind that has hits."""
    asked = targets(spark, d).select(F.col("dst_fqn").alias("asked"), F.col("dst_name").alias("name")).where("asked is not null").distinct()
    a = anchors(spark, d).where("fqn <> ''")
    by_fqn = asked.join(a.select("fqn", "anchor_id"), asked["asked"] == F.col("fqn")).select("asked", "anchor_id", F.lit(1).alias("kind"))
    by_name = asked.join(a.select(F.col("name").alias("n"), "anchor_id"), asked["name"] == F.col("n")).select("asked", "anchor_id", F.lit(2).alias("kind"))
    return R.best_rows(by_fqn.unionByName(by_name), ["asked"], [F.asc("kind")]).groupBy("asked", "kind").agg(F.count(F.lit(1)).alias("hits"), F.min("anchor_id").alias("first"))


def search_external(spark, d):
    """Targets by language and package prefix: resolved, ambiguous or not found, with uses."""
    t = targets(spark, d).where("dst_pkg like 'tools.%'").select("target_id", "dst_lang", "dst_fqn")
    a = anchors(spark, d).where("fqn <> ''").groupBy(F.col("lang").alias("dst_lang"), F.col("fqn").alias("dst_fqn")).agg(F.count(F.lit(1)).alias("n"))
    uses = refs(spark, d).groupBy(F.col("dst_target_id").alias("target_id")).agg(F.count(F.lit(1)).alias("uses"))
    rows = t.join(a, ["dst_lang", "dst_fqn"], "left").join(uses, "target_id", "left")
    state = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return rows.select("target_id", "dst_fqn", state.alias("state"), F.coalesce("uses", F.lit(0)).alias("uses"))


def search_rolled_up(spark, d):
    """Symbol hits as one module hit where a file has many: the best score of the file, a little more per symbol."""
    a = anchors(spark, d).withColumn("c", T.match_score(F.col("name"), ["hash", "rank", "load", "note"])).where("c > 0")
    g = a.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.max("c").alias("best")).where("symbols >= 3")
    return g.select("path", "symbols", F.round(F.least(F.lit(1.0), F.col("best") + 0.05 * (F.col("symbols") - 1)), 6).alias("score"))


def search_blended(spark, d):
    """Near vectors blended with shared neighbours: labels stand for tags, ids close by for links."""
    labels = _vectors(spark, d).select("vec_id", "label")
    q = _near(spark, d, 50).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    graph = F.when(F.abs(F.col("vec_id") - F.col("query")) <= 5, 0.3).otherwise(0.0) + F.when(F.col("label") == F.col("own"), 0.1).otherwise(0.0)
    return q.select("query", "vec_id", F.round(0.7 * F.col("score") + 0.3 * graph, 6).alias("score"))


def search_locality(spark, d):
    a = anchors(spark, d).where("path is not null").select("path").distinct()
    near = S.proximity(F.col("path"), ["apps/anchor/deterministic_1334.ts"])
    factor = F.when(~S.is_test_path(F.col("path")) & (near > 0), 1.10 + 0.06 * near).otherwise(1.0)
    return a.select("path", F.round(factor, 6).alias("factor"))


# ---- windows and measures


def win_top_per_group(spark, d):
    return K.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def win_section_ordinals(spark, d):
    c = table(spark, d, "intel_chunks_new").groupBy("chunk_id").agg(F.max_by(F.struct("owner_row_id", "start_byte"), F.struct("updated_at", "id")).alias("c")).select("chunk_id", "c.*").where("owner_row_id is not null")
    return c.withColumn("ord", F.row_number().over(Window.partitionBy("owner_row_id").orderBy("start_byte", "chunk_id")))


def win_keyed_extremes(spark, d):
    """Per customer the best status by a fixed order, beside all its orders."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey")
    return o.select("o_orderkey", F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).over(w).alias("best_f"), F.count(F.lit(1)).over(w).alias("n"))


def agg_nearest_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    r = K.nearest_rank(o, ["o_orderpriority"], "o_totalprice", [0.5, 0.75, 0.9, 0.95, 0.99])
    return r.withColumn("mean", F.round("mean", 4))


def agg_equal_buckets(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_acctbal").alias("v"), F.col("c_name").alias("name"))
    return K.equal_buckets(c, ["c_nationkey"], "v", "name")


def agg_noisy_or(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("s"))
    return K.noisy_or(l, ["l_partkey"], F.col("s")).select("l_partkey", F.round("score", 6).alias("score"))


def agg_consensus_labels(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_orderpriority").alias("label"))
    return K.consensus_labels(o)


def agg_quality(spark, d):
    """nDCG, recall and precision of the lexical ranking, judged by kind and language of the notes."""
    n = notes(spark, d)
    r = _bm25(spark, d).join(n.select("doc_id", "doc_kind"), "doc_id").where("doc_kind is not null").withColumn("score", F.round("score", 6))
    ranks = K.top_per_group(r, ["doc_kind"], [F.desc("score"), F.asc("doc_id")], 10).select(F.col("doc_kind").alias("query"), F.col("doc_id").alias("doc"), "rank")
    judged = n.where("doc_kind is not null").select(F.col("doc_kind").alias("query"), F.col("doc_id").alias("doc"), (F.col("doc_id") % 4).cast("int").alias("grade"))
    q = K.ndcg(ranks, judged, 10)
    return q.select("query", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def agg_community_tags(spark, d):
    from tracewell.plans.notes import parsed

    t = parsed(spark, d).where("doc_kind is not null").select("doc_kind", F.explode("tags").alias("tag")).groupBy("doc_kind", "tag").agg(F.count(F.lit(1)).alias("n"))
    return K.top_per_group(t, ["doc_kind"], [F.desc("n"), F.asc("tag")], 5)


def agg_latency(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    return K.nearest_rank(e, ["event_type"], "value", [0.5, 0.95]).select("event_type", "p50", "p95", "max")


def sort_recent(spark, d):
    return notes(spark, d).select("path", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "path").limit(20)


def sort_mixed_values(spark, d):
    """Mixed values: empty, then numbers, then dates, then text, each in its order."""
    v = table(spark, d, "agent_messages").select("created_at").distinct()
    t = F.trim("created_at")
    num, day = t.try_cast("double"), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    kind = F.when(F.coalesce(t, F.lit("")) == "", 0).when(num.isNotNull(), 1).when(day.isNotNull(), 2).otherwise(3)
    return v.select("created_at", kind.alias("kind")).orderBy("kind", num, day, t, "created_at")


def sort_finder(spark, d):
    rows = notes(spark, d).select(F.when(T.tokens(F.col("title"))[0] == "search", 2).otherwise(1).alias("tier"), (F.length("title") % 10).alias("score"), (F.col("doc_kind") == "note").alias("is_note"), (F.col("doc_id") % 30).alias("uses"), "title", "path").where("title is not null")
    return K.finder_order(rows.fillna(False, ["is_note"])).limit(40).select("path", "tier", "total")


def sort_canonical_sources(spark, d):
    """One result per source: the first by path."""
    return K.top_per_group(notes(spark, d).select("source", "path").where("source is not null"), ["source"], [F.asc("path")], 1)


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("search", "win", "agg", "sort") and callable(f)}

_tok = lambda c: f"list_transform(list_filter(string_split(regexp_replace(regexp_replace(coalesce({c}, ''), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda t: strlen(t) >= 2), lambda t: lower(t))"


def _bm25_sql(words, name="bm"):
    cnt = lambda c, w: f"len(list_filter({c}, lambda t: t = '{w}'))"
    f = ", ".join(f"2.5 * {cnt('a', w)} + 0.15 * {cnt('b', w)} AS f{i}" for i, w in enumerate(words))
    st = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(words)))
    s = " + ".join(f"greatest(ln((s.n - d{i} + 0.5) / (d{i} + 0.5)), 0.000001) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / s.av))" for i in range(len(words)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"{name}_t AS MATERIALIZED (SELECT doc_id, {_tok('title')} AS a, {_tok('text')} AS b FROM documents), {name}_f AS MATERIALIZED (SELECT doc_id, len(a) + len(b) AS size, {f} FROM {name}_t), {name}_s AS (SELECT count(*) AS n, avg(size) AS av, {st} FROM {name}_f), {name} AS MATERIALIZED (SELECT doc_id, {s} AS score FROM {name}_f, {name}_s s WHERE {hit})"


_BM = "WITH " + _bm25_sql(WORDS)
_cov = lambda x: "(" + " + ".join(f"list_contains({x}, '{w}')::INT" for w in WORDS) + f") / {float(len(WORDS))}"
_VEC = f"WITH q AS (SELECT vec_id AS query, label AS own, embedding AS e FROM embeddings WHERE vec_id % {EVERY} = 0), sim AS (SELECT query, own, vec_id, label, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM q, embeddings), nr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS k FROM sim)"
_EV = _NOTE + ", " + _bm25_sql(WORDS) + f""",
sd AS (SELECT path FROM bm JOIN documents USING (doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 8),
lk AS (SELECT DISTINCT path AS src, l FROM ({_NOTE.split('FROM (SELECT path, l FROM (')[1].split(') x JOIN')[0]}) x JOIN documents USING (doc_id)),
lp AS (SELECT src, regexp_extract(l, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1) AS t FROM lk), lq AS (SELECT src, regexp_extract(t, '^([^|]*)', 1) AS spot, trim(regexp_extract(t, '\\|(.*)$', 1)) AS alias FROM lp),
lr AS (SELECT src, trim(regexp_extract(spot, '^([^#]*)', 1)) AS tg, alias, CASE WHEN regexp_extract(spot, '#(.*)$', 1) LIKE '^%' THEN '' ELSE trim(regexp_extract(spot, '#(.*)$', 1)) END AS hd FROM lq),
lt AS (SELECT src, dst, max(c) AS c FROM (SELECT src, dst, {_cov('toks')} AS c FROM (SELECT DISTINCT src, dst, {_tok("lower(tg || ' ' || alias || ' ' || hd)")} AS toks FROM lr JOIN ti ON ti.target = lower(tg) WHERE src <> dst)) WHERE c > 0 GROUP BY 1, 2),
oc AS (SELECT src, count(DISTINCT dst) AS n FROM nl GROUP BY 1), lx AS (SELECT dst, 1 - exp(sum(ln(1 - 0.5 * c * least(1.0, 20.0 / n)))) AS s FROM lt JOIN oc USING (src) GROUP BY 1),
ev AS MATERIALIZED (SELECT path AS handle, 'intel_fts_match' AS type, 'lexical' AS channel, 1 / (1 + exp(-score / 2)) AS score FROM bm JOIN documents USING (doc_id)
  UNION ALL SELECT path, 'note_title_match', 'lexical', c FROM (SELECT path, {_cov(_tok('title'))} AS c FROM documents) WHERE c > 0 UNION ALL SELECT dst, 'link_text_match', 'lexical', s FROM lx
  UNION ALL SELECT DISTINCT dst, 'direct_link_out', 'graph', 0.6 FROM nl WHERE src IN (SELECT path FROM sd) UNION ALL SELECT path, 'query_specificity', 'specificity', 0.3 FROM documents WHERE updated_at >= TIMESTAMP '2026-09-01'),
ch AS MATERIALIZED (SELECT handle, channel, least(sum(score * pow(0.55, k - 1)), 1.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY handle, channel ORDER BY score DESC, type) AS k FROM ev WHERE score > 0) GROUP BY 1, 2)"""
_weight = lambda intent, **kw: "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in K.weights(intent, **kw).items()) + " ELSE 0 END"
_chunk = "SELECT * FROM intel_chunks_new QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) = 1"
_MANY = [Q.query_words(t) for t in ("offline sync tag", "schema drift edge", "budget cycle")]

_TEST = r"(regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(lower(path), '(_test\.go|(^|/)test_[^/]*\.py|_test\.py|\.(test|spec)\.[jt]sx?|tests?\.cs|test\.php)$'))"
_LANE = """asked AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), near AS (SELECT vec_id, list_cosine_similarity(v.embedding::DOUBLE[], asked.e::DOUBLE[]) AS s FROM embeddings v, asked QUALIFY row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) <= 25),
vl AS (SELECT path || '#' || vec_id AS handle, path AS owner, least(greatest(round(s, 6), 0), 1) AS score FROM near JOIN documents ON doc_id = vec_id)"""

SQL = {
    "search_vector_lane": f"WITH {_LANE} SELECT handle, owner, 'note_vector_similarity' AS type, 'semantic' AS channel, score FROM vl",
    "search_coalesced": f"WITH {_LANE}, tl AS (SELECT path AS owner, c FROM (SELECT path, {_cov(_tok('title'))} AS c FROM documents) WHERE c > 0) SELECT coalesce(handle, owner) AS handle, owner, 'lexical' AS channel, round(c, 6) AS score FROM tl LEFT JOIN vl USING (owner) UNION ALL SELECT handle, owner, 'semantic', score FROM vl WHERE score > 0",
    "search_bm25_filtered": _BM + f" SELECT path, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE doc_kind IN ('note', 'meeting', 'runbook', 'decision') AND regexp_matches(lower(path), '^[a-m]') AND NOT {_TEST}",
    "search_bm25": _BM + " SELECT doc_id, round(score, 6) AS score FROM bm",
    "search_bm25_top": _BM + " SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 20",
    "search_vector_top": _VEC + " SELECT query, vec_id, round(s, 6) AS score FROM nr WHERE k <= 10",
    "search_seed_vectors": _VEC + f" SELECT vec_id, round(max(s), 6) AS score, count(*) AS seeds FROM nr WHERE k <= 30 AND vec_id % {EVERY} <> 0 GROUP BY 1",
    "search_survey_by_type": _VEC + " SELECT * FROM (SELECT query, label, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query, label ORDER BY round(s, 6) DESC, vec_id) AS rank FROM nr WHERE k <= 200) WHERE rank <= 2",
    "search_link_text": _EV + " SELECT dst AS handle, round(s, 6) AS score FROM lx",
    "search_evidence": _EV + " SELECT handle, type, channel, round(score, 6) AS score, 1 AS in_type, row_number() OVER (PARTITION BY handle ORDER BY score DESC, type) AS in_all FROM ev",
    "search_channels": _EV + " SELECT handle, channel, round(score, 6) AS score FROM ch",
    "search_ranked": _EV + f" SELECT handle, handle AS owner, 0 AS tier, round(sum(score * {_weight('search', seeds=False)}), 6) AS score FROM ch GROUP BY 1 ORDER BY round(sum(score * {_weight('search', seeds=False)}), 9) DESC, handle LIMIT 25",
    "search_intents": _EV + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score DESC, handle) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS intent, handle, round(sum(score * {_weight(i)}), 6) AS score FROM ch GROUP BY 2" for i in ("search", "overview", "go_to_def", "docs_for_code")) + ")) WHERE rank <= 5",
    "search_many_queries": "WITH " + ", ".join(_bm25_sql(w, f"q{i}") for i, w in enumerate(_MANY)) + " SELECT doc_id, round(max(score), 6) AS score, count(DISTINCT query) AS queries FROM (" + " UNION ALL ".join(f"SELECT *, {i} AS query FROM q{i}" for i in range(3)) + ") GROUP BY 1",
    "search_call_edges": _PKG + _SEED + """, c AS (SELECT DISTINCT caller_fqn, callee_fqn, callee_pkg, caller_path FROM call WHERE callee_pkg IN (SELECT node FROM sd WHERE k <= 2)), a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY callee_fqn ORDER BY callee_fqn, caller_fqn, caller_path NULLS FIRST) <= 5),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY caller_path ORDER BY callee_fqn, caller_fqn, caller_path NULLS FIRST) <= 3) SELECT caller_fqn, callee_fqn, turn FROM (SELECT *, row_number() OVER (PARTITION BY callee_pkg ORDER BY callee_fqn, caller_fqn, caller_path NULLS FIRST) AS turn FROM b) ORDER BY turn, callee_pkg, callee_fqn, caller_fqn, caller_path LIMIT 60""",
    "search_anchor_graph": _CALLS + """, s AS (SELECT child_fqn AS a, parent_fqn AS b FROM super_edges WHERE child_fqn IS NOT NULL AND parent_fqn IS NOT NULL),
u AS (SELECT caller_fqn AS seed, callee_fqn AS hit, 0.8 AS score FROM call UNION ALL SELECT a, b, 0.6 FROM s UNION ALL SELECT b, a, 0.6 FROM s) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, hit) AS rank FROM (SELECT seed, hit, max(score) AS score FROM u WHERE seed <> hit GROUP BY 1, 2)) WHERE rank <= 50""",
    "search_definitions": WITH + """, q AS (SELECT DISTINCT dst_fqn AS asked, dst_name AS name FROM target WHERE dst_fqn IS NOT NULL), m AS (SELECT asked, anchor_id, 1 AS kind FROM q JOIN anchor ON fqn = asked WHERE fqn <> '' UNION ALL SELECT asked, anchor_id, 2 FROM q JOIN anchor USING (name) WHERE fqn <> '')
SELECT asked, kind, count(*) AS hits, min(anchor_id) AS first FROM m x WHERE kind = (SELECT min(kind) FROM m y WHERE y.asked = x.asked) GROUP BY 1, 2""",
    "search_external": WITH + """, a AS (SELECT lang, fqn, count(*) AS n FROM anchor WHERE fqn <> '' GROUP BY 1, 2) SELECT t.target_id, t.dst_fqn, CASE WHEN a.n IS NULL THEN 'not_found' WHEN a.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, (SELECT count(*) FROM ref r WHERE r.dst_target_id = t.target_id) AS uses
FROM target t LEFT JOIN a ON a.lang = t.dst_lang AND a.fqn = t.dst_fqn WHERE t.dst_pkg LIKE 'tools.%'""",
    "search_rolled_up": WITH + ", s AS (SELECT path, (contains(lower(name), 'hash')::INT + contains(lower(name), 'rank')::INT + contains(lower(name), 'load')::INT + contains(lower(name), 'note')::INT) / 4.0 AS c FROM anchor) SELECT path, count(*) AS symbols, round(least(1.0, max(c) + 0.05 * (count(*) - 1)), 6) AS score FROM s WHERE c > 0 GROUP BY 1 HAVING count(*) >= 3",
    "search_blended": _VEC + " SELECT query, vec_id, round(0.7 * s + 0.3 * (CASE WHEN abs(vec_id - query) <= 5 THEN 0.3 ELSE 0 END + CASE WHEN label = own THEN 0.1 ELSE 0 END), 6) AS score FROM nr WHERE k <= 50",
    "win_top_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "win_section_ordinals": f"SELECT chunk_id, owner_row_id, start_byte, row_number() OVER (PARTITION BY owner_row_id ORDER BY start_byte NULLS FIRST, chunk_id) AS ord FROM ({_chunk}) WHERE owner_row_id IS NOT NULL",
    "win_keyed_extremes": "SELECT o_orderkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER w AS best_f, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "agg_nearest_rank": "WITH o AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice IS NOT NULL) SELECT o_orderpriority, count(*) AS n, round(avg(v), 4) AS mean, " + ", ".join(f"max(CASE WHEN k = greatest(ceil(round({q} * n, 6)), 1) THEN v END) AS p{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + ", max(v) AS max FROM o GROUP BY 1",
    "agg_equal_buckets": "WITH c AS (SELECT c_nationkey, c_acctbal AS v, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), b AS (SELECT *, floor((k - 1) / ceil(n / least(greatest(ceil(sqrt(n)), 5), 10, n)))::BIGINT AS bucket FROM c) SELECT c_nationkey, bucket, min(v) AS low, max(v) AS high, count(*) AS n, arg_min(name, k) AS example FROM b GROUP BY 1, 2",
    "agg_noisy_or": "SELECT l_partkey, round(1 - product(1 - 0.5 * least(s, 1.0)), 6) AS score FROM (SELECT l_partkey, l_suppkey, max(l_discount) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "agg_consensus_labels": "SELECT * FROM (SELECT o_custkey AS dst, o_orderpriority AS label, count(DISTINCT o_orderkey) AS notes FROM orders WHERE o_orderpriority <> '' GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) >= 2) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY notes DESC, label) = 1",
    "agg_quality": _BM + """, rk AS (SELECT doc_kind AS query, doc_id AS doc, row_number() OVER (PARTITION BY doc_kind ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id) WHERE doc_kind IS NOT NULL),
jd AS (SELECT doc_kind AS query, doc_id AS doc, doc_id % 4 AS grade FROM documents WHERE doc_kind IS NOT NULL), idl AS (SELECT query, sum((pow(2, grade) - 1) / log2(k + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS k FROM jd WHERE grade > 0) WHERE k <= 10 GROUP BY 1),
rl AS (SELECT query, count(*) AS n FROM jd WHERE grade > 0 GROUP BY 1), ht AS (SELECT query, sum((pow(2, grade) - 1) / log2(rank + 1)) AS g, count(*) FILTER (grade > 0) AS h FROM rk JOIN jd USING (query, doc) WHERE rank <= 10 GROUP BY 1)
SELECT query, round(coalesce(g / i, 0), 6) AS ndcg, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(h, 0) / 10.0, 6) AS precision FROM idl JOIN rl USING (query) LEFT JOIN ht USING (query)""",
    "agg_community_tags": _P + "SELECT * FROM (SELECT doc_kind, tag, count(*) AS n, row_number() OVER (PARTITION BY doc_kind ORDER BY count(*) DESC, tag) AS rank FROM (SELECT doc_id, doc_kind, unnest(list_distinct(tags)) AS tag FROM n WHERE doc_kind IS NOT NULL) GROUP BY 1, 2) WHERE rank <= 5",
    "agg_latency": "WITH o AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(CASE WHEN k = greatest(ceil(round(0.5 * n, 6)), 1) THEN v END) AS p50, max(CASE WHEN k = greatest(ceil(round(0.95 * n, 6)), 1) THEN v END) AS p95, max(v) AS max FROM o GROUP BY 1",
    "sort_recent": "SELECT path, updated_at FROM documents ORDER BY updated_at DESC NULLS LAST, path LIMIT 20",
    "sort_mixed_values": r"SELECT created_at, kind FROM (SELECT DISTINCT created_at, trim(created_at) AS t, CASE WHEN coalesce(trim(created_at), '') = '' THEN 0 WHEN TRY_CAST(trim(created_at) AS DOUBLE) IS NOT NULL THEN 1 WHEN regexp_matches(trim(created_at), '^\d{4}-\d{2}-\d{2}$') THEN 2 ELSE 3 END AS kind FROM agent_messages) ORDER BY kind, TRY_CAST(t AS DOUBLE) NULLS FIRST, CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN t END NULLS FIRST, t NULLS FIRST, created_at NULLS FIRST",
    "sort_finder": f"SELECT path, tier, total FROM (SELECT path, title, CASE WHEN {_tok('title')}[1] = 'search' THEN 2 ELSE 1 END AS tier, length(title) % 10 + CASE WHEN doc_kind = 'note' THEN 8 ELSE 0 END + least(doc_id % 30, 12) AS total FROM documents WHERE title IS NOT NULL) ORDER BY tier DESC, total DESC, length(title), path LIMIT 40",
    "sort_canonical_sources": "SELECT source, min(path) AS path, 1 AS rank FROM documents WHERE source IS NOT NULL GROUP BY 1",
}
