"""Queries for sources, sinks, streams and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import extensions as X
from tracewell.functions import text as T
from tracewell.plans.frames import notes
from tracewell.plans.graphs import _NOTE, note_links
from tracewell.runtime import table
from tracewell.sources import vault as V
from tracewell.streaming import incremental as I


def source_discovery(spark, d):
    """Documents on hand against the notes indexed before."""
    now = notes(spark, d).select("path", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return V.discovered(now, table(spark, d, "notes").select("path", F.col("content_hash").alias("hash")))


def source_prefix(spark, d):
    return V.by_prefix(notes(spark, d), "meetings").select("path", "title")


def source_lookup(spark, d):
    return V.looked_up(table(spark, d, "orders"), [1, 2, 3, 7, 32, 33, 5000000], "o_orderkey").select("o_orderkey", "o_custkey")


def source_chunks(spark, d):
    """A full ordered dump of the chunks."""
    return table(spark, d, "intel_chunks_new").select("id", "chunk_id", "owner_id", "ord").orderBy("owner_id", "ord", "id")


def source_code_references(spark, d):
    return V.code_references(notes(spark, d).where("text is not null").select("path", "text"))


def sink_replaced(spark, d):
    """Chunks after the owners that have nodes were written anew as one row each."""
    c = table(spark, d, "intel_chunks_new").select("owner_id", "ord", F.lower(F.trim("granularity")).alias("granularity"))
    new = c.where("granularity = 'node'").groupBy("owner_id").agg(F.lit(0).cast("long").alias("ord"), F.lit("whole").alias("granularity"))
    return V.replaced(c, new, "owner_id").groupBy("granularity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner_id").alias("owners"))


def sink_upserted(spark, d):
    """Modification times of notes after the documents' were put in and the deleted ones taken out."""
    rows = table(spark, d, "notes")
    old = rows.groupBy("path").agg(F.max("mtime").alias("mtime"))
    changed = notes(spark, d).select("path", F.unix_timestamp("updated_at").alias("mtime"))
    return V.upserted(old, changed, rows.where("deleted_at is not null").select("path"), "path")


def sink_embedding_cache(spark, d):
    """Titles with vectors from the cache where there are (those of the kind note), else embedded: only the misses are."""
    texts = notes(spark, d).where("title is not null").select(F.sha2("title", 256).alias("hash"), F.col("title").alias("text"), "doc_kind")
    cache = texts.where("doc_kind = 'note'").select("hash", X.embedded(F.col("text"), 16).alias("vector"), F.lit("m").alias("model"), F.lit(16).alias("dims"))
    both, fresh = V.with_cache(texts, cache, "m", 16, lambda miss: miss.select("hash", X.embedded(F.col("text"), 16).alias("vector")))
    return both.agg(F.count(F.lit(1)).alias("texts"), F.count("vector").alias("vectors")).withColumn("fresh", fresh.agg(F.count(F.lit(1))).scalar())


def stream_event_windows(spark, d):
    """Events through a file stream in micro-batches, counted per hour and kind."""
    path = f"{d}/events.parquet"
    s = I.file_stream(spark, path, spark.read.parquet(path).schema)
    return I.collected(I.event_windows(s, "1 hour"), "complete").withColumn("total", F.round("total", 4))


def stream_sliding_windows(spark, d):
    return I.event_windows(table(spark, d, "events"), "6 hours", "2 hours").withColumn("total", F.round("total", 4))


CHANGED = "2026-09-01"


def stream_affected(spark, d):
    """Notes to redo after the latest changes: those and the ones that link to them."""
    changed = notes(spark, d).where(F.col("updated_at") >= F.lit(CHANGED).cast("timestamp")).select("path")
    return I.affected(changed, note_links(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target")))


def stream_delta(spark, d):
    """Notes by state after redoing what the changes touch; the result of an update in place."""
    old = notes(spark, d).where(F.col("updated_at") < F.lit(CHANGED).cast("timestamp")).select("path", F.lit("old").alias("state"))
    new = notes(spark, d).select("path", F.lit("new").alias("state"))
    return I.delta(old, new, stream_affected(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def stream_unsent(spark, d):
    """What a session was not sent yet: each user's kinds of events after the first week."""
    e = table(spark, d, "events")
    cut = e.agg((F.min("ts") + F.expr("interval 7 days"))).scalar()
    e = e.withColumn("cut", cut)
    items = e.where("ts >= cut").select("user_id", "event_type")
    return I.unsent(items, e.where("ts < cut").select("user_id", "event_type"), ["user_id", "event_type"])


def stream_fingerprint(spark, d):
    """The count, hash sum and xor of all columns of the orders."""
    orders = table(spark, d, "orders")
    return I.fingerprint(orders, sorted(orders.columns))


def udf_embedded(spark, d):
    return notes(spark, d).where("title is not null").select("doc_id", X.embedded(F.col("title"), 32).alias("vector"))


def udf_scored(spark, d):
    docs = notes(spark, d).where("title is not null").select(F.col("path").alias("handle"), F.col("title").alias("text"))
    return X.scored("search quality property", docs, X.overlap_scorer).select("handle", F.round("second", 6).alias("second"))


RECIPE = X.Recipe("large_orders", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM {orders} WHERE o_totalprice >= :least AND o_orderstatus = :status GROUP BY o_custkey", {"least": float, "status": str})


def udf_recipe(spark, d):
    return RECIPE.run(spark, {"orders": table(spark, d, "orders")}, least=150000, status="F")


VIEW = X.View("notes", ("path", "title", "updated_at"), "doc_kind = 'meeting'", (("updated_at", True), ("path", False)), first=25)


def udf_view(spark, d):
    return VIEW.run({"notes": notes(spark, d)})


def udf_view_groups(spark, d):
    return X.View("notes", ("path",), "doc_kind is not null", group="doc_kind").run({"notes": notes(spark, d)})


def udf_table_function(spark, d):
    X.register_functions(spark)
    return spark.sql("SELECT n.doc_id, l.target, l.alias FROM {notes} n, LATERAL scan_links(n.text) l", notes=notes(spark, d)).groupBy("doc_id", "target", "alias").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("source", "sink", "stream", "udf") and callable(f)}
_ROWS = "SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"
SQL = {
    "source_discovery": """WITH a AS (SELECT path, max(md5(coalesce(text, ''))) AS h FROM documents GROUP BY 1), b AS (SELECT path, max(content_hash) AS h FROM notes GROUP BY 1)
SELECT path, CASE WHEN b.path IS NULL OR b.h IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h""",
    "source_prefix": "SELECT path, title FROM documents WHERE path = 'meetings' OR path LIKE 'meetings/%'",
    "source_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 32, 33, 5000000)",
    "source_chunks": "SELECT id, chunk_id, owner_id, ord FROM intel_chunks_new",
    "sink_replaced": """WITH c AS (SELECT owner_id, ord, lower(trim(granularity)) AS granularity FROM intel_chunks_new), nw AS (SELECT owner_id, 0 AS ord, 'whole' AS granularity FROM c WHERE granularity = 'node' GROUP BY 1)
SELECT granularity, count(*) AS n, count(DISTINCT owner_id) AS owners FROM (SELECT * FROM c WHERE owner_id IS NULL OR owner_id NOT IN (SELECT owner_id FROM nw WHERE owner_id IS NOT NULL) UNION ALL SELECT * FROM nw) GROUP BY 1""",
    "sink_upserted": """WITH o AS (SELECT path, max(mtime) AS mtime FROM notes GROUP BY 1), c AS (SELECT path, epoch(updated_at)::BIGINT AS mtime FROM documents)
SELECT * FROM o WHERE path NOT IN (SELECT path FROM c) AND path NOT IN (SELECT path FROM notes WHERE deleted_at IS NOT NULL) UNION ALL SELECT * FROM c""",
    "sink_embedding_cache": "SELECT count(*) AS texts, count(*) AS vectors, count(DISTINCT title) FILTER (title NOT IN (SELECT title FROM documents WHERE title IS NOT NULL AND doc_kind = 'note')) AS fresh FROM documents WHERE title IS NOT NULL",
    "stream_event_windows": _ROWS,
    "stream_sliding_windows": "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(k * 2) AS start FROM events, range(3) r(k) WHERE ts IS NOT NULL) GROUP BY 1, 2",
    "stream_affected": _NOTE + f", c AS (SELECT path FROM documents WHERE updated_at >= TIMESTAMP '{CHANGED}') SELECT path FROM c UNION SELECT src FROM nl WHERE dst IN (SELECT path FROM c)",
    "stream_delta": _NOTE + f", c AS (SELECT path FROM documents WHERE updated_at >= TIMESTAMP '{CHANGED}'), t AS (SELECT path FROM c UNION SELECT src FROM nl WHERE dst IN (SELECT path FROM c)) SELECT state, count(*) AS n FROM (SELECT 'old' AS state FROM documents WHERE updated_at < TIMESTAMP '{CHANGED}' AND path NOT IN (SELECT path FROM t) UNION ALL SELECT 'new' FROM documents WHERE path IN (SELECT path FROM t)) GROUP BY 1",
    "stream_unsent": "WITH c AS (SELECT min(ts) + INTERVAL 7 DAY AS cut FROM events) SELECT DISTINCT user_id, event_type FROM events, c WHERE ts >= cut EXCEPT SELECT user_id, event_type FROM events, c WHERE ts < cut",
    "udf_scored": "SELECT path AS handle, round(len(list_intersect(list_distinct(string_split(lower(title), ' ')), ['search', 'quality', 'property'])) / 3.0, 6) AS second FROM documents WHERE title IS NOT NULL",
    "udf_recipe": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F' GROUP BY 1",
    "udf_view": "SELECT path, title, updated_at FROM documents WHERE doc_kind = 'meeting' ORDER BY updated_at DESC NULLS LAST, path LIMIT 25",
    "udf_view_groups": "SELECT doc_kind, count(*) AS n, min(path) AS first FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1",
    "udf_table_function": r"SELECT doc_id, trim(regexp_extract(l, '^\[\[([^\[\]|\n]+)', 1)) AS target, trim(regexp_extract(l, '\|([^\[\]\n]+)\]\]$', 1)) AS alias, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[\[[^\[\]|\n]+(?:\|[^\[\]\n]+)?\]\]')) AS l FROM documents) GROUP BY ALL",
}
