"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm import conversations as chat
from tracewell.llm import neighbours as near
from tracewell.llm import packing, pii, splitting, tokenizer
from tracewell.runtime import table


def p1_pieces(spark, d):
    """The pieces of every item of intel_chunks_new that is above its limit."""
    return splitting.pieces(*[table(spark, d, t) for t in ("intel_chunks_new", "chunk_limits", "documents")])


def p1_found(spark, d):
    """The items that come out in more than one piece."""
    return p1_pieces(spark, d).where(F.col("piece_no") == 1).select("chunk_id")


def p3_found(spark, d):
    """Pairs with a cosine of at least 0.90, one being among the 10 most similar of the other."""
    return near.similar_pairs(table(spark, d, "embedding_cache"), 10, 0.90)


def p3_neighbours(spark, d):
    """The 10 most similar others of every key."""
    return near.neighbours(table(spark, d, "embedding_cache"), 10).select("key", "rank", "neighbour", F.round("cosine", 4).alias("cosine"))


def p5_found(spark, d):
    """The turns of the conversations that are kept."""
    return chat.conversations(table(spark, d, "agent_messages"), content=False).select("session_id", "turn_no", F.col("id").alias("message_id"))


def p5_conversations(spark, d):
    """The kept conversations in order, with role, content and UTC time of each turn."""
    at = F.concat(F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.col("ns").cast("string"), 9, "0"))
    return chat.conversations(table(spark, d, "agent_messages")).select("session_id", "turn_no", F.col("speaker").alias("role"), "content", at.alias("at"))


def p5_verdicts(spark, d):
    """Every session with whether it is kept and, if not, why."""
    return chat.verdicts(table(spark, d, "agent_messages"))


def p6_ids(spark, d):
    """The ids of every document's text."""
    return tokenizer.encoded(table(spark, d, "documents"))


#: Tokens a container holds.
CAPACITY = 2048


def p7_containers(spark, d):
    """Every document, or piece of one above the capacity, with its container."""
    return packing.packed(tokenizer.token_counts(table(spark, d, "documents")), CAPACITY)


def p7_fill(spark, d):
    return packing.summary(p7_containers(spark, d), CAPACITY)


def p8_found(spark, d):
    """Every item of personal information in documents.text."""
    return pii.items(table(spark, d, "documents"))


def p8_redacted(spark, d):
    """Every document's text with placeholders."""
    documents = table(spark, d, "documents")
    return pii.redacted(documents, pii.items(documents))


_UNSEEN = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_TURNS = rf"""
WITH m AS (SELECT DISTINCT id, session_id, role, content, created_at FROM agent_messages WHERE session_id IS NOT NULL),
seen AS (
  SELECT *, lower(regexp_replace(role, '^{_UNSEEN}+|{_UNSEEN}+$', '', 'g')) AS r, regexp_replace(content, '^{_UNSEEN}+|{_UNSEEN}+$', '', 'g') AS c,
    regexp_extract(created_at, '^(\d{{4}}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)?$', ['day', 'clock', 'frac', 'zone']) AS p
  FROM m WHERE regexp_matches(content, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]') AND coalesce(lower(trim(role)), '') NOT IN ('system', 'tool', 'function', 'developer')),
timed AS (
  SELECT *, CASE WHEN regexp_matches(created_at, '^\d{{13}}$') THEN CAST(created_at AS HUGEINT) * 1000000
    ELSE CAST(epoch(TRY_CAST(p.day || ' ' || p.clock AS TIMESTAMP)) AS HUGEINT) * 1000000000 + CAST(rpad(p.frac, 9, '0') AS HUGEINT)
      - CASE WHEN length(p.zone) = 6 THEN (CASE WHEN p.zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(p.zone[2:3] AS BIGINT) * 3600 + CAST(p.zone[5:6] AS BIGINT) * 60) * CAST(1000000000 AS HUGEINT) ELSE 0 END
    END AS ns,
    CASE WHEN r IN ('user', 'human', 'person') THEN 'u' WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 'a' ELSE 'x' END AS who
  FROM seen),
lagged AS (SELECT *, lag(who) OVER w AS who0, lag(c) OVER w AS c0 FROM timed WINDOW w AS (PARTITION BY session_id ORDER BY ns NULLS FIRST, id)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ns NULLS FIRST, id) AS turn_no FROM lagged WHERE who0 IS NULL OR who0 <> who OR c0 <> c),
verdict AS (
  SELECT session_id, bool_and(who <> 'x' AND ns IS NOT NULL) AS named, bool_and(coalesce(who0 <> who, who = 'u')) AS runs, arg_max(who, turn_no) = 'a' AS replied FROM fresh GROUP BY 1)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_neighbours, p5_found, p5_conversations, p5_verdicts, p6_ids, p7_containers, p7_fill, p8_found, p8_redacted)}
SQL = {
    "p1_found": r"""
WITH item AS (SELECT * FROM intel_chunks_new WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) = 1)
SELECT i.chunk_id FROM item i JOIN documents d ON d.doc_id = i.owner_row_id
JOIN chunk_limits l ON lower(l.granularity) = lower(regexp_replace(i.granularity, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))
WHERE least(i.end_byte, strlen(d.text)) - greatest(i.start_byte, 0) > l.max_bytes""",
    "p5_found": _TURNS + "SELECT f.session_id, f.turn_no, f.id AS message_id FROM fresh f JOIN verdict v USING (session_id) WHERE v.named AND v.runs AND v.replied",
    "p5_verdicts": _TURNS + """SELECT s.session_id, coalesce(v.named AND v.runs AND v.replied, false) AS kept,
  CASE WHEN v.session_id IS NULL THEN 'empty' WHEN NOT v.named THEN 'unreadable' WHEN NOT v.runs THEN 'broken' WHEN NOT v.replied THEN 'no reply' END AS reason
FROM (SELECT DISTINCT session_id FROM agent_messages WHERE session_id IS NOT NULL) s LEFT JOIN verdict v USING (session_id)""",
}
