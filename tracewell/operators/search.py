"""Retrieval: BM25 over weighted columns, exact vectors, and lanes that turn tables into evidence rows.

A query is small: its words or vectors travel to the data, and each task hands on only what can still be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import tokens
from tracewell.runtime import written

# Usual constants of BM25; words too common to search for.
K1, B = 1.2, 0.75
STOP = """a an and are as at be been being by did do does for from have has how i in is it not of on or that the their these this those to
was we were what when where who why with you""".split()


def query_words(text: str, most: int = 12) -> list[str]:
    """Words of a query: stop words only left out of four words or more, one letter never, each once."""
    import re

    words = [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"([a-zß-ÿ])([A-ZÀ-Þ])", r"\1 \2", text))]
    kept = [w for w in words if w not in STOP] if len(words) >= 4 else words
    kept = [w for w in kept if len(w) > 1] or [w for w in words if len(w) > 1]
    return list(dict.fromkeys(kept))[:most]


def bm25(docs: DataFrame, key: str, columns: dict[str, float], words: list[str]) -> DataFrame:
    """(key, score) of documents with any of the words, higher is better: a word's count is weighted by column, idf as in FTS engines
    (0.000001 at least). Counts come from the token arrays in place; no postings are shuffled, only two sums per word."""
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    # One pass over the texts: of the tokens only their number and the query's words are kept, then counted in those few.
    arrays = docs.select(key, *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"_t_{c}") for c in columns])
    kept = arrays.select(key, sum((F.size(f"_t_{c}") for c in columns), F.lit(0)).alias("_n"), *[F.filter(f"_t_{c}", lambda t: t.isin(words)).alias(f"_h_{c}") for c in columns])

    def times(column: str, word: str) -> Column:
        return F.size(F.filter(f"_h_{column}", lambda t: t == word))

    counts = [sum((F.lit(w) * times(c, q) for c, w in columns.items()), F.lit(0.0)).alias(f"_f{i}") for i, q in enumerate(words)]
    rows = written(kept.select(key, "_n", *counts)).df
    stats = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(words))]).alias("s")).scalar()
    hit = F.greatest(*[F.col(f"_f{i}") for i in range(len(words))], F.lit(0.0)) > 0
    rows = rows.where(hit).withColumn("_s", stats)
    total = F.lit(0.0)
    for i in range(len(words)):
        df = F.col(f"_s.d{i}")
        idf = F.greatest(F.log((F.col("_s.n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        f = F.col(f"_f{i}")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_s.avg")))
    return rows.select(key, total.alias("score"))


#: Query vectors that travel with a task; a larger set of queries goes in blocks of about so many.
QUERIES = 10_000


def nearest(vectors: DataFrame, key: str, vector: str, queries: dict[int, list[float]], k: int) -> DataFrame:
    """(query, key, score): exact cosine, the k best per query. Each batch multiplies its vectors with all queries and hands on its
    own k best. Vectors of another length or of length 0 have no score; a query of length 0 is an error."""
    if len(queries) > QUERIES:
        raise ValueError(f"{len(queries)} query vectors; at most {QUERIES} travel with the tasks")
    ids = np.array(sorted(queries), np.int64)
    if not len(ids):
        return vectors.select(F.lit(0).cast("long").alias("query"), key, F.lit(0.0).alias("score")).limit(0)
    q = np.array([queries[i] for i in ids.tolist()], np.float64)
    size = np.linalg.norm(q, axis=1, keepdims=True)
    if (size == 0).any():
        raise ValueError("a query vector has length 0")
    q = q / size
    kind = vectors.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lists = b.column(vector)
            fits = pc.equal(pc.list_value_length(lists), q.shape[1]).fill_null(False)
            rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            x = lists.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            length = np.linalg.norm(x, axis=1)
            rows, x = rows[length > 0], x[length > 0] / length[length > 0][:, None]
            if not len(rows):
                continue
            score = q @ x.T
            n = min(k, len(rows))
            best = np.argsort(-score, axis=1, kind="stable")[:, :n]
            taken = b.column(key).take(pa.array(rows[best.ravel()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), taken, pa.array(np.take_along_axis(score, best, 1).ravel())], ["query", key, "score"])

    found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query bigint, `{key}` {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def nearest_of(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = QUERIES) -> DataFrame:
    """The same for a frame of queries (key, vector) with whole-number keys: blocks by hash of the key, each of about `block` vectors,
    so what comes to the driver and travels with tasks is bounded. Queries of length 0 are left out."""
    usable = queries.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-usable.count() // max(1, block // 2)))
    out = None
    for b in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        found = nearest(vectors, key, vector, {r["q"]: list(r["v"]) for r in part}, k)
        out = found if out is None else out.unionByName(found)
    return out


def evidence(rows: DataFrame, handle: str, owner: str, kind: str, channel: str, score: Column, fact: Column | None = None) -> DataFrame:
    """Evidence rows of one lane; scores from 0 to 1."""
    return rows.select(
        F.col(handle).cast("string").alias("handle"), F.col(owner).cast("string").alias("owner"), F.lit(kind).alias("type"), F.lit(channel).alias("channel"),
        F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), (fact if fact is not None else F.lit("")).alias("fact"),
    )


def merged(lanes: list[DataFrame]) -> DataFrame:
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out


def reranked(results: DataFrame, scores: DataFrame, top: int = 30, weight: float = 0.3) -> DataFrame:
    """The first results (handle, place, score, pinned) blended with second scores (handle, second, from 0 to 1): movable ones are
    sorted anew among their own places; pinned ones stay where they are."""
    first = results.where((F.col("place") <= top) & ~F.col("pinned")).join(scores, "handle")
    n = Window.partitionBy(F.lit(0))
    blended = first.withColumn("final", (1 - weight) * F.col("score") + weight * F.col("second") * F.max("score").over(n))
    by_place = blended.withColumn("slot", F.row_number().over(n.orderBy("place"))).select("slot", F.col("place").alias("new_place"))
    by_final = blended.withColumn("slot", F.row_number().over(n.orderBy(F.desc("final"), "place"))).select("slot", "handle", "final")
    moved = by_final.join(by_place, "slot").select("handle", "new_place", "final")
    return results.join(moved, "handle", "left").select("handle", F.coalesce("new_place", "place").alias("place"), F.coalesce("final", "score").alias("score"), "pinned")


def diversified(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (owner, heading, ord, place) without those beside (one apart or the same) an earlier kept hit of the same owner and heading.
    Greedy along the order, so it runs per owner; an owner's hits are the few a search returned."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, at = [], {}
        for r in rows.sort_values("place").itertuples():
            if all(abs(o - r.ord) > 1 for o in at.get(r.heading, [])):
                at.setdefault(r.heading, []).append(r.ord)
                kept.append(r.Index)
        return rows.loc[kept]

    return hits.groupBy("owner").applyInPandas(run, hits.schema).orderBy("place").limit(limit)
