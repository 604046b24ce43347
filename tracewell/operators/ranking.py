"""Windows, caps, evidence fusion and quality measures.

Evidence is a long frame (handle, owner, type, channel, score). Every ranking ends in a full order, so results don't depend on how
rows were spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channels, and the weights of intents in their order. The next score of a channel counts so much of the one before.
CHANNELS = ["semantic", "lexical", "graph", "refs", "structural", "ambient", "locality", "specificity"]
WEIGHTS = {
    "search": [1.0, 0.6, 0.4, 0.8, 0.7, 0.45, 0.35, 0.9],
    "related_to_seed": [0.4, 0.3, 1.0, 0.9, 0.7, 0.4, 0.4, 0.35],
    "docs_for_code": [0.5, 0.9, 0.15, 1.2, 0.45, 0.15, 0.55, 0.7],
    "code_for_docs": [0.6, 0.6, 0.2, 1.2, 0.35, 0.12, 0.45, 0.75],
    "consolidation": [0.4, 0.2, 1.0, 0.4, 0.8, 0.45, 0.25, 0.45],
    "overview": [1.0, 0.3, 0.5, 0.6, 0.55, 0.25, 0.35, 1.0],
    "subsystem_overview": [0.8, 0.5, 0.35, 1.0, 0.65, 0.25, 0.85, 0.8],
    "go_to_def": [0.0, 0.6, 0.0, 1.4, 0.1, 0.0, 0.2, 0.1],
    "find_usages": [0.0, 0.5, 0.2, 1.2, 0.15, 0.0, 0.15, 0.15],
    "tests_for_code": [0.0, 1.2, 0.1, 0.6, 0.0, 0.0, 0.25, 0.35],
    "explain_symbol": [0.7, 0.8, 0.2, 1.0, 0.25, 0.0, 0.25, 0.8],
    "refactor_impact": [0.2, 0.3, 1.0, 0.8, 0.65, 0.2, 0.2, 0.35],
}
#: What changes where an intent has no text or no seeds: channel -> weight.
WITHOUT_SEEDS = {
    "search": {"graph": 0.15, "refs": 0.25, "structural": 0.2, "ambient": 0.1}, "related_to_seed": {"graph": 0.0, "refs": 0.0, "structural": 0.0, "ambient": 0.0},
    "docs_for_code": {"refs": 0.6, "locality": 0.35}, "code_for_docs": {"refs": 0.4}, "overview": {"graph": 0.2, "refs": 0.3, "structural": 0.25, "ambient": 0.1},
    "subsystem_overview": {"graph": 0.0, "refs": 0.4, "structural": 0.2, "ambient": 0.05}, "find_usages": {"graph": 0.3, "refs": 0.8}, "tests_for_code": {"graph": 0.1, "refs": 0.3}, "refactor_impact": {"graph": 0.4, "refs": 0.4},
}
WITHOUT_TEXT = {
    "related_to_seed": {"semantic": 0.0, "lexical": 0.0}, "docs_for_code": {"semantic": 0.2}, "consolidation": {"semantic": 0.0, "lexical": 0.0}, "overview": {"semantic": 0.5, "lexical": 0.1},
    "subsystem_overview": {"semantic": 0.45, "lexical": 0.15}, "go_to_def": {"lexical": 0.3}, "explain_symbol": {"semantic": 0.4},
}
for _alias in ("callers", "callees"):
    WEIGHTS[_alias], WITHOUT_SEEDS[_alias] = WEIGHTS["find_usages"], WITHOUT_SEEDS["find_usages"]
for _alias in ("security_audit", "data_flow", "implementers", "overrides", "imports"):
    WEIGHTS[_alias], WITHOUT_SEEDS[_alias] = WEIGHTS["refactor_impact"], WITHOUT_SEEDS["refactor_impact"]
DECAY, PER_TYPE, IN_ALL = 0.55, 3, 12


def weights(intent: str, text: bool = True, seeds: bool = True) -> dict[str, float]:
    w = dict(zip(CHANNELS, WEIGHTS.get(intent, WEIGHTS["search"]), strict=True))
    if not text:
        w |= WITHOUT_TEXT.get(intent, {})
    if not seeds:
        w |= WITHOUT_SEEDS.get(intent, {})
    return w


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "rank") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)


def capped_twice(df: DataFrame, inner: str, outer: str, order: list[Column], per_inner: int, per_outer: int) -> DataFrame:
    """At most so many rows per inner key; of those at most so many per outer key."""
    return top_per_group(top_per_group(df, [inner], order, per_inner, "inner_rank"), [outer], order, per_outer, "outer_rank")


def interleaved(df: DataFrame, seed: str, seed_order: str, order: list[Column], limit: int) -> DataFrame:
    """The first of every seed in the seeds' order, then the second of every seed, and so on."""
    turn = F.row_number().over(Window.partitionBy(seed).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", seed_order, *order).limit(limit)


def bounded(evidence: DataFrame, per_type: int = PER_TYPE, in_all: int = IN_ALL) -> DataFrame:
    """A handle's evidence: the best of each type, then the best of all. Equal facts count once, with their best score."""
    facts = evidence.groupBy("handle", "owner", "type", "channel", "fact").agg(F.max("score").alias("score"))
    best = top_per_group(facts, ["handle", "type"], [F.desc("score"), F.asc("fact")], per_type, "in_type")
    return top_per_group(best, ["handle"], [F.desc("score"), F.asc("type"), F.asc("fact")], in_all, "in_all")


def channel_scores(evidence: DataFrame) -> DataFrame:
    """(handle, owner, channel, score): scores of a channel from the best on, each weighing DECAY of the one before, up to 1."""
    place = F.row_number().over(Window.partitionBy("handle", "channel").orderBy(F.desc("score"), "type", "fact"))
    rows = evidence.where(F.col("score") > 0).withColumn("part", F.col("score") * F.pow(F.lit(DECAY), place - 1))
    return rows.groupBy("handle", "owner", "channel").agg(F.least(F.sum("part"), F.lit(1.0)).alias("score"))


def ranked(evidence: DataFrame, by_channel: dict[str, float], per_owner: int, limit: int, primary: list[str] = ()) -> DataFrame:
    """(handle, owner, tier, score): the weighted channels, at most so many results per owner. tier 2: an exact title or path; 1: one
    of the primary types; then the score, then the handle."""
    tier = evidence.groupBy("handle").agg(F.max(F.when(F.col("type").isin("note_title_exact", "path_exact"), 2).when(F.col("type").isin(*primary), 1).otherwise(0)).alias("tier"))
    weight = F.create_map(*[F.lit(x) for kv in by_channel.items() for x in kv])
    total = channel_scores(evidence).groupBy("handle", "owner").agg(F.sum(F.col("score") * F.coalesce(F.try_element_at(weight, F.col("channel")), F.lit(0.0))).alias("score"))
    rows = total.join(tier, "handle").withColumn("score", F.round("score", 9))
    order = [F.desc("tier"), F.desc("score"), F.asc("handle")]
    kept = top_per_group(rows, ["owner"], order, per_owner, "in_owner")
    return kept.orderBy(*order).limit(limit).select("handle", "owner", "tier", "score")


def noisy_or(df: DataFrame, keys: list[str], score: Column, weight: float = 0.5) -> DataFrame:
    """1 - the product of 1 - weight x score."""
    return df.groupBy(*keys).agg((1 - F.exp(F.sum(F.log1p(-weight * F.least(score, F.lit(1.0)))))).alias("score"))


def consensus_labels(labels: DataFrame, least: int = 2) -> DataFrame:
    """(dst, label, notes): the label most notes give a target, of two notes at least; the smaller of equal ones. labels: (src, dst, label)."""
    n = labels.where("label <> ''").groupBy("dst", "label").agg(F.countDistinct("src").alias("notes")).where(F.col("notes") >= least)
    return top_per_group(n, ["dst"], [F.desc("notes"), F.asc("label")], 1).drop("rank")


#: Slabs a group's values are cut into, so that none is sorted in one task.
SLABS = 64


def _alike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which null equals null; the keys of b are dropped."""
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return a.join(b, on).drop(*[f"_k_{k}" for k in keys])


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """The element at ceil(q n) of the sorted values, not an interpolated percentile; with mean and maximum. Equal values are counted
    first; the values of a group are cut into slabs at approximate quantiles, each of which is sorted by itself."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    borders = counted.groupBy(*keys).agg(F.percentile_approx(value, [i / SLABS for i in range(1, SLABS)], 1000).alias("_b"))
    placed = _alike(counted, borders, keys).withColumn("_s", F.size(F.filter("_b", lambda b: b < F.col(value)))).drop("_b")
    sizes = placed.groupBy(*keys, "_s").agg(F.sum("_c").alias("_m"))
    whole = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_past", F.sum("_m").over(whole.orderBy("_s")) - F.col("_m")).withColumn("_n", F.sum("_m").over(whole)).drop("_m")
    rows = _alike(placed, sizes, [*keys, "_s"]).withColumn("_hi", F.col("_past") + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy(value)))

    def at(q: float):
        place = F.greatest(F.ceil(F.round(q * F.col("_n"), 6)), F.lit(1))
        return F.max(F.when((F.col("_hi") >= place) & (F.col("_hi") - F.col("_c") < place), F.col(value))).alias(f"p{round(q * 100)}")

    return rows.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), *[at(q) for q in shares], F.max(value).alias("max"))


def equal_buckets(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Buckets of ceil(n / b) values from high to low, b = ceil(sqrt n) between 5 and 10 and at most n: (keys, bucket, low, high, n,
    example). A group is cut into slabs of its values, each sorted by itself; only rows of one value share a slab whatever their number."""
    rows = df.where(F.col(value).isNotNull())
    borders = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / SLABS for i in range(1, SLABS)], 1000).alias("_b"))
    rows = _alike(rows, borders, keys).withColumn("_s", -F.size(F.filter("_b", lambda b: b < F.col(value)))).drop("_b")
    sizes = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_past", F.sum("_m").over(whole.orderBy("_s")) - F.col("_m")).withColumn("_n", F.sum("_m").over(whole)).drop("_m")
    rows = _alike(rows, sizes, [*keys, "_s"]).withColumn("_k", F.col("_past") + F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(F.desc(value), name)))
    b = F.least(F.greatest(F.ceil(F.sqrt("_n")), F.lit(5)), F.lit(10), F.col("_n"))
    size = F.ceil(F.col("_n") / b)
    rows = rows.withColumn("bucket", F.floor((F.col("_k") - 1) / size))
    return rows.groupBy(*keys, "bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), F.min_by(name, "_k").alias("example"))


def coalesced(evidence: DataFrame) -> DataFrame:
    """Evidence of the whole notes of one owner under one handle: that with the strongest semantic channel, then the smallest. Equal
    facts count once, with their best score; of query_specificity the strongest holds. evidence: as elsewhere, with whole_note."""
    notes, rest = evidence.where("whole_note"), evidence.where("not whole_note")
    semantic = channel_scores(notes.where(F.col("channel") == "semantic")).select("handle", "owner", F.col("score").alias("semantic"))
    handles = notes.select("handle", "owner").distinct().join(semantic, ["handle", "owner"], "left")
    base = handles.groupBy("owner").agg(F.min_by("handle", F.struct(-F.coalesce("semantic", F.lit(0.0)), "handle")).alias("base"))
    fact = F.when(F.col("type") == "query_specificity", "").otherwise(F.col("fact")).alias("fact")
    merged = notes.join(base, "owner").groupBy(F.col("base").alias("handle"), "owner", "type", "channel", fact).agg(F.max("score").alias("score"))
    cols = ["handle", "owner", "type", "channel", "score", "fact"]
    return merged.select(*cols).unionByName(rest.select(*cols))


def ndcg(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query, ndcg, recall, precision) at k of results (query, doc, rank) against grades (query, doc, grade): gain 2^grade - 1."""
    gain = lambda place: (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col(place) + 1)
    ideal = top_per_group(judged.where("grade > 0"), ["query"], [F.desc("grade"), F.asc("doc")], k, "place")
    best = ideal.groupBy("query").agg(F.sum(gain("place")).alias("ideal"))
    relevant = judged.where("grade > 0").groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    hits = results.where(F.col("rank") <= k).join(judged, ["query", "doc"]).groupBy("query").agg(F.sum(gain("rank")).alias("dcg"), F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("hits"))
    rows = best.join(relevant, "query").join(hits, "query", "left")
    return rows.select("query", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)).alias("recall"), (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"))


def finder_order(rows: DataFrame) -> DataFrame:
    """Found entries (tier, score, is_note, uses, title, path): notes get 8 more, use up to 12."""
    total = F.col("score") + F.when(F.col("is_note"), 8).otherwise(0) + F.least(F.col("uses"), F.lit(12))
    return rows.withColumn("total", total).orderBy(F.desc("tier"), F.desc("total"), F.length("title"), "path")


def packed_plans(plans: list[dict], budget: int) -> list[dict]:
    """Content plans (id, size, utility) chosen for a budget: the most useful per size first, each item once. For the few rows that are
    left after a limit; it runs on the driver."""
    out, left, seen = [], budget, set()
    for p in sorted(plans, key=lambda p: (-p["utility"] / max(1, p["size"]), p["size"], str(p["id"]))):
        if p["size"] <= left and p["id"] not in seen:
            out.append(p)
            seen.add(p["id"])
            left -= p["size"]
    return out


def opened_tree(scores: dict[str, float], budget: int) -> list[str]:
    """Folders opened from the best-scored on until so many lines are used: a heap over a small score table, on the driver."""
    import heapq

    children: dict[str, list[str]] = {}
    for p in scores:
        children.setdefault(p.rpartition("/")[0], []).append(p)
    heap, out = [(-scores.get("", 0.0), "")], []
    while heap and len(out) < budget:
        _, at = heapq.heappop(heap)
        for c in sorted(children.get(at, []), key=lambda c: (-scores[c], c)):
            if c != at and len(out) < budget:
                out.append(c)
                heapq.heappush(heap, (-scores[c], c))
    return out
