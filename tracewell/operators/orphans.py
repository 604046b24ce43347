"""References to records that do not exist.

1. All references, of whatever tables, become one frame (ref, key, at), each table read once, and are counted per key and month
   with the first and last time in it. Map tasks count first, so a key that holds a third of all rows is one row per task and month.
2. The distinct keys are anti-joined against the parent keys; keys whose parents are all deleted, or were first seen after some
   reference, are found by a join on the same keys.
3. What is left is joined back to the counts, which hold a few rows per key, so no key is hot there.
Whether a month has a late reference is known from its first time. How many, in a month the parent was first seen in, is counted
from the references of just those keys.

Defined cases: a null key is no reference; a blank path is a key like any other; a null indexed_at of the referring row gives
the period 'unknown' and is never late; a parent without any indexed_at is never late; repeated rows count in the report and
once in the distinct references; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.paths import canonical_path
from tracewell.runtime import written

#: Keys whose late references are counted one by one are broadcast up to so many (about 100 bytes each), joined by shuffle beyond.
SEND_KEYS = 50_000


@dataclass(frozen=True)
class Reference:
    """One foreign key. path: its keys are paths, of which two spellings are one key."""

    ref_table: str
    ref_field: str
    parent_table: str
    parent_field: str
    path: bool = False
    ref_time: str = "indexed_at"
    parent_time: str = "indexed_at"
    #: notes.indexed_at holds epoch seconds
    parent_epoch: bool = False


def _key(field: str, path: bool) -> Column:
    return canonical_path(F.col(field)) if path else F.col(field).cast("string")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def references(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """(ref, key, at, period) of every non-null reference; ref is its place in the list."""
    parts = []
    for name, time in sorted({(r.ref_table, r.ref_time) for r in refs}):
        fields = [F.struct(F.lit(i).alias("ref"), _key(r.ref_field, r.path).alias("key")) for i, r in enumerate(refs) if (r.ref_table, r.ref_time) == (name, time)]
        parts.append(tables[name].select(F.col(time).cast("timestamp").alias("at"), F.explode(F.array(*fields)).alias("r")).select("r.ref", "r.key", "at"))
    return _union(parts).where(F.col("key").isNotNull()).withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")))


def parents(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """One row per (ref, key) of the parents: when it was first seen, and whether every row of it is deleted."""
    parts = []
    for i, r in enumerate(refs):
        at = F.col(r.parent_time)
        at = F.timestamp_seconds(at) if r.parent_epoch else at.cast("timestamp")
        parts.append(tables[r.parent_table].select(F.lit(i).alias("ref"), _key(r.parent_field, r.path).alias("key"), at.alias("at"), F.col("deleted_at").isNotNull().alias("gone")))
    return _union(parts).where(F.col("key").isNotNull()).groupBy("ref", "key").agg(F.min("at").alias("first_at"), F.min("gone").alias("all_gone"))


def _months(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, key, period, state, refs, last_ref, first_at) of the months with orphan references."""
    counted = written(rows.groupBy("ref", "key", "period").agg(F.count(F.lit(1)).alias("refs"), F.min("at").alias("first_ref"), F.max("at").alias("last_ref"))).df
    keys = counted.groupBy("ref", "key").agg(F.min("first_ref").alias("earliest"))
    missing = keys.join(known, ["ref", "key"], "left_anti").select("ref", "key", F.lit("missing").alias("state"), F.lit(None).cast("timestamp").alias("first_at"))
    flawed = keys.join(known, ["ref", "key"]).where(F.col("all_gone") | (F.col("first_at") > F.col("earliest")))
    flawed = flawed.select("ref", "key", F.when(F.col("all_gone"), "deleted").otherwise("late").alias("state"), "first_at")
    back = counted.join(missing.unionByName(flawed), ["ref", "key"])
    return back.where((F.col("state") != "late") | (F.col("first_at") > F.col("first_ref"))).select("ref", "key", "period", "state", "refs", "last_ref", "first_at")


def _named(refs: list[Reference]) -> list[Column]:
    of = lambda field: F.element_at(F.array(*[F.lit(getattr(r, field)) for r in refs]), F.col("ref") + 1).alias(field)
    return [of("ref_table"), of("ref_field")]


def orphans(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """(ref_table, ref_field, missing_key, period, state) of the distinct orphan references; tables: by name."""
    return _months(references(tables, refs), parents(tables, refs)).select(*_named(refs), F.col("key").alias("missing_key"), "period", "state")


def orphan_report(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """Orphan references per table, field, period and state: distinct keys and referring rows."""
    rows = references(tables, refs)
    months = written(_months(rows, parents(tables, refs))).df
    # A month that holds references from before and after the parent's first time.
    divided = (F.col("state") == "late") & (F.col("last_ref") >= F.col("first_at"))
    part = months.where(divided).select("ref", "key", "period", "state", "first_at")
    sent = F.broadcast(part) if part.count() <= SEND_KEYS else part
    late = rows.join(sent, ["ref", "key", "period"]).where(F.col("at") < F.col("first_at")).groupBy("ref", "key", "period", "state").agg(F.count(F.lit(1)).alias("refs"))
    whole = months.where(~F.coalesce(divided, F.lit(False))).select("ref", "key", "period", "state", "refs").unionByName(late)
    found = whole.groupBy("ref", "period", "state").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("refs").alias("orphan_rows"))
    return found.select(*_named(refs), "period", "state", "orphan_keys", "orphan_rows")
