from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tracewell.functions.paths import canonical_path
from tracewell.operators.orphans import Reference, orphan_report, orphans


def test_paths(spark):
    cases = {"./a/b.py": "a/b.py", "a\\b.py": "a/b.py", "a//b.py": "a/b.py", " a/b.py ": "a/b.py", "x/../x/b.py": "x/b.py", "/a/./b/": "/a/b", "../a": "../a",
             "a/b/../../c": "c", "": "", None: None, "A/b": "A/b", ".": "", "..": "..", "/../a": "/../a", "a/.": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r[0]: r[1] for r in df.select("p", canonical_path(df.p)).collect()}
    assert got == cases


def test_states(spark):
    refs = spark.createDataFrame(
        [(1, D(2025, 1, 5)), (1, D(2025, 1, 6)), (2, D(2025, 1, 5)), (3, D(2025, 1, 5)), (3, D(2025, 1, 20)), (3, None), (4, None), (None, D(2025, 1, 1)), (5, D(2025, 2, 1)), (6, D(2025, 2, 1))],
        "k long, indexed_at timestamp",
    )
    parent = spark.createDataFrame(
        [(2, D(2024, 1, 1), D(2025, 1, 1)), (3, D(2025, 1, 10), None), (3, D(2025, 1, 11), D(2025, 3, 1)), (5, None, None), (6, D(2024, 1, 1), D(2024, 2, 1)), (6, D(2026, 1, 1), None), (None, None, None)],
        "id long, indexed_at timestamp, deleted_at timestamp",
    )
    ref = [Reference("r", "k", "p", "id")]
    found = orphans({"r": refs, "p": parent}, ref)
    assert {(r.missing_key, r.period, r.state) for r in found.collect()} == {("1", "2025-01", "missing"), ("2", "2025-01", "deleted"), ("3", "2025-01", "late"), ("4", "unknown", "missing")}
    assert {(r.period, r.state, r.orphan_keys, r.orphan_rows) for r in orphan_report({"r": refs, "p": parent}, ref).collect()} == {
        ("2025-01", "missing", 1, 2), ("2025-01", "deleted", 1, 1), ("2025-01", "late", 1, 1), ("unknown", "missing", 1, 1),
    }
    assert orphans({"r": refs.limit(0), "p": parent}, ref).count() == 0
    assert orphans({"r": refs, "p": parent.limit(0)}, ref).count() == 7


@pytest.mark.parametrize("send", [0, 50_000])
def test_a_key_with_half_of_all_rows(spark, monkeypatch, send):
    """One key holds half of the rows, and one month of it lies on either side of the parent's first time."""
    monkeypatch.setattr("tracewell.operators.orphans.SEND_KEYS", send)
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.lit(D(2025, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id"))).cast("timestamp").alias("indexed_at"))
    rest = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id") % 5000).alias("k"), F.lit(D(2025, 1, 2)).cast("timestamp").alias("indexed_at"))
    parent = spark.createDataFrame([("hot", D(2025, 1, 5), None)], "id string, indexed_at timestamp, deleted_at timestamp")
    tables = {"r": hot.union(rest), "p": parent}
    refs = [Reference("r", "k", "p", "id"), Reference("r", "k", "p", "id", path=True)]
    rows = orphan_report(tables, refs).collect()
    assert sorted((r.period, r.state, r.orphan_keys, r.orphan_rows) for r in rows) == [("2025-01", "late", 1, 4 * 24 * 60)] * 2 + [("2025-01", "missing", 5000, 20_000)] * 2
    assert orphans(tables, refs[:1]).count() == 5001
