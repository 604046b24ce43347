from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tracewell.functions import extensions as X
from tracewell.runtime import shared_dir, written
from tracewell.sources import vault as V
from tracewell.streaming import incremental as I


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("x [[y]]")
    (tmp_path / "sub/b.md").write_text("é")
    (tmp_path / "sub/c.py").write_text("x = 1  # see [[Note|n]] @ann-lee\n// [[Other]]\n")
    assert {(r.path, r.text) for r in V.note_files(spark, str(tmp_path)).collect()} == {("a.md", "x [[y]]"), ("sub/b.md", "é")}
    assert [r.path for r in V.note_files(spark, str(tmp_path), ["^sub/"]).collect()] == ["a.md"]
    code = V.code_files(spark, str(tmp_path))
    assert [(r.path, r.lang) for r in code.collect()] == [("sub/c.py", "py")]
    assert {(r.line, r.target) for r in V.code_references(code).collect()} == {(1, "Note"), (1, "ann-lee"), (2, "Other")}


def test_snapshots(spark, tmp_path):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None)], "path string, hash string")
    b = spark.createDataFrame([("p", "1"), ("q", "3"), ("s", "4"), ("r", None)], "path string, hash string")
    assert {(r.path, r.state) for r in V.discovered(a, b).collect()} == {("q", "changed"), ("s", "removed")}
    root = str(tmp_path / "snap")
    V.save_snapshot({"t": a}, root, "v1")
    V.save_snapshot({"t": V.upserted(a, spark.createDataFrame([("q", "9")], a.schema), spark.createDataFrame([("p", "1")], a.schema), "path")}, root, "v2")
    assert {(r.path, r.hash) for r in V.load_snapshot(spark, root, "t").collect()} == {("q", "9"), ("r", None)}
    assert {(r.path, r.hash) for r in V.replaced(a, spark.createDataFrame([("q", "7"), ("q", "8")], a.schema), "path").collect()} == {("p", "1"), ("q", "7"), ("q", "8"), ("r", None)}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h2", "b"), ("h3", None)], "hash string, text string")
    cache = spark.createDataFrame([("h1", [9.0], "m", 1), ("h2", [8.0], "other", 1)], "hash string, vector array<float>, model string, dims int")
    both, fresh = V.with_cache(texts, cache, "m", 1, lambda t: t.select("hash", X.embedded(F.col("text"), 1).alias("vector")))
    assert both.count() == 4 and both.where("hash = 'h1'").first().vector == [9.0]
    assert sorted(r.hash for r in fresh.collect()) == ["h2", "h3"]
    assert abs(sum(x * x for x in X.hashed_vector("t", 48).tolist()) - 1) < 1e-5


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, D(2025, 1, 1, i % 24, i % 60), "k" if i % 3 else "j", float(i)) for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    path = str(tmp_path / "events")
    e.repartition(5).write.parquet(path)
    streamed = I.collected(I.event_windows(I.file_stream(spark, path, e.schema, per_tick=2), "1 hour"), "complete")
    key = lambda df: sorted((r.start, r.event_type, r.n, r.total) for r in df.collect())
    assert key(streamed) == key(I.event_windows(e, "1 hour"))
    plain = I.collected(I.file_stream(spark, path, e.schema, per_tick=1).where("value > 50"))
    assert plain.count() == 149


def test_incremental(spark):
    dep = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], "source string, target string")
    changed = spark.createDataFrame([("a",)], "path string")
    assert sorted(r.path for r in I.affected(changed, dep, 2).collect()) == ["a", "b", "c"]
    old = spark.createDataFrame([("a", 1), ("z", 1)], "path string, v int")
    new = spark.createDataFrame([("a", 2), ("z", 2)], "path string, v int")
    assert {(r.path, r.v) for r in I.delta(old, new, changed).collect()} == {("a", 2), ("z", 1)}
    assert I.unsent(old, spark.createDataFrame([("z",)], "path string"), ["path"]).count() == 1
    assert I.fingerprint(old, ["path", "v"]).first() == I.fingerprint(old.orderBy("v", "path"), ["path", "v"]).first() != I.fingerprint(new, ["path", "v"]).first()


def test_extensions(spark):
    o = spark.createDataFrame([(1, 5.0), (2, 9.0)], "k int, v double")
    r = X.Recipe("r", "SELECT k FROM {o} WHERE v > :least", {"least": float})
    assert [x.k for x in r.run(spark, {"o": o}, least="6").collect()] == [2]
    for bad in ({}, {"least": 1, "more": 2}):
        with pytest.raises(ValueError):
            r.run(spark, {"o": o}, **bad)
    assert [x.k for x in X.View("o", ("k",), "v > 1", (("v", True),)).run({"o": o}).collect()] == [2, 1]
    with pytest.raises(ValueError):
        X.View("o", ("nope",)).run({"o": o})
    X.register_functions(spark)
    assert [tuple(x) for x in spark.sql("SELECT * FROM split_lines('a\nb')").collect()] == [(1, "a"), (2, "b")]


def test_shared_folder_is_the_sessions(spark, monkeypatch, tmp_path):
    here = shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == here
    w = written(spark.range(5))
    assert w.path.startswith(here) and w.df.count() == 5
    w.drop()
    import os

    assert not os.path.exists(w.path)


def test_a_named_progress_goes_on_from_the_last_tick(spark, tmp_path):
    from tracewell.streaming import incremental as I

    rows = spark.range(10).toDF("n")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    run = lambda: I.drained(I.file_stream(spark, f"{tmp_path}/in", rows.schema), lambda batch, tick: seen.append(batch.count()), progress=f"{tmp_path}/progress")
    run()
    first = sum(seen)
    run()
    assert (first, sum(seen)) == (10, 10)
    rows.limit(3).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sum(seen) == 13
