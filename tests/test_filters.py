import pytest
from pyspark.sql import functions as F

from tracewell.operators import filters as L
from tracewell.operators.rules import glob_join


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        ("docs/a.md", "A", ["work/now", "x"], [("status", "Open"), ("owner", "[[People/Ann|Ann]]")]), ("docs/sub/b.md", "B", ["work"], [("status", "done")]),
        ("c.md", "C", ["workshop"], []), ("d/e f.md", None, None, None), ("docs2/a.md", "A", [], [("status", "open")]),
    ]
    return spark.createDataFrame(rows, "path string, title string, tags array<string>, properties array<struct<key:string,value:string>>")


def found(notes, text, implicit="or", bare="path"):
    return sorted(r.path for r in L.listed(notes, text, implicit, bare).collect())


def test_language(notes):
    assert found(notes, "tag:work") == ["docs/a.md", "docs/sub/b.md"]
    assert found(notes, "tag:#Work/now") == ["docs/a.md"]
    assert found(notes, "status:OPEN") == ["docs/a.md", "docs2/a.md"]
    assert found(notes, "owner:People/Ann") == ["docs/a.md"]
    assert found(notes, "docs c.md") == ["c.md", "docs/a.md", "docs/sub/b.md"]
    assert found(notes, "docs status:open", "and") == ["docs/a.md"]
    assert found(notes, "not (docs or docs2)") == ["c.md", "d/e f.md"]
    assert found(notes, "docs and not tag:x or c.md") == ["c.md", "docs/sub/b.md"]
    assert found(notes, "! docs && ! docs2 && ! d") == ["c.md"]
    assert len(found(notes, "*")) == 5
    assert found(notes, "find:d/a") == ["docs/a.md", "docs2/a.md"] == found(notes, "d/a", bare="find")
    assert found(notes, 'find:"e f"') == ["d/e f.md"]
    assert found(notes, "find:a/b/c") == []


@pytest.mark.parametrize("bad", ["", "(", "a )", "or a", "a and", "tag:", "tag:*", "find:", "status:", "status:*", ":x", "not"])
def test_rejected(notes, bad):
    with pytest.raises(ValueError):
        L.compiled(bad)


def test_sets_equal_rows(notes):
    got = sorted(r.path for r in L.listed_by_sets(notes, ["tag:work", "status:open"], "docs2").collect())
    assert got == found(notes, "(tag:work or status:open) and not docs2")


def test_ordered_terms(spark):
    t = spark.createDataFrame([(1, "s", k, w) for k, w in enumerate("red fox red dog".split())] + [(2, "s", 0, "dog"), (2, "s", 1, "red")], "note_id long, scope string, ordinal int, token string")
    assert [r.note_id for r in L.ordered_terms(t, ["re", "do"], "s").collect()] == [1]
    assert [r.note_id for r in L.ordered_terms(t, ["red", "red"], "s").collect()] == [1]
    assert L.ordered_terms(t, ["re", "do"], "other").count() == 0


def test_globs(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/c.py",), ("c.py",), ("a/x+y.py",), (None,)], "path string")
    rules = spark.createDataFrame([(1, "a/**/*.py"), (2, "**/c.py"), (3, "a/?.py"), (4, "a/x+*.py"), (5, "*"), (6, None)], "id int, glob string")
    got = {}
    for r in glob_join(paths, rules).collect():
        got.setdefault(r["id"], set()).add(r.path)
    assert got == {1: {"a/b/c.py", "a/c.py", "a/x+y.py"}, 2: {"a/b/c.py", "a/c.py", "c.py"}, 3: {"a/c.py"}, 4: {"a/x+y.py"}, 5: {"c.py"}}
    assert glob_join(paths, rules.where(F.col("id") > 9)).count() == 0
