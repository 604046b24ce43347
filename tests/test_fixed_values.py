"""Values and rules as literal cases."""

from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.functions import text as T
from tracewell.operators import search as Q


def test_words_that_are_no_search_words():
    for word in ("been", "did", "do", "does", "have", "has", "not", "their", "these", "you", "we", "i", "who", "why"):
        assert word in Q.STOP
    for word in ("but", "which", "will", "note"):
        assert word not in Q.STOP
    assert Q.query_words("which notes will not have been indexed") == ["which", "notes", "will", "indexed"]


def test_variants(spark):
    df = spark.createDataFrame([("indexes",), ("embed",), ("queries",), ("note",), ("is",)], "w string")
    got = {r.w: r.v for r in df.select("w", T.variants(F.col("w")).alias("v")).collect()}
    assert got["indexes"] == ["indexes", "indexe", "index", "indexed", "indexing"]
    assert got["embed"] == ["embed", "embedded", "embedding", "embeddings"]
    assert got["queries"] == ["queries", "query"] and got["note"] == ["note", "notes"] and got["is"] == ["is"]


def test_groups_with_a_word_in_common_are_one():
    assert T.term_groups(["how", "does", "the", "index", "work"]) == [["index"], ["work"]]
    assert T.term_groups(["index", "note", "indexing"]) == [["index", "indexed", "indexing"], ["note", "notes"]]
    assert T.term_groups(["embedder", "queries", "query", "embed"]) == [["embed", "embedded", "embedder", "embedding", "embeddings"], ["queries", "query"]]
    assert T.term_groups([]) == []


def test_document_classes(spark):
    cases = {
        ("docs/hubs/a.md", "note"): "hub", ("docs/specs/a.md", "note"): "spec", ("docs/efforts/a.md", "note"): "effort", ("docs/reference/analysis/a.md", "note"): "analysis",
        ("docs/reference/a.md", " Note "): "reference", (".claude/skills/a.md", "note"): "generated", (".codex/a.md", "note"): "generated", ("x/.cursor/a.md", "note"): "none",
        ("pkg/templates/skills/a.md", "note"): "generated", ("generated/a.md", "note"): "none", ("README.md", "note"): "repo_global", ("Agents.md", "note"): "repo_global", ("claude.md", "note"): "repo_global",
        ("pkg/readme.md", "note"): "none", ("pkg/x/CONTEXT.md", "note"): "module", ("docs/hubs/a.md", "code"): "none", ("docs/hubs/a.md", None): "none", (" ", "note"): "none", ("own/t/a.md", "note"): "generated", ("own.md", "note"): "repo_global",
    }
    df = spark.createDataFrame(list(cases), "p string, k string")
    got = {(r.p, r.k): r.c for r in df.select("p", "k", S.doc_class(F.col("p"), F.col("k"), ["/t/"], ["own.md"]).alias("c")).collect()}
    assert got == cases
