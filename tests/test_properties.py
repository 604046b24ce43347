from tracewell.plans.notes import agg_property_profile, fn_property_types

TEXTS = [
    "---\ntype: note\ntags: [a/b, \"c, d\"]\nmail: \'x@y.example\'\ndue date: 2026-01-02\nstatus:\n---\nbody: none",
    "---\r\ntype: note\r\ntel: 555-0184\r\nties:\r\n  - [[One]]\r\n  - 7\r\nnested:\r\n  inner: 1\r\n# comment: x\r\n---\r\n",
    "---\ntags: []\nmail: x@y.example\nmail: second@y.example\nup: [[Two]]\n\"quoted key\": true\n---\n",
    "mail: not@front.example",
    None,
]


def test_every_key_is_profiled(spark, tmp_path):
    cols = "doc_id long, path string, title string, doc_kind string, lang string, source string, n_chars long, updated_at timestamp, text string"
    spark.createDataFrame([(i, None, None, None, None, None, None, None, t) for i, t in enumerate(TEXTS)], cols).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["key"]: (r["n"], r["values"], r["types"]) for r in agg_property_profile(spark, str(tmp_path)).collect()}
    assert got == {
        "type": (2, 1, "string"), "tags": (1, 2, "string"), "mail": (2, 1, "string"), "due date": (1, 1, "date"), "tel": (1, 1, "string"),
        "ties": (1, 2, "int,wikilink"), "up": (1, 1, "wikilink"), "quoted key": (1, 1, "bool"),
    }
    values = {r["value"] for r in fn_property_types(spark, str(tmp_path)).collect()}
    assert values == {"note", "a/b", "c, d", "x@y.example", "2026-01-02", "555-0184", "[[One]]", "7", "[[Two]]", "true"}
