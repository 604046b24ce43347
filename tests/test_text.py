import random

from pyspark.sql import functions as F

from tracewell.functions import chunks as C
from tracewell.functions import scalars as S
from tracewell.functions import text as T
from tracewell.functions.stem import stem

NOTE = "---\ntags: [Area/One, two]\nstatus: open\n---\n# Head *One*\nkey:: value here\nsee [[Target#Part|shown]] and ![[Pic]] [l](u.md) #tag/x #1 `#no [[no]]`\n```\n[[not]] #not\n```\n## Second 2024-05-01 ##\nlast ^abc-1\n"


def one(spark, *cols):
    return spark.createDataFrame([(NOTE,)], "t string").select(*cols).first()


def test_markdown(spark):
    t = F.col("t")
    r = one(spark, T.all_tags(t), T.wikilinks(t), T.markdown_links(t), T.inline_properties(t), T.headings(t), T.front_value(t, "status"), T.block_id(t))
    assert r[0] == ["area/one", "two", "tag/x"]
    assert [(x.target, x.heading, x.alias, x.embed) for x in r[1]] == [("Target", "Part", "shown", False), ("Pic", "", "", True)]
    assert [(x.label, x.href) for x in r[2]] == [("l", "u.md")]
    assert [(x.key, x.value) for x in r[3]] == [("key", "value here")]
    assert [(x.level, x.heading) for x in r[4]] == [(1, "Head *One*"), (2, "Second 2024-05-01")]
    assert (r[5], r[6]) == ("open", "abc-1")


def test_slugs_and_tokens(spark):
    df = spark.createDataFrame([("  Übung: Hello, World! ",), ("parseHTMLFile2 x é9",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.slug(F.col("t"))).collect()] == ["übung-hello-world", "parsehtmlfile2-x-é9", None, ""]
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["übung", "hello", "world"], ["parse", "htmlfile2", "é9"], None, []]
    v = spark.createDataFrame([("queries",), ("notes",), ("embedding",), ("as",)], "t string").select(T.variants(F.col("t"))).collect()
    assert [r[0] for r in v] == [["queries", "query"], ["notes", "note"], ["embedding", "embed", "embedded", "embeddings"], ["as"]]


def test_split_overlap(spark):
    rows = spark.createDataFrame([("abcdefghij",), ("abc",), ("",)], "t string").select(T.split_overlap(F.col("t"), 4, 2)).collect()
    assert [r[0] for r in rows] == [["abcd", "cdef", "efgh", "ghij"], ["abc"], [""]]
    assert C.windows("abcdefghij", 4, 2) == rows[0][0]


def test_typos_against_distance(spark):
    def osa(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(4, 8))) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", T.typo_of(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.near == (min(len(r.a), len(r.b)) >= 5 and osa(r.a, r.b) <= 1), (r.a, r.b)


def test_scalars(spark):
    cases = [("bool", "T", "true"), ("bool", "no", None), ("int", " +7 ", "7"), ("int", "7.0", None), ("real", "1e3", "1000.0"), ("real", "NaN", None), ("date", "2024/02/29", "2024-02-29"), ("date", "2023-02-29", None),
             ("datetime", "2024-01-01 10:00", "2024-01-01T10:00:00.000000000Z"), ("datetime", "2024-01-01T10:00:00.123456789+02:00", "2024-01-01T08:00:00.123456789Z"), ("url", "http://x.y/z", "http://x.y/z"), ("url", "ftp://x", None), ("id", " ", None), ("int", None, None)]
    for kind, raw, want in cases:
        got = spark.createDataFrame([(raw,)], "t string").select(S.typed(F.col("t"), kind)).first()[0]
        assert got == want, (kind, raw)


def test_chunks_and_code(spark):
    text = "---\na: 1\n---\nintro " + "w " * 500 + "\n# One\n" + "x" * 6000 + "\n```\n# no heading\n```\n## Two\nshort\n### Three\n" + "y " * 600
    got = C.chunks_of("Title", text)
    assert [c[0] for c in got] == list(range(len(got)))
    assert got[0][1] == "Title > " and [c[1] for c in got if c[2] == "One"] == ["Title > One"] * 3
    assert got[-1][1] == "Title > One > Two" and "y y" in got[-1][3]
    assert C.code_spans("a `b` c\n\n    d\n```\ne\n") == [(2, 5), (9, 15), (15, 21)]
    df = spark.createDataFrame([(1, "T", None), (2, "T", " "), (3, None, "x")], "doc_id long, title string, text string")
    assert [r.doc_id for r in C.chunked(df).collect()] == [3]
    y = spark.createDataFrame([("---\na: [1, x]\n---\n",), ("---\n: bad: [\n---\n",), (None,)], "t string").select(C.frontmatter_json(F.col("t"))).collect()
    assert [r[0] for r in y] == ['{"a": [1, "x"]}', None, None]


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "electriciti": "electr",
             "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky", "as": "as"}
    assert {w: stem(w) for w in words} == words
