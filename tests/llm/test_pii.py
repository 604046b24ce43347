import pytest
from pyspark.sql import functions as F

from tracewell.llm import pii as P

SCHEMA = "doc_id long, text string, pii_type string, start_char string"


def corpus():
    """Enough names, towns and vote patterns for the estimates."""
    given, family = ["Nora", "Lena", "Pavel", "Hana", "Oskar", "Ruth"], ["Zemlin", "Kardov", "Zemkov", "Karlin", "Pellin", "Pelkov"]
    out = []
    for i in range(240):
        g, f, t = given[i % 6], family[(i // 6) % 6], ["Oldham", "Brookton"][i % 2]
        out += [
            f"From: {g} {f} <{g.lower()}{i}@mail.example>\n{g} {f} signed off on the plan. Ship to 1{i % 9} Mill Road, {t}, QZ 00{100 + i} today.",
            f"thanks {g}! Call +44 7700 900 {100 + i} if it stops. Build 2026.25.{i}.0143 passed; page 0207 946 to 0209 631.",
            f"SSN 9{10 + i % 90}-12-34{10 + i % 90} shows up in the row. Fixture row 412-07-22{10 + i % 90} is stale. Remote is git@forge.example:vault/x.git and name@host.",
            f"Passport ZX{1000000 + i} belongs to {f}, {g}. May and June were slow; will the rose garden restart? Mark the row as stale.",
            f"Home: Flat {i % 9 + 1}, {i + 1} Mill Lane, {t}. Mill Road Survey has {i} rows. My mail is {f.lower()} (at) post (dot) example.",
        ]
    return out


@pytest.fixture(scope="module")
def found(spark):
    texts = corpus() + ["", None, " ", "x" * 300_000 + " Call +44 7700 900 555 if it stops. ", "担当はLena Zemlinさんです。電話は020 7946 0231まで", "Bitte Zoë Kardov fragen"]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = P.items(df).collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add((r.pii_type, texts[r.doc_id][r.start_char : r.end_char]))
    return texts, out, df


def test_items(found):
    texts, out, _ = found
    assert out[0] == {("person_name", "Nora Zemlin"), ("email", "nora0@mail.example"), ("street_address", "10 Mill Road, Oldham, QZ 00100")}
    assert out[1] == {("person_name", "Nora"), ("phone", "+44 7700 900 100")}
    assert out[2] == {("id_number", "910-12-3410")}
    assert out[3] == {("id_number", "ZX1000000"), ("person_name", "Zemlin, Nora")}
    assert out[4] == {("street_address", "Flat 1, 1 Mill Lane, Oldham"), ("email", "zemlin (at) post (dot) example")}
    n = len(corpus())
    assert not {n, n + 1, n + 2} & set(out)
    assert out[n + 3] == {("phone", "+44 7700 900 555")}
    assert out[n + 4] == {("person_name", "Lena Zemlin"), ("phone", "020 7946 0231")}
    assert out[n + 5] == {("person_name", "Zoë Kardov")}


def test_redaction_and_empty(spark, found):
    texts, _, df = found
    items = P.items(df.where(F.col("doc_id") < 1300))
    rows = {r.doc_id: (r.text, r["items"]) for r in P.redacted(df, items).collect()}
    assert rows[1] == ("thanks [PERSON_NAME]! Call [PHONE] if it stops. Build 2026.25.0.0143 passed; page 0207 946 to 0209 631.", 2)
    assert rows[len(corpus()) + 1] == (None, 0) and rows[len(corpus())] == ("", 0)
    assert P.items(df.limit(0)).count() == 0
    assert P.redacted(df.limit(0), P.items(df.limit(0))).count() == 0


def test_reliabilities_follow_agreement():
    sure = P.reliabilities({"++0": 500, "--0": 480, "+-0": 10, "0+0": 50, "00+": 5})
    assert sure["++0"] > 0.9 > 0.1 > sure["--0"] and sure["0+0"] > 0.5


@pytest.mark.parametrize("n", [5, 70, 130, 3000])
def test_long_local_parts(n):
    """An address is taken from its first character on, however long its local part is."""
    text = "mail to " + "a" * n + ".b-c@post.example now"
    finder = P.Finder({"given": set(P.GIVEN), "family": set(), "town": set()})
    assert [(a, b) for kind, a, b, *_ in finder.candidates(text) if kind == "email"] == [(8, len(text) - 4)]


def test_repeated_rows_give_their_items_each(spark):
    rows = [(i, t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    got = P.items(df).groupBy("doc_id").count().collect()
    once = {r.doc_id: r["count"] for r in P.items(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in got if r.doc_id < 50} == {k: 2 * v for k, v in once.items() if k < 50}


def test_eleven_digits():
    """One leading 0 is a phone number's; a tax number may begin with two, or with none."""
    finder = P.Finder({"given": set(P.GIVEN), "family": set(), "town": set()})
    kinds = lambda t: {kind for kind, a, b, *_ in finder.candidates(t) if b - a >= 11}
    assert kinds("Tel. 07700900457.") == {"phone"}
    for number in ("00095882011", "12095882011", "00 529 465 110"):
        assert "id_number" in kinds(f"Tax id {number}, invoice")
