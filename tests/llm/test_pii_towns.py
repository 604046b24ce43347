import itertools
import re

from tracewell.llm import pii as P

WORDS = ["q" + "".join(w) for w in itertools.product("abcdefghijklm", repeat=4)]


def found(towns, text):
    return [text[a:b] for a, b in P.Finder({"given": set(), "family": set(), "town": set(towns)}).addresses(text, 0, len(text))]


def test_short_towns_among_many_longer_ones():
    towns = {f"longname{w}" for w in WORDS[:3000]} | {"ulm", "york", "new york"}
    for end in ("Ulm", "York, YO1 7HH", "New York 10001", "12345 Ulm", "York, flat 3"):
        assert found(towns, f"Ship to 12 Mill Road, {end} today") == [f"12 Mill Road, {end}"]
    assert found(towns, "at 12 Mill Road, Yorkshire and 3 High Street\nUlm.") == ["12 Mill Road", "3 High Street\nUlm"]


def test_equals_one_pattern_over_all_towns():
    town = r"(?:(?:new york|york|ulm)(?![\w]))"
    end = rf"(?:, ?|\s?\n[ >*\-]*)(?:{P._POST},? )?{town}(?:(?:,? |, ?\n){P._POST})?"
    whole = P._STREET.pattern.removesuffix("(?![A-Za-z0-9])") + rf"(?:{end})?(?:, {P._UNIT})?(?![A-Za-z0-9])"
    whole = re.compile(whole, re.I)
    finder = P.Finder({"given": set(), "family": set(), "town": {"ulm", "york", "new york"}})
    parts = [["", "flat 2, "], ["12 Mill Road", "Hauptstraße 5", "calle Mayor, 7", "8 rue de la Paix"], ["", ", apt 4"], ["", ", ", ",", ",\n", "\n> ", " \n"], ["", "12345 ", "AB1 2CD, ", "AB 12345 "], ["", "York", "new York", "NEW ulm", "ulm2", "Ulmer"], ["", " 12345", ", AB1 2CD", ",\n12345", " 123456"], ["", ", flat 9", ", flat 9 York", " x"]]
    for t in map("".join, itertools.product(*parts)):
        assert list(finder.addresses(t, 0, len(t))) == [m.span() for m in whole.finditer(t)], t


def test_no_word_is_ranked_out_of_a_gazetteer(spark):
    names = [w.capitalize() for w in WORDS[:20_500]]
    text = "\n".join(f"12345 {n}." for n in names) + "\n" + "\n".join(f"From: Nora {n} <x@mail.example>" for n in names)
    words = P.gazetteers(spark.createDataFrame([(text,), (text,)], "text string"))
    assert words["town"] == words["family"] == {n.lower() for n in names}
