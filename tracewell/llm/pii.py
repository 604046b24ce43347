"""Personal information inside free text: email, phone, id_number, street_address, person_name.

Weak supervision in four steps:
1. Gazetteers of names and towns come from the corpus itself: names before an address in angle brackets, towns beside a
   postcode; counted over all documents, all kept from two documents on. Every worker holds them, so memory grows with the
   number of different names, not with the text.
2. Candidate spans are found by an automaton over all gazetteer words and street words, and by digit runs; labelers (patterns,
   gazetteers, words on either side, shapes) vote for or against each candidate or abstain.
3. Expectation-maximisation over the counts of all vote patterns estimates how reliable each labeler is, and from that how likely
   each pattern is real. The counts cover all candidates. The words next to likely and unlikely candidates are compared, and those
   that go with one or the other become two more labelers, one for either side, after which the estimate is made again.
4. A logistic span classifier is trained on at most TRAIN candidates of a type (by hash), with those likelihoods as soft labels
   and votes, words around and shapes as features, and decides every candidate. Of overlapping ones the likeliest hold.

Texts are read twice, with nothing shuffled but counts and candidates. Offsets are code points.

Stated limits: an address lies between 60 characters before and 110 after its street word; the words that speak for or against a
candidate are sought within 36 characters of it; what leads a family name (initials, particles, a given name not known) within 45.

Defined cases: null and empty texts have no items; texts of any length are read whole; items do not overlap; repeated rows give
their items each; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import written

TYPES = ["email", "phone", "id_number", "street_address", "person_name"]
#: Names that are also words are candidates of a kind of their own, as labelers are less reliable there.
VAGUE = "person_name?"
#: Candidates of a type the classifier is trained on, at most; features of a type.
TRAIN, FEATURES = 20_000, 1 << 13
LIKELY = 0.5
#: A word next to a type's candidates becomes a cue if it occurs so often there, and their odds differ by so much (natural logarithm).
CUE_TIMES, CUE_ODDS = 20, 1.0

# A seed of given names of several languages; words that are also given names; titles; particles.
GIVEN = """aisha ali alma amara ana andrea anna anne anne-lise anouk antonio astrid begoña ben benno bram carla carlos carmen celia chen chidi chloe claire
daniel dario david dmitri elena elke emil emily emma erik esra eva farid fatima felix fiona francesca fritz goran greta hana hannah hans helga hugo imani ines ingrid
irina ivan ivo iñaki jakob jan jana janek jean jean-marc johan john jonas josé juan julia jutta jürgen karin katya klaus kofi kwame lars laura leif lena leon ling lucas lucia luis
lukas mara marek maria marie marta mateo mehmet mei mia michael miguel mirela mohammed nadia nina nils noé odette olga omar oskar pablo paul pavel pedro petra pierre priya quentin
rosa ruth sanjay sara sofia stefan svetlana séverine søren teresa thomas tilda tomas ugo ulla vera viktor wanda wei wim xenia yara yusuf zelda zoë åsa""".split()
AMBIGUOUS = "may will mark rose grace june april dawn hope joy faith art bill frank grant chase summer iris ivy jack ray rich sky dean guy pat".split()
TITLES = "mr mrs ms mx miss dr prof herr frau fräulein m mme mlle sr sra srta don doña sir".split()
PARTICLES = "van der den von zu zum de la del della di da du ten ter le al el bin ibn st".split()
STREETS = """street st. st road rd rd. row lane ln ln. avenue ave ave. close crescent court way terrace blvd blvd. boulevard drive square rue place quai chemin allée impasse
calle c/ avda avda. avenida paseo plaza camino straße strasse str. weg gasse platz allee ufer damm""".split()

GERMAN = {"straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm"}
_NEAR_NUMBER = re.compile(r"\d")

_PLAIN = {0xA0: " ", 0x202F: " ", 0x2007: " ", 0x2009: " ", 0x3000: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0xFF0D: "-", 0x2019: "'", 0x02BC: "'", 0xFF20: "@", 0xFF0E: ".", 0xFF0B: "+"}
_PLAIN |= {0xFF10 + k: chr(48 + k) for k in range(10)} | {0xFF21 + k: chr(65 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_ODD = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
_HIDDEN = "​‌‍⁠﻿­"
_L = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_WORD = rf"{_L}+(?:['-]{_L}+)*"


def _latin(ch: str) -> bool:
    """A letter or digit that a word of this text could go on with; scripts without blanks are no part of it."""
    return ch == "_" or (ch.isalnum() and ch < "⺀")


class View:
    """A text to search in: composed, with plain blanks, hyphens and digits, and where its characters come from."""

    def __init__(self, text: str):
        self.index = None
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            out, index, i = [], [], 0
            while i < len(text):
                j = i + 1
                while j < len(text) and unicodedata.combining(text[j]):
                    j += 1
                piece = unicodedata.normalize("NFC", text[i:j])
                out.append(piece)
                index += [i] * len(piece)
                i = j
            text, self.index = "".join(out), [*index, i]
        self.s = text if text.isascii() else _ODD.sub(lambda m: _PLAIN[ord(m[0])], text)
        low = self.s.lower()
        self.low = low if len(low) == len(self.s) else "".join(c if len(c.lower()) != 1 else c.lower() for c in self.s)

    def place(self, at: int) -> int:
        return at if self.index is None else self.index[at]


# ---- step 1: gazetteers

_BRACKET = re.compile(r"<[^<>\s@]{1,80}@[^<>\s]{3,80}>")
_NAMED = re.compile(rf"(?:^|[:\"'|>(]|\b(?:by|von|par|de|from))\s*((?:{_L}\.? ?|['\-, ]){{3,60}}?)\s*$", re.I)
_TOWN = r"[A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?"
_POSTED = re.compile(rf"\d{{5}} ({_TOWN})(?![\w'])")
_INSIDE = frozenset("0123456789.-/")
_POSTCODE = re.compile(r"[A-Z]{1,2}(?:\d{1,2} \d[A-Z]{2}| \d{5})(?!\w)")
_BEFORE_POSTCODE = re.compile(rf", ({_TOWN}),? $")


def gazetteer_words(text: str) -> set[tuple[str, str]]:
    """(kind, word) of a text: given and family names before a bracketed address, towns beside a postcode."""
    out = set()
    if "@" in text and "<" in text:
        s = View(text).s
        for m in _BRACKET.finditer(s):
            line = max(s.rfind("\n", 0, m.start()) + 1, m.start() - 80)
            n = _NAMED.search(s[line : m.start()])
            if not n:
                continue
            name = re.split(r"\b(?:by|von|par)\b", n[1])[-1].strip()
            family, _, given = name.rpartition(",") if "," in name else (None, "", name)
            given = [w for w in given.split() if w.lower().strip(".") not in TITLES]
            if family is None:
                family = given[1:] and given[-1]
                given = given[:1]
            if given and len(given[0]) > 2 and "." not in given[0] and family and given[0].lower() not in COMMON:
                out.add(("given", given[0].lower()))
            for part in re.split(r"[\s'-]+", (family or "").lower()):
                part = re.sub(r"^(?:mc|mac)(?=\w{4})", "", part)
                if len(part) > 3 and part not in PARTICLES and "." not in part:
                    out.add(("family", part))
    for m in _POSTED.finditer(text):
        if text[m.start() - 1 : m.start()] not in _INSIDE or not m.start():
            out.add(("town", m[1].lower()))
    for m in _POSTCODE.finditer(text):
        if t := _BEFORE_POSTCODE.search(text, max(0, m.start() - 40), m.start()):
            out.add(("town", t[1].lower()))
    return out


def _gazetteer_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        counts: dict[tuple[str, str], int] = {}
        for text in b.column("text"):
            for pair in gazetteer_words(text.as_py() or ""):
                counts[pair] = counts.get(pair, 0) + 1
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in counts], pa.string()), "word": pa.array([w for _, w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def gazetteers(documents: DataFrame) -> dict[str, set[str]]:
    rows = documents.select("text").mapInArrow(_gazetteer_rows, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")).where("n >= 2")
    found: dict[str, set[str]] = {"given": set(GIVEN) | set(AMBIGUOUS), "family": set(), "town": set()}
    for r in rows.select("kind", "word").collect():
        found[r["kind"]].add(r["word"])
    found["family"] -= found["given"] | set(TITLES) | set(COMMON)
    return found


# ---- step 2: candidates and votes

_LOCAL = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ_%+]")
_AT = re.compile(rf"[ {_HIDDEN}]?(?:[(\[{{<] ?(?:at|@) ?[)\]}}>]|@)[ {_HIDDEN}]?| at ", re.I)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.| ?[(\[{{] ?(?:dot|\.) ?[)\]}}] ?| dot ){_LABEL})*", re.I)
_SPELT_AT = re.compile(r" ?[(\[{<] ?at ?[)\]}>] ?| at (?=[A-Za-z0-9-]+ ?(?:[(\[{] ?)?dot\b)", re.I)
_SPELT_DOT = re.compile(r"[(\[{ ]dot[)\]} ]", re.I)
_RUN = re.compile(r"\d(?:[ ().\-/]{0,2}\d){5,}")
_COUNTRY = [("44", 10), ("33", 9), ("49", 10), ("1", 10)]
_G = r"[ .\-/]?"
_FORMS = [
    *[rf"(?:\+|00){c}{_G}(?:\(0\))?(?:{_G}[()]?\d[()]?){{{n}}}" for c, n in _COUNTRY],
    rf"\+[2-9]\d{{1,2}}{_G}(?:\(0\))?(?:{_G}\d){{8,10}}",
    r"\d(?: \d){8,12}",
    rf"\(0\d{{2,4}}\)(?:{_G}\d){{6,8}}",
    r"0[1-9](?P<gap>[ .\-]?)\d\d(?:(?P=gap)\d\d){3}(?![ .\-]?\d)",
    r"0\d{2,4}[ \-/]\d{3,8}(?:[ \-]\d{3,4})?",
    r"0[1-9]\d{8,9}",
    r"(?:\+?1[ .\-])?(?:\([2-9]\d\d\)[ .\-]?|[2-9]\d\d[ .\-])\d{3}[ .\-]\d{4}",
    r"[2-9]\d\d-\d{4}",
]
_PHONE = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<p{k}>{f})" for k, f in enumerate(_FORMS)) + ")")
# A tax number's eleven digits don't begin like a national phone number, with one 0.
_IDS = [
    ("ssn", re.compile(r"\d{3}([-. ]?)\d{2}\1\d{4}")),
    ("ni", re.compile(r"[A-Z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[A-Z]", re.I)),
    ("tax", re.compile(r"(?!0[1-9])\d\d([ /]?)\d{3}\1\d{3}[ ]?\d{3}|\d\d/\d{3}/\d{5,6}")),
    ("nir", re.compile(r"[12]([ .]?)\d\d\1\d\d\1\d[\dAB]\1\d{3}\1\d{3}(?:\1\d\d)?")),
    ("dni", re.compile(r"\d\d([. ]?)\d{3}\1\d{3}[ -]?[A-Z]", re.I)),
    ("pass", re.compile(r"(?:P<)?[A-Z]{1,2} ?\d{3} ?\d{4}|(?:P<)[A-Z]{2,3}\d{5,7}[A-Z]?|[A-Z]\d\d[A-Z]{2}\d{4}|[A-Z]{2}\d{6}[A-Z]")),
]
_MIXED = re.compile(r"[A-Z]\d\d[A-Z]{2}\d{4}")

_NUM = r"\d{1,4} ?[A-Za-z]?(?: (?:bis|ter))?"
_UNIT = r"(?:flat|apt\.?|unit|apartment|appt\.?|app\.|wohnung|suite|\d{1,2}\.º) ?[0-9A-Za-z]{1,4}"
_POST = r"(?:[A-Z]{1,2}\d{1,2} ?\d[A-Z]{2}|(?:[A-Z]{2}[ -])?\d{5})"


def _street_pattern() -> re.Pattern:
    name = r"(?:[^\W\d_][\w'-]* ){1,3}?"
    english = rf"{_NUM},? {name}(?:(?:st|rd|ln|ave|blvd)\b\.?|(?:street|road|row|lane|avenue|close|crescent|court|way|terrace|boulevard|drive|square)\b)"
    french = rf"{_NUM},? (?:rue|avenue|place|boulevard|quai|chemin|allée|impasse) (?:(?:de la|des|du|de|d'|l') ?)?[^\W\d_][\w'-]*(?: (?-i:[A-ZÀ-Þ])[\w'-]*)?"
    german = r"[^\W\d_][^\W\d_-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm) ?\d{1,4} ?[a-z]?\b"
    spanish = r"(?:calle|c/|avda\.?|avenida|paseo|plaza|camino)(?: (?:de las|de los|de la|del|de))? [^\W\d_][\w'-]*(?: [^\W\d_][\w'-]*)?,? \d{1,4} ?[a-z]?\b"
    street = rf"(?:{french}|{english}|{german}|{spanish})"
    return re.compile(rf"(?<![\w.])(?:{_UNIT},? )?{street}(?:, {_UNIT})?(?![A-Za-z0-9])", re.I)


_STREET = _street_pattern()
#: What may follow a street: a town, looked up by its one or two words, with a postcode on either side, and a unit.
_TOWNS = [re.compile(rf"(?:, ?|\s?\n[ >*\-]*){post}([^\W\d_]+)(?!\w)(?: ([^\W\d_]+)(?!\w))?", re.I) for post in (rf"{_POST},? ", "")]
_TOWN_POST = re.compile(rf"(?:,? |, ?\n){_POST}(?![A-Za-z0-9])", re.I)
_LAST_UNIT = re.compile(rf", {_UNIT}(?![A-Za-z0-9])", re.I)


_LEFT = {
    "email": re.compile(r"(?:mail|e-mail|email|contact|kontakt|write|to|cc|from|user|bounced|copie à|copia para|escribir a|ou à|oder|an|for|:|<|=|\"|'|\|)[ :=\"'<(]*$", re.I),
    "phone": re.compile(r"(?:call|tel|tel\.|phone|telephone|mobile|ring|whatsapp|fax|au|al|oder|or|ruf|anrufen|電話は|tel:|signal)[ :=\"'(\]]*$", re.I),
    "id_number": re.compile(r"(?:ssn|social|number|insurance|steuer-id|tax id|tax|passport|no\.|dni|nie|nif|\bid|sociale|card|nummer|ausweis)[ :=\"'(]*$", re.I),
    "street_address": re.compile(r"(?:at|address|habite|wohnt|in|vive en|au|an|home|from|to|,)[ :=\"'(]*$", re.I),
    "person_name": re.compile(r"(?:\b(?:from|by|owner|assignee|holder|name|with|thanks|hi|hello|hey|dear|hola|hallo|bonjour|ask for|ask|ring|says|for|von|par|de|bitte|contacter|llamar a|demander|avisar a|zu händen|attendees|present|met|and|could|add|told|to|card|mme|frau|herr|mrs?|ms|mx|dr|prof|sra?|m|archive|regards|wishes|grüße|was|is from)|todo\(|[|\[(,:>])[.:, ]*[\"'(\[|*_\- ]*$", re.I),
}
_CALLED = re.compile(r"\b(?:mr|mrs|ms|mx|dr|prof|herr|frau|mme|sra?|thanks|hi|hello|hey|dear|hola|hallo|bonjour|could|ask for|ring|avisar a|demander|zu händen|todo\(|owner:|present:|attendees:)\.? ?$", re.I)
_RIGHT = {
    "email": re.compile(r"(?![A-Za-z0-9@:/_-])"),
    "phone": re.compile(r"(?: or |,|\.|\"|'|\)|\n| and| oder | ou | o |まで|$| \|| ext| x\d| \()", re.I),
    "id_number": re.compile(r"(?: \(| \||\"|,|;| in | and | or |\.|$)", re.I),
    "street_address": re.compile(r"(?:,|\.|\"|'|\n| on | to | and |$)", re.I),
    "person_name": re.compile(r"(?:'s\b|\]\]| signed| <| \(| will | and | travels| habite| wohnt| hat | con |, con|, born| look at| ran | says| fragen|さん| am | added|,|!|\.|\"|\)| \||\n|$| about| moved|;| au | al | to the| has | asked| for the)", re.I),
}
_AGAINST = {
    "phone": re.compile(r"\b(?:page numbers|offsets?|list|build|version|rows?|fixture|ticket|isbn|size|scan|md5|port|code|probe|shelf|commit|run|between|retry|v\d|id|ssn|social|tax|steuer|sociale|insurance|dni)\W*(?:[\w.]+\W+)?$", re.I),
    "id_number": re.compile(r"\b(?:page numbers|offsets?|list|build|version|rows?|fixture|ticket|isbn|size|scan|md5|port|code|probe|shelf|commit|run|call|tel|phone|ring|whatsapp)\W*(?:[\w.]+\W+)?$", re.I),
}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]\d\d[-/.]\d\d$|\d\d[/.]\d\d[/.](?:19|20)\d\d$")
_NETWORK = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}$")


class Finder:
    """Candidates of a text with votes and features."""

    def __init__(self, words: dict[str, set[str]]):
        self.given, self.family, self.town = words["given"], words["family"], words["town"]
        # Beginnings and endings that several family names share make others likely.
        heads, tails = {}, {}
        for w in self.family:
            heads[w[:3]] = heads.get(w[:3], 0) + 1
            for k in (2, 3):
                tails[w[-k:]] = tails.get(w[-k:], 0) + 1
        self.heads, self.tails = {k for k, n in heads.items() if n > 2}, {k for k, n in tails.items() if n > 2}
        self.town_sizes = {len(w) for w in self.town}
        self.auto = ahocorasick.Automaton()
        kinds: dict[str, int] = {}
        for bit, group in ((1, self.given), (2, self.family), (4, STREETS), (8, TITLES), (16, ["@", "&#64;", "&#x40;", "&commat;", "%40"])):
            for w in group:
                kinds[w] = kinds.get(w, 0) | bit
        for w, k in kinds.items():
            self.auto.add_word(w, (len(w), k))
        self.auto.make_automaton()

    forms = [f"p{k}" for k in range(len(_FORMS))]

    # -- names

    def is_family(self, word: str) -> bool:
        for part in re.split(r"['-]", word.lower()):
            part = re.sub(r"^(?:mc|mac)(?=\w{4})", "", part)
            if part in self.family or (len(part) > 4 and part[:3] in self.heads and (part[-3:] in self.tails or part[-2:] in self.tails) and part not in self.given):
                return True
        return False

    _PART = "|".join(PARTICLES)
    _FOLLOW = re.compile(rf"((?: {{1,2}}[A-ZÀ-Þ]\.)*)((?: {{1,2}}(?:{_PART})\b)*)(?: {{1,2}}|-)((?:al-)?{_WORD})", re.I)
    _INITIALS = re.compile(r"(?: {1,2}[A-ZÀ-Þ]\.)+")
    _LEFT_INITIALS = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_.])((?:(?-i:[A-ZÀ-Þ])\.(?: {{0,2}}|-))+(?:(?:{_PART}) {{1,2}})*(?:al-)?)$", re.I)
    _LEFT_WORD = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_.@/`-])({_WORD}) {{1,2}}((?:(?:{_PART}) {{1,2}})*)$", re.I)
    _LEFT_PARTICLES = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_.@/`-])((?:(?:{_PART}) {{1,2}})+)$", re.I)
    _TURNED = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_.@/`-])((?:(?:{_PART}) {{1,2}})*)({_WORD}), {{1,2}}$", re.I)
    _BEFORE = re.compile(rf"({_WORD}|(?<![A-Za-zÀ-ɏ])[A-Za-z]\.) {{0,2}}$")
    _COMMA = re.compile(rf", {{1,2}}({_WORD})")

    _INITIAL = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_.])[A-ZÀ-Þ]\.(?: {{0,2}}|-)(?=[A-Za-zÀ-ɏ])(?:(?:{_PART}) {{1,2}})*(?:al-)?({_WORD})")
    #: A particle behind one of these is a preposition.
    _OF = re.compile(r"\b(?:acta|angelegt|erstellt|geschrieben|mail|anruf|note|nota|copia|lettre)\s+$", re.I)

    def tail(self, s: str, at: int) -> tuple[int, bool]:
        """Where a name goes on to after a given name, and whether that is a family name."""
        m = self._FOLLOW.match(s, at)
        if m and self.is_family(m[3]) and (m[3][0].isupper() or s[at - 1].islower()):
            return (m.end() - 2 if m[3].lower().endswith("'s") else m.end()), True
        m = self._INITIALS.match(s, at)
        return (m.end() if m else at), False

    def names(self, s: str, tokens: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, bool]]:
        out, past = [], 0
        for a, b, kind in tokens:
            if a < past:
                continue
            given, family, start, end = bool(kind & 1), bool(kind & 2), a, b
            if given:
                end, more = self.tail(s, b)
                family |= more
                m = None if more else self._TURNED.search(s, max(past, a - 45), a)
                if m and m[1] and self._OF.search(s, max(0, m.start() - 16), m.start()):
                    m = self._TURNED.search(s, m.start(2), a)
                if m and self.is_family(m[2]) and m[2].removeprefix("al-")[0].isupper() == s[a].isupper():
                    w = self._BEFORE.search(s, max(0, m.start() - 24), m.start())
                    if not (w and (w[1].lower() in self.given or w[1].endswith("."))) or m[1]:
                        start, family = m.start(), True
            else:
                m = self._COMMA.match(s, b)
                other = m[1].removesuffix("'s") if m else ""
                turned = other.lower() in self.given and other[0].isupper() == s[a].isupper()
                if turned:
                    to, more = self.tail(s, m.start(1) + len(other))
                    turned = not more
                initials = self._LEFT_INITIALS.search(s, max(past, a - 24), a)
                if initials:
                    start = initials.start()
                elif turned:
                    end, given = to, True
                    if (p := self._LEFT_PARTICLES.search(s, max(past, a - 24), a)) and not self._OF.search(s, max(0, p.start() - 16), p.start()):
                        start = p.start()
                elif (m := self._LEFT_WORD.search(s, max(past, a - 40), a)) and self._unknown_given(s, m):
                    start = m.start()
            past = end
            out.append((start, end, given, family))
        return out

    def _unknown_given(self, s: str, m) -> bool:
        word = m[1]
        return len(word) > 2 and word.lower() not in TITLES and word[0].isupper() and word.lower() not in COMMON

    # -- all

    def candidates(self, text: str) -> list[tuple[str, int, int, int, str, list[int]]]:
        """(type, start, end, cluster, votes, features); clusters of overlapping candidates are numbered."""
        v = View(text)
        s, low = v.s, v.low
        found: list[tuple[str, int, int, list[int], list[str]]] = []
        ats, streets, tokens = [], [], []
        n = len(s)
        for last, (size, kind) in self.auto.iter(low):
            a, b = last - size + 1, last + 1
            if kind & 16:
                ats.append((a, b))
                continue
            if b < n and _latin(s[b]) and low[b - 1] not in "./":
                continue
            if kind & 4:
                if (not a or not _latin(s[a - 1]) or low[a:b] in GERMAN) and _NEAR_NUMBER.search(s, max(0, a - 48), b + 40):
                    streets.append(a)
                if kind == 4:
                    continue
            if a and _latin(s[a - 1]) or kind == 8:
                continue
            if kind & 3:
                # to the whole of a word with hyphens and apostrophes
                while a > 1 and s[a - 1] in "'-" and s[a - 2].isalpha() and s[a - 2] < "⺀":
                    a -= 2
                    while a and s[a - 1].isalpha() and s[a - 1] < "⺀":
                        a -= 1
                while b + 1 < n and s[b] in "'-" and s[b + 1].isalpha() and s[b + 1 : b + 3] not in ("s ", "s.", "s,", "s"):
                    b += 2
                    while b < n and s[b].isalpha() and s[b] < "⺀":
                        b += 1
                if tokens and tokens[-1][1] > a:
                    p = tokens.pop()
                    a, b, kind = min(a, p[0]), max(b, p[1]), kind | p[2]
                tokens.append((a, b, kind))
        for m in self._INITIAL.finditer(s):
            word = m[1].removesuffix("'s")
            if self.is_family(word):
                tokens.append((m.start(1), m.start(1) + len(word), 2))
        tokens.sort()
        taken = self.emails(s, low, ats, found)
        self.streets(s, streets, found)
        self.digits(s, found)
        self.persons(v, tokens, taken, found)
        found.sort(key=lambda c: (c[1], -c[2]))
        out, cluster, reach = [], -1, -1
        for kind, a, b, votes, features in found:
            if a >= reach:
                cluster += 1
            reach = max(reach, b)
            out.append((kind, v.place(a), v.place(b), cluster, "".join("-0+"[x + 1] for x in votes), self.hashed(kind, s, a, b, votes, features)))
        return out

    @staticmethod
    def local_start(s: str, at: int) -> int:
        """Where the local part that ends before `at` begins, however long: runs of its characters joined by single marks."""
        a = at
        while a and (_LOCAL.match(s, a - 1) or (s[a - 1] in ".-'" and a < at and a > 1 and s[a] not in ".-'" and _LOCAL.match(s, a - 2))):
            a -= 1
        return a

    def emails(self, s, low, ats, found) -> list[tuple[int, int]]:
        taken = []
        spots = [(m.start(), m.end()) for m in _SPELT_AT.finditer(s)] if _SPELT_DOT.search(s) or "(at)" in low or "[at]" in low else []
        for lo, hi in ats:
            if lo and s[lo - 1] in "([{" and s[hi : hi + 1] and s[hi] in ")]}":
                lo, hi = lo - 1, hi + 1
            if lo and (s[lo - 1] == " " or s[lo - 1] in _HIDDEN):
                lo -= 1
            if s[hi : hi + 1] == " " or (s[hi : hi + 1] and s[hi : hi + 1] in _HIDDEN):
                hi += 1
            spots.append((lo, hi))
        for lo, hi in spots:
            start, right = self.local_start(s, lo), _DOMAIN.match(s, hi)
            if start == lo or not right:
                continue
            local, domain = s[start:lo], right[0]
            b = right.end()
            dots = len(re.findall(r"\.|\bdot\b", domain, re.I))
            if not dots:
                continue
            spaced = s[lo:hi] != "@"
            top = re.split(r"[^A-Za-z0-9]+", domain)[-1]
            words = re.split(r"[^a-zà-ÿ]+", local.lower())
            votes = [
                1 if dots and top.isalpha() and len(top) > 1 else -1,
                -1 if s[b : b + 1] == ":" and s[b + 1 : b + 2].strip() or local.lower() == "git" else 0,
                -1 if re.fullmatch(r"[\d.]+", domain) or (start and s[start - 1] in "@/") else 0,
                1 if _LEFT["email"].search(s, max(0, start - 24), start) else 0,
                1 if any(w in self.given or w in self.family for w in words) else 0,
                1 if _RIGHT["email"].match(s, b) else -1,
                -1 if spaced and not dots else 0,
            ]
            found.append(("email", start, b, votes, ["top=" + top.lower(), f"spaced={spaced}"]))
            if votes[0] > 0 and min(votes[1:3]) == 0:
                taken.append((start, b))
        return sorted(taken)

    def addresses(self, s: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Streets within [lo, hi), each with the town and postcode behind it."""
        while m := _STREET.search(s, lo, hi):
            lo = self.past_town(s, m.end(), hi)
            if u := _LAST_UNIT.match(s, lo, hi):
                lo = u.end()
            yield m.start(), lo

    def past_town(self, s: str, at: int, hi: int) -> int:
        for form in _TOWNS:
            if m := form.match(s, at, hi):
                words = 2 if m[2] and f"{m[1]} {m[2]}".lower() in self.town else 1 if m[1].lower() in self.town else 0
                if words:
                    p = _TOWN_POST.match(s, m.end(words), hi)
                    return p.end() if p else m.end(words)
        return at

    def streets(self, s, spots, found) -> None:
        past = 0
        for a in spots:
            if a < past:
                continue
            for x, y in self.addresses(s, max(past, a - 60), min(len(s), a + 110)):
                t = s[x:y]
                while s[y - 1] in " ,":
                    y -= 1
                ended = t.lower().rstrip(" .0123456789")
                town = any(ended[-k:] in self.town for k in self.town_sizes) or bool(re.search(_POST + r"$", t))
                votes = [
                    1 if re.match(r"(?i)(?:flat|apt|unit|\d)", t) or re.search(r"\d", t) else -1,
                    1 if town else 0,
                    1 if re.search(_POST, t) else 0,
                    1 if _LEFT["street_address"].search(s, max(0, x - 24), x) else 0,
                    1 if _RIGHT["street_address"].match(s, y) else 0,
                        1 if re.search(_UNIT, t, re.I) else 0,
                ]
                found.append(("street_address", x, y, votes, ["kind=" + re.sub(r"\d+", "9", t.lower())[-8:]]))
                past = max(past, y)

    def digits(self, s, found) -> None:
        spots = [(m.start(), m.end()) for m in _RUN.finditer(s)]
        mixed = [(m.start(), m.end()) for m in _MIXED.finditer(s)]
        for a, b in spots:
            if _DATE.match(s[a:b]) or _NETWORK.match(s[a:b]):
                continue
            lo, hi = max(0, a - 5), min(len(s), b + 4)
            seen: set[tuple[str, int, int]] = set()
            for m in _PHONE.finditer(s, lo, hi):
                form = next(k for k in self.forms if m[k] is not None)
                self.number("phone", form, s, m.start(), m.end(), seen, found)
            for name, pattern in _IDS:
                at = lo
                while m := pattern.search(s, at, hi):
                    at = m.start() + 1
                    if self.number("id_number", name, s, m.start(), m.end(), seen, found):
                        at = m.end()
        for a, b in mixed:
            self.number("id_number", "pass", s, a, b, set(), found)

    def number(self, kind, form, s, a, b, seen, found) -> bool:
        before, after = s[a - 1] if a else " ", s[b] if b < len(s) else " "
        if before < "⺀" and (before.isalnum() or before in "_.+" or (before in "-/(" and s[a - 2 : a - 1].isalnum() and before != "(")) or after < "⺀" and (after.isalnum() or after == "_"):
            return False
        if after in ".-/:" and s[b + 1 : b + 2].isdigit() or (kind, a, b) in seen:
            return False
        seen.add((kind, a, b))
        if s[b - 1] == ")" and s.count("(", a, b) < s.count(")", a, b):
            b -= 1
        t, left = s[a:b], s[max(0, a - 36) : a]
        count = sum(c.isdigit() for c in t)
        if kind == "phone" and re.match(r"\(?0[1-9]", t) and count not in (10, 11):
            return False
        against = bool(_AGAINST[kind].search(left))
        strong = {"p0", "p1", "p2", "p3", "p4", "p5", "p6"} if kind == "phone" else {"ni", "nir", "dni"}
        votes = [
            1 if form in strong else 0,
            1 if _LEFT[kind].search(left) else 0,
            -1 if against else 0,
            1 if _RIGHT[kind].match(s, b) else -1 if kind == "id_number" else 0,
            1 if kind == "phone" and (t.startswith(("+", "(0")) or re.match(r"0[1-9]", t)) and 10 <= count <= 14 else 1 if kind == "id_number" and re.search(r"[A-Za-z]", t) else 0,
            -1 if kind == "phone" and (t.startswith("00") and count < 12 or before == "#") or re.match(r"\d{1,3}(?:\.\d+){2,}$", t) and against else 0,
        ]
        found.append((kind, a, b, votes, ["form=" + form, f"count={count}", "shape=" + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", t))[:16]]))
        return True

    def persons(self, v, tokens, taken, found) -> None:
        s, k = v.s, 0
        free = []
        for t in tokens:
            while k < len(taken) and taken[k][1] <= t[0]:
                k += 1
            if not (k < len(taken) and taken[k][0] < t[1]):
                free.append(t)
        for a, b, given, family in self.names(s, free):
            t = s[a:b]
            words = re.findall(_L + "+", t)
            single = len(words) == 1
            lower = t.islower()
            first = words[0].lower()
            vague = single and first in AMBIGUOUS
            called = bool(_CALLED.search(s[max(0, a - 24) : a]))
            left = s[max(0, a - 30) : a]
            cue = bool(_LEFT["person_name"].search(left))
            before, after = s[a - 1] if a else " ", s[b] if b < len(s) else " "
            if single and (lower and (vague or before in "-_/.#=" or after in "-_/(.=" and s[b + 1 : b + 2].isalnum()) or after == "@"):
                continue
            code = before in "/_.@#`\\" or after in "/_@`\\" or (after in ".=" and s[b + 1 : b + 2].isalnum()) or (before == "-" and a > 1 and s[a - 2].isalnum())
            dated = bool(re.search(r"\d (?:de )?$", left)) and single
            votes = [
                1 if given and not vague else 0,
                1 if family else 0,
                1 if cue else 0,
                1 if _RIGHT["person_name"].match(s, b) else 0,
                1 if len(words) > 1 else 0,
                -1 if vague and (not cue or re.match(r" (?:the|and|be|check|not|have|a|an|to|this|it|of|moved|at|on|\d)\b", s[b : b + 10])) else 0,
                -1 if lower and single else 0,
                -1 if code else 0,
                -1 if dated else 0,
                -1 if not given and single else 0,
                1 if called else -1 if vague else 0,
            ]
            found.append((VAGUE if vague else "person_name", a, b, votes, ["tail=" + words[-1].lower()[-3:], "shape=" + re.sub(r"[a-zß-ÿ]+", "x", re.sub(r"[A-ZÀ-Þ]+", "X", t))[:12], f"vague={vague}"]))

    @staticmethod
    def hashed(kind, s, a, b, votes, features) -> list[int]:
        left, right = _PIECES.findall(s, max(0, a - 28), a)[-2:], _PIECES.findall(s, b, b + 28)[:2]
        words = [f"{side}{i}={'9' * w.isdigit() or w.lower()}" for side, ws in (("l", left[::-1]), ("r", right)) for i, w in enumerate(ws)]
        crc = zlib.crc32(kind.encode())
        given = ["pattern=" + "".join("-0+"[x + 1] for x in votes), *[f"v{i}={x}" for i, x in enumerate(votes) if x], *features]
        # The word on either side comes first, so cues are found there.
        beside = [f"l0={left[-1].lower()}" if left else "l0", f"r0={right[0].lower()}" if right else "r0"]
        return [zlib.crc32(w.encode(), crc) % FEATURES for w in (*beside, *words, *given)]


_PIECES = re.compile(r"\w+|[^\w\s]")

# Frequent words that start sentences of several languages and so look like a given name before a family name.
COMMON = """the a an and or but if in on at to of for from by with since after before between when where what who which this that these those it is are was were be has have had
we you they he she his her our your their my me us please note notes hi hello dear regards thanks kind best see also there here over under every most two three one all any some
der die das ein eine und oder wenn nach vor seit für bitte hallo von zu mit auf le la les un une des et ou si depuis après avant pour bonjour voir par el los las una y o desde
antes para hola ver por al del signed reviewed reported edited owner assignee attendees present cc re fw subject date mail tel phone id""".split()

_FOUND = pa.schema([("doc_id", pa.int64()), ("pii_type", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("cluster", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])


def candidates(documents: DataFrame, words: dict[str, set[str]]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        # Clusters are numbered for all rows, so rows with one doc_id keep theirs apart.
        past = TaskContext.get().partitionId() << 40
        for b in parts:
            rows: list[list] = [[] for _ in _FOUND]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                most = -1
                for kind, a, z, cluster, *rest in finder.candidates(text.as_py() or ""):
                    most = max(most, cluster)
                    for column, value in zip(rows, (doc, kind, a, z, past + cluster, *rest), strict=True):
                        column.append(value)
                past += most + 1
            yield pa.RecordBatch.from_arrays([pa.array(r, t.type) for r, t in zip(rows, _FOUND, strict=True)], schema=_FOUND)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, pii_type string, start_char bigint, end_char bigint, cluster bigint, votes string, features array<int>")


# ---- steps 3 and 4


def reliabilities(patterns: dict[str, int], rounds: int = 40) -> dict[str, float]:
    """How likely each vote pattern is real: expectation-maximisation of the labelers' rates of voting for, against or not, under
    either truth. A labeler may prove useless, but not worse than chance."""
    names = sorted(patterns)
    votes = np.array([["-0+".index(c) for c in p] for p in names])
    weight = np.array([patterns[p] for p in names], float)
    sure = 1 / (1 + np.exp(-(votes - 1).sum(1) * 1.5 + 0.5))
    for _ in range(rounds):
        real, other = weight * sure, weight * (1 - sure)
        share = np.clip(real.sum() / weight.sum(), 0.02, 0.98)
        odds = np.full(len(names), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            p = np.array([[(w[votes[:, j] == c].sum() + 1) / (w.sum() + 3) for c in range(3)] for w in (real, other)])
            gain = np.log(p[0] / p[1])
            # Not to vote says nothing.
            gain = np.array([np.clip(gain[0], -4, -0.2), 0.0, np.clip(gain[2], 0.2, 4)])
            odds += gain[votes[:, j]]
        sure = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(names, sure.tolist(), strict=True))


def train(features: list[list[int]], labels: list[float], rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression on sets of features, by full-batch Adam; the last is the constant's."""
    weights = np.zeros(FEATURES + 1)
    if not features:
        return weights
    row = np.repeat(np.arange(len(features)), [len(f) + 1 for f in features])
    column = np.concatenate([np.array([*f, FEATURES]) for f in features])
    y, m, v = np.array(labels), np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[column], len(features)), -30, 30)))
        g = np.bincount(column, (p - y)[row], FEATURES + 1) / len(features) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def _patterns(found: DataFrame) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in found.groupBy("pii_type", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r["pii_type"], {})[r["votes"]] = r["n"]
    return out


def cues(found: DataFrame, sure: dict[str, dict[str, float]]) -> dict[tuple[str, int], dict[int, int]]:
    """(type, side) -> word -> 1 or -1: the words beside all candidates that go with likely or unlikely ones. At most FEATURES words
    of a type and side come to the driver."""
    known = found.sparkSession.createDataFrame([(t, v, p) for t, of in sure.items() for v, p in of.items()], "pii_type string, votes string, sure double")
    rows = found.join(F.broadcast(known), ["pii_type", "votes"])
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.get("features", F.lit(i)).alias("word")) for i in (0, 1)])).alias("w")
    counts = rows.select("pii_type", "sure", sides).groupBy("pii_type", "w.side", "w.word").agg(F.count(F.lit(1)).alias("n"), F.sum("sure").alias("real"))
    base: dict[tuple[str, int], list[float]] = {}
    words = counts.collect()
    for r in words:
        total = base.setdefault((r["pii_type"], r["side"]), [0.0, 0.0])
        total[0] += r["n"]
        total[1] += r["real"]
    odds = lambda n, real: np.log((real + 1) / (n - real + 1))
    out: dict[tuple[str, int], dict[int, int]] = {k: {} for k in base}
    for r in words:
        k = (r["pii_type"], r["side"])
        shift = odds(r["n"], r["real"]) - odds(*base[k])
        # For or against: most of what it stands beside is likely or not, and more of it than elsewhere.
        likely = r["real"] >= r["n"] / 2
        if r["n"] >= CUE_TIMES and (shift >= CUE_ODDS if likely else shift <= -CUE_ODDS):
            out[k][r["word"]] = 1 if likely else -1
    return out


def _with_cues(found: DataFrame, learnt: dict[tuple[str, int], dict[int, int]]) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(learnt)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            features = b.column("features")
            at, flat = features.offsets.to_numpy()[:-1], features.values.to_numpy()
            votes = b.column("votes").to_pylist()
            kinds = b.column("pii_type").to_pylist()
            for side in (0, 1):
                votes = [v + "-0+"[shared.value.get((t, side), {}).get(w, 0) + 1] for v, t, w in zip(votes, kinds, flat[at + side].tolist() if len(at) else [], strict=True)]
            yield b.set_column(b.schema.get_field_index("votes"), "votes", pa.array(votes, pa.string()))

    return found.mapInArrow(run, found.schema)


def items(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_char, end_char) of every item."""
    found = written(candidates(documents, gazetteers(documents))).df
    learnt = cues(found, {t: reliabilities(p) for t, p in _patterns(found).items()})
    found = written(_with_cues(found, learnt)).df
    patterns = _patterns(found)
    sure = {t: reliabilities(p) for t, p in patterns.items()}
    share = {t: min(1.0, TRAIN / sum(p.values())) for t, p in patterns.items()}
    weights = {}
    if patterns:
        limit = F.element_at(F.create_map(*[F.lit(x) for t, q in share.items() for x in (t, int(q * 1_000_000))]), F.col("pii_type"))
        drawn = found.where(F.pmod(F.xxhash64("doc_id", "start_char"), F.lit(1_000_000)) < limit).select("pii_type", "votes", "features")
        sample: dict[str, tuple[list, list]] = {t: ([], []) for t in patterns}
        for r in drawn.toLocalIterator():
            sample[r["pii_type"]][0].append(r["features"])
            sample[r["pii_type"]][1].append(sure[r["pii_type"]][r["votes"]])
        weights = {t: train(*x) for t, x in sample.items()}
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        number = {t: i for i, t in enumerate(sorted(weights))}
        table = np.array([weights[t] for t in sorted(weights)])
        for b in parts:
            if not b.num_rows:
                continue
            row = np.array([number[k] for k in b.column("pii_type").to_pylist()])
            size = b.column("features").value_lengths().to_numpy()
            part = table[np.repeat(row, size), b.column("features").flatten().to_numpy()]
            learnt = np.bincount(np.repeat(np.arange(len(row)), size), part, len(row)) + table[row, -1]
            out = 1 / (1 + np.exp(-np.clip(learnt, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "pii_type", "start_char", "end_char", "cluster")), pa.array(out, pa.float64())], ["doc_id", "pii_type", "start_char", "end_char", "cluster", "sure"])

    scored = found.mapInArrow(score, "doc_id bigint, pii_type string, start_char bigint, end_char bigint, cluster bigint, sure double").where(F.col("sure") >= LIKELY)
    # Of a cluster the likeliest, then the longest, then the next that overlaps none kept.
    one = F.struct((-F.round("sure", 2)).alias("a"), (F.col("start_char") - F.col("end_char")).alias("b"), (-F.col("sure")).alias("c"), "pii_type", "start_char", "end_char")
    listed = scored.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(one)).alias("of"))
    meets = lambda x, y: (x["start_char"] < y["end_char"]) & (y["start_char"] < x["end_char"])
    kept = F.aggregate(F.slice("of", 2, F.size("of")), F.slice("of", 1, 1), lambda done, x: F.when(F.exists(done, lambda y: meets(x, y)), done).otherwise(F.concat(done, F.array(x))))
    kept = F.when(F.size("of") == 1, F.col("of")).otherwise(kept)
    return listed.select("doc_id", F.explode(kept).alias("x")).select("doc_id", F.rtrim(F.col("x.pii_type"), F.lit("?")).alias("pii_type"), "x.start_char", "x.end_char")


def redacted(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, items): each text with [TYPE] in place of its items."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("spans"))
    joined = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    walk = F.aggregate(
        F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)),
        empty,
        lambda acc, x: F.struct(
            F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start_char"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["pii_type"]), F.lit("]")).alias("done"),
            x["end_char"].alias("at"),
        ),
    )
    joined = joined.withColumn("walk", walk)
    rest = F.expr("substring(text, cast(walk.at + 1 as int))")
    return joined.select("doc_id", F.when(F.col("text").isNotNull(), F.concat("walk.done", rest)).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("items"))
