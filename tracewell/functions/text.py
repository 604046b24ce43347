"""Text columns: Markdown syntax, tokens, hashes and similarity, as built-in expressions that stay in the JVM.

Null stays null unless said otherwise. Regexes are written so that Java's and RE2's dialects agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, shared with the SQL that checks them.
FRONTMATTER = r"\A\x{FEFF}?---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)"
FENCED = r"(?:```[\s\S]*?(?:```|\z)|~~~[\s\S]*?(?:~~~|\z))"
INLINE_CODE = r"`[^`\n]*`"
HASHTAG = r"(?:^|[\s(])#([\p{L}\p{N}_][\p{L}\p{N}_/-]*)"
WIKILINK = r"!?\[\[[^\[\]\n]+\]\]"
MDLINK = r"\[[^\[\]\n]*\]\([^()\s]+\)"
PROPERTY = r"(?m)^[ \t]*[-*]?[ \t]*([\p{L}][\p{L}\p{N} _-]{0,40})::[ \t]*([^\n\r]+)"
HEADING = r"(?m)^(#{1,6})[ \t]+([^\n\r]*?)[ \t]*#*[ \t]*\r?$"
BLOCK_ID = r"(?m)(?:^|[ \t])\^([A-Za-z0-9-]+)[ \t]*\r?$"
DATE = r"\b((?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b"


def slug(heading: Column) -> Column:
    """Lower case, runs of what is no letter or digit become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")


def web_slug(heading: Column) -> Column:
    """Lower case, punctuation dropped, each blank a dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}_ -]", ""), " ", "-")


def heading_key(heading: Column) -> Column:
    """As headings are matched: lower case, punctuation a blank, blanks once."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}]", " "), " +", " "))


def frontmatter(text: Column) -> Column:
    """The block between the leading --- lines; '' if there is none."""
    return F.regexp_extract(text, FRONTMATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def without_code(text: Column) -> Column:
    """Without frontmatter, fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(body(text), FENCED, " "), INLINE_CODE, " ")


def front_value(text: Column, key: str) -> Column:
    """The written value of a frontmatter key; '' if there is none."""
    return F.regexp_extract(frontmatter(text), rf"(?m)^{key}:[ \t]*([^\n\r]*?)[ \t]*\r?$", 1)


_UNQUOTED = r"""^(["'])(.*)\1$"""
_FRONT_KEY = r"""(?m)^["']?([\p{L}\p{N}_][^:\n\r"']*?)["']?[ \t]*:[ \t]*([^\n\r]*?)[ \t]*\r?$((?:\r?\n[ \t]*-[ \t]+[^\n\r]*)*)"""
_ITEM = r"""("[^"]*"|'[^']*'|\[\[[^\[\]]*\]\]|[^,\s][^,]*)"""


def front_properties(text: Column) -> Column:
    """array<struct<key, values>> of all top-level frontmatter keys with a value: a scalar is one value, a list its items, without
    quotes. Of repeated keys the first holds."""
    front = frontmatter(text)
    found = F.arrays_zip(*[F.regexp_extract_all(front, F.lit(_FRONT_KEY), k).alias(c) for k, c in ((1, "key"), (2, "value"), (3, "block"))])

    def values(p: Column) -> Column:
        inner = F.regexp_extract(p["value"], r"^\[(?!\[)(.*)\]$", 1)
        block = F.regexp_extract_all(p["block"], F.lit(r"\n[ \t]*-[ \t]+([^\n\r]*)"), 1)
        raw = F.when(inner != "", F.regexp_extract_all(inner, F.lit(_ITEM), 1)).when(p["value"] == "[]", F.array().cast("array<string>")).when(p["value"] == "", block).otherwise(F.array(p["value"]))
        return F.filter(F.transform(raw, lambda v: F.regexp_replace(F.trim(v), _UNQUOTED, "$2")), lambda v: v != "")

    keys = F.transform(found, lambda p: p["key"])
    firsts = F.filter(found, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.filter(F.transform(firsts, lambda p: F.struct(p["key"].alias("key"), values(p).alias("values"))), lambda p: F.size(p["values"]) > 0)


def front_tags(text: Column) -> Column:
    raw = F.regexp_replace(front_value(text, "tags"), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(raw, ","), lambda t: normal_tag(F.regexp_replace(t, "[\"']", ""))), lambda t: t != "")


def normal_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(tag), "^#+", ""))


def hashtags(text: Column) -> Column:
    """Tags written in the text outside code and frontmatter, with a letter in them, in order of first appearance."""
    found = F.regexp_extract_all(without_code(text), F.lit(HASHTAG), 1)
    return F.array_distinct(F.filter(F.transform(found, normal_tag), lambda t: t.rlike(r"\p{L}")))


def all_tags(text: Column) -> Column:
    return F.array_distinct(F.concat(front_tags(text), hashtags(text)))


def has_tag(tags: Column, wanted: str) -> Column:
    """Hierarchical: a matches a and a/b."""
    wanted = wanted.strip().lstrip("#").lower()
    return F.exists(tags, lambda t: (t == wanted) | t.startswith(wanted + "/"))


def tag_prefixes(tag: Column) -> Column:
    """a/b/c: a, a/b, a/b/c."""
    steps = F.split(tag, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))


def wikilinks(text: Column) -> Column:
    """array<struct<target, heading, block, alias, embed>> of the links outside code, in order."""
    found = F.regexp_extract_all(without_code(text), F.lit(f"({WIKILINK})"), 1)

    def parts(link: Column) -> Column:
        inner = F.regexp_extract(link, r"\[\[([^\[\]\n]+)\]\]", 1)
        spot = F.regexp_extract(inner, r"^([^|]*)", 1)
        anchor = F.regexp_extract(spot, r"#(.*)$", 1)
        return F.struct(
            F.trim(F.regexp_extract(spot, r"^([^#]*)", 1)).alias("target"),
            F.when(anchor.startswith("^"), "").otherwise(F.trim(anchor)).alias("heading"),
            F.when(anchor.startswith("^"), F.trim(F.substring(anchor, 2, 1000))).otherwise("").alias("block"),
            F.trim(F.regexp_extract(inner, r"\|(.*)$", 1)).alias("alias"),
            link.startswith("!").alias("embed"),
        )

    return F.transform(found, parts)


def markdown_links(text: Column) -> Column:
    """array<struct<label, href>> of inline links outside code."""
    found = F.regexp_extract_all(without_code(text), F.lit(f"({MDLINK})"), 1)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^\[([^\[\]\n]*)\]", 1).alias("label"), F.regexp_extract(m, r"\(([^()\s]+)\)$", 1).alias("href")))


def inline_properties(text: Column) -> Column:
    """array<struct<key, value>> of `Key:: value` lines outside code."""
    clean = without_code(text)
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(clean, F.lit(PROPERTY), 1).alias("k"), F.regexp_extract_all(clean, F.lit(PROPERTY), 2).alias("v")),
        lambda p: F.struct(F.lower(F.trim(p["k"])).alias("key"), F.trim(p["v"]).alias("value")),
    )


def headings(text: Column) -> Column:
    """array<struct<level, heading>> of the ATX headings outside fences."""
    clean = F.regexp_replace(body(text), FENCED, " ")
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(HEADING), 1).alias("h"), F.regexp_extract_all(clean, F.lit(HEADING), 2).alias("t"))
    return F.transform(pairs, lambda p: F.struct(F.length(p["h"]).alias("level"), F.trim(p["t"]).alias("heading")))


def block_id(line: Column) -> Column:
    return F.regexp_extract(line, BLOCK_ID, 1)


def split_overlap(text: Column, size: int, overlap: int) -> Column:
    """Windows of so many code points, each sharing the overlap with the one before; a text that fits is one window."""
    overlap = max(0, overlap)
    if overlap >= size:
        overlap = size // 5
    step, n = size - overlap, F.length(text)
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, cut where a capital follows a small letter, of two bytes at least, in lower case."""
    cut = F.lower(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    return F.regexp_extract_all(cut, F.lit(r"([\p{L}\p{Nd}]{2,}|[\p{L}\p{Nd}&&[^\x00-\x7F]])"), 1)


# Groups of words that stand for each other.
WORD_GROUPS = {
    **dict.fromkeys(["embedded", "embedding", "embeddings", "embedder", "embedders"], ["embed", "embedded", "embedding", "embeddings"]),
    "embed": ["embedded", "embedding", "embeddings"],
    **dict.fromkeys(["note", "notes"], ["note", "notes"]),
    **dict.fromkeys(["indexed", "indexing", "indexes"], ["index", "indexed", "indexing"]),
}
# Words of a question, and frequent words, that are no concept.
NO_CONCEPT = "how what where why when who which are is the this that does do for with and or to of in on a an".split()


def variants(token: Column) -> Column:
    """The token, its singular, and the words of its group, each once."""
    singular = F.when(token.endswith("ies") & (F.octet_length(token) > 3), F.concat(F.regexp_replace(token, "ies$", ""), F.lit("y"))).when(
        token.endswith("s") & (F.octet_length(token) > 3), F.regexp_replace(token, "s$", "")
    )
    group = F.create_map(*[x for k, v in WORD_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.array_compact(F.concat(F.array(token, singular), F.coalesce(F.try_element_at(group, token), F.array().cast("array<string>")))))


def term_groups(words: list[str]) -> list[list[str]]:
    """The concepts of a query's tokens: each with its variants, sorted; groups with a word in common are one."""
    groups: list[set[str]] = []
    for word in words:
        if word in NO_CONCEPT:
            continue
        long = len(word.encode()) > 3
        one = [word[:-3] + "y"] if long and word.endswith("ies") else [word[:-1]] if long and word.endswith("s") else []
        group, apart = {word, *one, *WORD_GROUPS.get(word, [])}, []
        place = next((i for i, g in enumerate(groups) if g & group), len(groups))
        for g in groups:
            if g & group:
                group |= g
            else:
                apart.append(g)
        groups = [*apart[:place], group, *apart[place:]]
    return [sorted(g) for g in groups]


def coverage(text_tokens: Column, groups: list[list[str]]) -> Column:
    """The share of the groups of which the text has a word."""
    hits = [F.when(F.arrays_overlap(text_tokens, F.array(*map(F.lit, g))), 1).otherwise(0) for g in groups]
    return F.lit(0.0) if not hits else sum(hits[1:], hits[0]) / F.lit(float(len(groups)))


def match_score(text: Column, query: list[str]) -> Column:
    """The share of the query's tokens that are somewhere in the text."""
    hits = [F.when(F.contains(F.lower(text), F.lit(t.lower())), 1).otherwise(0) for t in query]
    return F.lit(0.0) if not hits else sum(hits[1:], hits[0]) / F.lit(float(len(query)))


def jaccard(a: Column, b: Column, cap: int = 20) -> Column:
    """Of the first distinct tokens of either, the share both have; 0 if there are none."""
    a, b = F.slice(F.array_distinct(a), 1, cap), F.slice(F.array_distinct(b), 1, cap)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def typo_of(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, change or swap of neighbours apart, words of five letters at least."""
    near = F.levenshtein(a, b, 1) >= 0
    same_length = F.length(a) == F.length(b)
    i = F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1))
    swapped = F.concat(F.substring(a, F.lit(1), i), F.substring(a, i + 2, F.lit(1)), F.substring(a, i + 1, F.lit(1)), F.substring(a, i + 3, F.length(a)))
    return (F.length(a) >= 5) & (F.length(b) >= 5) & (near | (same_length & (swapped == b)))


def normal_name(path: Column) -> Column:
    """A note's name for comparison: no .md, lower case, no punctuation, blanks once."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.md$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(base), r"[^\p{L}\p{N} ]", " "), " +", " "))


def trimmed(text: Column, budget: int) -> Column:
    """At most so many code points, cut behind a whole word where there is one, with an ellipsis."""
    cut = F.substring(text, 1, budget - 1)
    whole = F.regexp_replace(cut, r"\s+\S*\z", "")
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.when(whole == "", cut).otherwise(whole), F.lit("…")))


def date_of_content(text: Column, path: Column, updated: Column, now: str) -> Column:
    """The date a note speaks of: a frontmatter date, one in its file name, in its last heading that has one, else in its first
    lines; dates after now count as now."""
    front = F.regexp_extract(frontmatter(text), r"(?m)^(?:date|created|updated):[ \t]*[\"']?((?:19|20)\d\d-\d\d-\d\d)", 1)
    name = F.regexp_extract(F.regexp_replace(path, r"^.*/", ""), DATE.replace(r"\b", ""), 1)
    dated = F.filter(F.transform(headings(text), lambda h: F.regexp_extract(h["heading"], DATE, 1)), lambda x: x != "")
    last = F.coalesce(F.get(dated, F.size(dated) - 1), F.lit(""))
    top = F.regexp_extract(F.substring_index(body(text), "\n", 5), DATE, 1)
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in (front, name, last, top)])
    return F.when(first.isNotNull(), F.least(first, F.lit(now)))


def chunk_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
