"""The note filter language: tag:x, find:x, Key:Value and bare paths with OR, AND, NOT and parentheses, compiled to one boolean column.

OR binds weakest, then AND, then NOT. Words next to each other are joined by the given operator. An expression is a column over
path, title, tags (array<string>) and properties (array<struct<key, value>>), so Catalyst plans it as one filter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import has_tag
from tracewell.operators.rules import under

OPERATORS = {"and": "and", "&&": "and", "or": "or", "||": "or", "not": "not", "!": "not"}


def normal_value(value: Column) -> Column:
    """Lower case, no link brackets, no alias, no quotes."""
    v = F.regexp_replace(F.trim(value), "^[\"']|[\"']$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(v, r"^\[\[|\]\]$", ""), r"\|.*$", "")))


def find_matches(path: Column, pattern: str) -> Column:
    """dir/words: a directory, by its beginning if one letter, and words in order below it; without a slash words in order anywhere.
    More than one slash matches nothing."""
    pattern = pattern.lower()
    p = F.lower(path)
    words = lambda text: ".*".join(re.escape(w) for w in text.split())
    if pattern.count("/") > 1 or not pattern.strip():
        return F.lit(False)
    if "/" in pattern:
        folder, rest = pattern.split("/")
        first = F.substring_index(p, "/", 1)
        inside = p.contains("/") & (first.startswith(folder) if len(folder) == 1 else first.contains(folder))
        return inside & F.regexp_replace(p, "^[^/]*/", "").rlike(words(rest)) if rest.strip() else inside
    return p.rlike(words(pattern))


def leaf(token: str, bare: str) -> Column:
    unquoted = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v
    kind, _, value = token.partition(":")
    value = unquoted(value)
    if kind in ("tag", "find") and ":" in token:
        if value in ("", "*"):
            raise ValueError(f"empty or wildcard value in {token!r}")
        return has_tag(F.col("tags"), value) if kind == "tag" else find_matches(F.col("path"), value)
    if ":" in token:
        key, value = kind.strip().lower(), value.strip()
        if not key or value in ("", "*"):
            raise ValueError(f"a property needs key and value: {token!r}")
        wanted = normal_value(F.lit(value))
        return F.exists("properties", lambda p: (p["key"] == key) & (normal_value(p["value"]) == wanted))
    token = unquoted(token)
    return under(F.col("path"), token) if bare == "path" else find_matches(F.col("path"), token)


def tokenised(text: str) -> list[str]:
    return re.findall(r'[()]|(?:[^\s()"]+|"[^"]*")+', text)


def compiled(text: str, implicit: str = "or", bare: str = "path") -> Column:
    """The boolean column of an expression. Raises ValueError where the text is none."""
    words: list[str] = []
    for t in tokenised(text):
        starts = t == "(" or (t != ")" and OPERATORS.get(t.lower()) in (None, "not"))
        if words and starts and words[-1] != "(" and words[-1].lower() not in OPERATORS:
            words.append(implicit)
        words.append(t)
    at = 0

    def peek() -> str | None:
        return OPERATORS.get(words[at].lower(), words[at]) if at < len(words) else None

    def level(operator: str, inner, join) -> Column:
        nonlocal at
        out = inner()
        while peek() == operator:
            at += 1
            out = join(out, inner())
        return out

    def unary() -> Column:
        nonlocal at
        token = peek()
        at += 1
        if token == "not":
            return ~unary()
        if token == "(":
            out = either()
            if peek() != ")":
                raise ValueError("expected ')'")
            at += 1
            return out
        if token in (None, ")", "and", "or"):
            raise ValueError(f"unexpected {token or 'end'}")
        return F.coalesce(leaf(words[at - 1], bare), F.lit(False))

    def both() -> Column:
        return level("and", unary, lambda a, b: a & b)

    def either() -> Column:
        return level("or", both, lambda a, b: a | b)

    out = either()
    if at < len(words):
        raise ValueError(f"unexpected {words[at]!r}")
    return out


def listed(notes: DataFrame, text: str, implicit: str = "or", bare: str = "path") -> DataFrame:
    return notes.where(compiled(text, implicit, bare))


def listed_by_sets(notes: DataFrame, leaves: list[str], excluded: str) -> DataFrame:
    """The same by sets: the paths of any of the leaves without those of one; for when the leaves come from separate indexes."""
    out = None
    for word in leaves:
        part = notes.where(F.coalesce(leaf(word, "path"), F.lit(False))).select("path")
        out = part if out is None else out.union(part)
    return out.distinct().subtract(notes.where(F.coalesce(leaf(excluded, "path"), F.lit(False))).select("path"))


def ordered_terms(terms: DataFrame, words: list[str], scope: str) -> DataFrame:
    """Notes whose terms of a scope begin with the words in order. terms: (note_id, scope, ordinal, token). Each word is one equality
    join on the note with a residual order; the first match of each word is kept, so no pairs of matches multiply."""
    out = None
    for word in words:
        hits = terms.where((F.col("scope") == scope) & F.col("token").startswith(word)).select("note_id", F.col("ordinal").alias("at"))
        if out is None:
            out = hits.groupBy("note_id").agg(F.min("at").alias("last"))
        else:
            out = out.join(hits, "note_id").where(F.col("at") > F.col("last")).groupBy("note_id").agg(F.min("at").alias("last"))
    return out.select("note_id")
