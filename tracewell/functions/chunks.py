"""Text functions that need a scan with state: code spans, the heading-aware chunker, YAML and diffs. All run on Arrow batches."""

from __future__ import annotations

import difflib
import json
import re
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

# Sections are merged below the first size (bytes), cut above the second with the third as overlap (code points).
MERGE_BELOW, CUT_ABOVE, SHARED = 800, 2800, 300
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)


def code_spans(text: str) -> list[tuple[int, int]]:
    """Fenced blocks, indented blocks behind a blank line, and inline code, as code point ranges in order."""
    spans, at, fence, opened, blank = [], 0, None, 0, True
    for line in text.splitlines(keepends=True):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                spans.append((opened, at + len(line)))
                fence = None
        elif mark:
            fence, opened = mark[1], at
        elif blank and re.match(r"(?: {4}|\t)\S", line):
            spans.append((at, at + len(line)))
            at += len(line)
            continue
        else:
            spans += [(at + m.start(), at + m.end()) for m in re.finditer(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", line)]
        blank = not line.strip()
        at += len(line)
    if fence:
        spans.append((opened, at))
    return spans


def windows(text: str, size: int, overlap: int) -> list[str]:
    if overlap >= size:
        overlap = size // 5
    out, start = [], 0
    while True:
        out.append(text[start : start + size])
        if start + size >= len(text):
            return out
        start += size - overlap


def chunks_of(title: str, text: str) -> list[tuple[int, str, str, str]]:
    """(ord, breadcrumb, heading, body) of a note's chunks: sections by heading, short ones joined with the next."""
    sections: list[list] = [[1, "", []]]
    fenced = False
    for line in _FRONT.sub("", text).split("\n"):
        line = line.rstrip("\r")
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        heading = None if fenced else _ATX.match(line)
        if heading:
            sections.append([len(heading[1]), (heading[2] or "").strip(), []])
        else:
            sections[-1][2].append(line)
    if not sections[0][2]:
        sections.pop(0)
    joined, i = [], 0
    while i < len(sections):
        level, heading, lines = sections[i]
        while len("\n".join(lines).encode()) < MERGE_BELOW and i + 1 < len(sections):
            i += 1
            lines = [*lines, "", *sections[i][2]]
        joined.append((level, heading, lines))
        i += 1
    stack, out = [title], []
    for level, heading, lines in joined:
        while len(stack) > 1 and len(stack) - 1 >= level:
            stack.pop()
        stack.append(heading)
        whole = "\n".join(lines).strip()
        if whole:
            out += [(len(out) + k, " > ".join(stack), heading, part) for k, part in enumerate(windows(whole, CUT_ABOVE, SHARED))]
    return out


_CHUNK = T.ArrayType(T.StructType([T.StructField("ord", T.LongType()), T.StructField("breadcrumb", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("body", T.StringType())]))


def chunked(notes: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(key, ord, breadcrumb, heading, body, hash), many rows per note. Null or blank texts give none."""

    @F.pandas_udf(_CHUNK)
    def cut(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("ord", "breadcrumb", "heading", "body"), c, strict=True)) for c in chunks_of(a or "", b)] if b else [] for a, b in zip(titles, texts, strict=True)])

    rows = notes.select(key, F.explode(cut(F.col(title), F.col(text))).alias("c")).select(key, "c.*")
    return rows.withColumn("hash", F.sha2(F.concat_ws("\n", "breadcrumb", "body"), 256))


def _masked(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        out, at = [], 0
        for a, b in code_spans(t):
            if a >= at:
                out += [t[at:a], re.sub(r"[^\n]", " ", t[a:b])]
                at = b
        return "".join([*out, t[at:]])

    return texts.map(one)


def mask_code(text: Column) -> Column:
    """The text with every code span blanked, line breaks kept."""
    return F.pandas_udf(_masked, T.StringType())(text)


def _yaml_json(texts: pd.Series) -> pd.Series:
    def one(t):
        m = _FRONT.match(t) if t else None
        if not m or yaml is None:
            return None
        try:
            got = yaml.safe_load(m[1])
        except yaml.YAMLError:
            return None
        return json.dumps(got, default=str, sort_keys=True, ensure_ascii=False) if isinstance(got, dict) else None

    return texts.map(one)


def frontmatter_json(text: Column) -> Column:
    """The frontmatter as JSON; null if there is none, or bad YAML, or no mapping. Feed it to parse_json for variants."""
    return F.pandas_udf(_yaml_json, T.StringType())(text)


def _diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "a", "b", n=3)) for a, b in zip(old, new, strict=True)])


def unified_diff(old: Column, new: Column) -> Column:
    return F.pandas_udf(_diff, T.StringType())(old, new)

