"""Splitting oversized items at natural boundaries.

An item is a byte range of a document's text. Items above their limit are cut by dynamic programming over boundary positions:
the cost of a cut is the penalty of its boundary (before a heading, a paragraph, a line, a sentence, a word, a character, from
cheap to dear; dearer inside a fenced block or right behind a heading) and each piece adds the square of its distance from
equal sizes. A piece starts the wanted overlap before the cut, moved back to the start of a character. Every natural boundary is a
candidate, and where there is none for a 32nd of a piece, a character. The boundaries are settled block by block in the order of
the text; a block's ends look back no further than the limit, so the work is linear in the item's length.

Only the byte lengths decide which texts are needed: items whose range cannot exceed the limit never meet the texts, and of the
others only the item's own bytes go to Python, and only if they exceed the limit.

Defined cases: of the rows of one chunk_id the one with the greatest updated_at, then id, holds; a null chunk_id is no item; a
null or unknown granularity has no limit; null or reversed ranges and missing documents have no content; a range is taken as
far as the text reaches, from 0 on; an overlap of the limit or more counts as half the limit; one that leaves no piece room to
advance by a character is cut to what always does, the limit less 7 bytes, or to none; a character longer than the limit is a
piece of its own. doc_id is unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import stripped

HEADING, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = 0, 2, 4, 7, 16, 48
KINDS = {HEADING: "heading", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", CHARACTER: "character"}
#: Added to the penalty of a cut inside a fenced block or between a heading and its text.
TORN = 12
#: Weight of a piece's squared relative distance from equal sizes, against the penalties.
UNEVEN = 24.0
#: Parts of a piece that have a candidate each, and boundaries that are settled together.
CELLS, BLOCK = 32, 256
#: A start is moved back by 3 bytes at most, and a character has at most 4.
ADVANCE = 7


def _boundaries(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, penalties, kinds): every place before which the text naturally breaks, ascending."""
    n = len(raw)
    line = np.r_[0, np.flatnonzero(raw == 10) + 1]
    line = line[line < n]
    first = raw[line]
    blank = (first == 10) | ((first == 13) & (raw[np.minimum(line + 1, n - 1)] == 10))
    hashes = np.zeros(len(line), np.int64)
    going = np.ones(len(line), bool)
    for k in range(7):
        going &= raw[np.minimum(line + k, n - 1)] == 35
        hashes += going
    heading = (hashes > 0) & (hashes < 7) & np.isin(raw[np.minimum(line + hashes, n - 1)], (32, 9))
    two, three = raw[np.minimum(line + 1, n - 1)], raw[np.minimum(line + 2, n - 1)]
    fence = ((first == 96) | (first == 126)) & (two == first) & (three == first)
    opened = np.cumsum(fence)
    fenced = ((opened - fence) % 2).astype(bool)
    heading &= ~fenced
    index = np.arange(len(line))
    written = np.maximum.accumulate(np.where(blank, -1, index))
    before = np.r_[-1, written[:-1]]
    kind = np.where(heading, HEADING, np.where(np.r_[False, blank[:-1]], PARAGRAPH, LINE))
    torn = fenced | ((before >= 0) & heading[before] & ~heading)
    penalty = kind + TORN * torn
    keep = (line > 0) & ~blank
    gap = np.flatnonzero((raw[:-1] == 32) | (raw[:-1] == 9)) + 1
    gap = gap[(raw[gap] != 32) & (raw[gap] != 9)]
    ended = np.isin(raw[gap - 2], (33, 46, 63)) & (gap >= 2)
    in_fence = fenced[np.searchsorted(line, gap, "right") - 1] if len(gap) else np.zeros(0, bool)
    word_kind = np.where(ended & ~in_fence, SENTENCE, WORD)
    place, kinds = np.r_[line[keep], gap], np.r_[kind[keep], word_kind]
    penalties = np.r_[penalty[keep], word_kind + TORN * in_fence]
    order = np.argsort(place, kind="stable")
    return place[order], penalties[order], kinds[order]


def cut(content: bytes, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of the pieces, together covering the content."""
    n = len(content)
    if n <= limit:
        return [(0, n, "end")]
    raw = np.frombuffer(content, np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    heads = heads if len(heads) and heads[0] == 0 else np.r_[0, heads]
    found = _boundaries(raw)
    overlap = max(0, overlap if overlap < limit else limit // 2)
    for shared in dict.fromkeys((overlap, max(0, min(overlap, limit - ADVANCE)))):
        if pieces := _best_cuts(n, limit, shared, heads, *found):
            return pieces
    return _by_character(heads, n, limit)


def _best_cuts(n: int, limit: int, overlap: int, heads: np.ndarray, place: np.ndarray, penalty: np.ndarray, kind: np.ndarray) -> list[tuple[int, int, str]]:
    cell = max(1, (limit - overlap - 3) // CELLS)
    # Characters where there is no boundary for more than a cell.
    known = np.r_[0, place, n]
    gaps = np.flatnonzero(np.diff(known) > cell)
    times = (known[gaps + 1] - known[gaps] - 1) // cell
    spots = np.repeat(known[gaps], times) + cell * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1)
    at = np.setdiff1d(heads[np.maximum(np.searchsorted(heads, spots, "right") - 1, 0)], known)
    end = np.r_[place, at]
    penalty, kind = np.r_[penalty, np.full(len(at), CHARACTER)], np.r_[kind, np.full(len(at), CHARACTER)]
    order = np.argsort(end, kind="stable")
    end, penalty, kind = np.r_[0, end[order], n], np.r_[0, penalty[order], 0].astype(float), np.r_[0, kind[order], 0]
    start = heads[np.maximum(np.searchsorted(heads, end - overlap, "right") - 1, 0)]
    start[0] = 0
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    even = (n + (pieces - 1) * overlap) / pieces
    low = np.searchsorted(start, end - limit, "left")
    best, back = np.full(len(end), np.inf), np.zeros(len(end), np.int64)
    best[0] = 0
    ends, starts, a = end / even - 1, start / even, 1
    while a < len(end):
        # Up to half a piece at a time: what begins and ends inside a block is rare, and settled by repeating.
        z = min(a + BLOCK, max(a + 1, int(np.searchsorted(end, end[a] + max(1, (limit - overlap) // 2)))))
        rows, first = np.arange(a, z), min(low[a], a - 1)
        cols = np.arange(first, z)
        cost = ends[a:z, None] - starts[first:z]
        cost *= cost * UNEVEN
        cost[(cols < low[a:z, None]) | (cols >= rows[:, None])] = np.inf
        while True:
            total = cost + best[first:z]
            at = total.argmin(1)
            now = total[rows - a, at] + penalty[a:z]
            better = now < best[a:z]
            if not better.any():
                break
            best[a:z], back[a:z] = np.where(better, now, best[a:z]), np.where(better, first + at, back[a:z])
        a = z
    if np.isinf(best[-1]):
        return []
    way = [len(end) - 1]
    while way[-1]:
        way.append(back[way[-1]])
    way = way[::-1]
    return [(int(start[i]), int(end[j]), KINDS[int(kind[j])] if j < len(end) - 1 else "end") for i, j in zip(way, way[1:], strict=False)]


def _by_character(heads: np.ndarray, n: int, limit: int) -> list[tuple[int, int, str]]:
    """For limits near or below the length of a character: as many whole characters as fit, one at least, without overlap."""
    out, at = [], 0
    while at < n:
        to = int(heads[np.searchsorted(heads, at + limit, "right") - 1]) if at + limit < n else n
        if to <= at:
            k = int(np.searchsorted(heads, at, "right"))
            to = int(heads[k]) if k < len(heads) else n
        out.append((at, to, KINDS[CHARACTER] if to < n else "end"))
        at = to
    return out


def oversized(items: DataFrame, limits: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, heading, start, max_bytes, overlap_bytes, content) of the items above their limit."""
    rows = items.where(F.col("chunk_id").isNotNull())
    kept = ["owner_row_id", "granularity", "heading", "start_byte", "end_byte"]
    newest = F.max(F.struct("updated_at", "id", *kept)).alias("item")
    rows = rows.groupBy("chunk_id").agg(newest).select("chunk_id", *[f"item.{c}" for c in kept])
    name = lambda c: F.lower(stripped(F.col(c)))
    limits = limits.select(name("granularity").alias("g"), "max_bytes", "overlap_bytes").where(F.col("max_bytes") > 0).groupBy("g").agg(F.min("max_bytes").alias("max_bytes"), F.min_by("overlap_bytes", "max_bytes").alias("overlap_bytes"))
    rows = rows.where(F.col("start_byte").isNotNull())
    start = F.greatest(F.col("start_byte"), F.lit(0))
    rows = rows.withColumn("g", name("granularity")).withColumn("start", start).join(limits, "g").where(F.col("end_byte") - F.col("start") > F.col("max_bytes"))
    texts = documents.select(F.col("doc_id").alias("owner_row_id"), F.col("text").cast("binary").alias("whole")).where(F.octet_length("whole") > 0)
    content = F.expr("substring(whole, cast(start + 1 as int), cast(least(end_byte - start, 2147483647) as int))")
    size = F.least("end_byte", F.octet_length("whole").cast("long")) - F.col("start")
    met = rows.join(texts, "owner_row_id").where(size > F.col("max_bytes"))
    return met.select("chunk_id", "heading", "start", F.col("max_bytes").cast("long").alias("max_bytes"), F.coalesce(F.col("overlap_bytes").cast("long"), F.lit(0)).alias("overlap_bytes"), content.alias("content"))


_OUT = pa.schema([("chunk_id", pa.string()), ("piece_no", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("shared_bytes", pa.int64()), ("break_at", pa.string()), ("piece", pa.binary())])


def _cut_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        rows: dict[str, list] = {c: [] for c in _OUT.names}
        held = 0
        for k in range(batch.num_rows):
            chunk, _, start, limit, overlap, content = (batch.column(c)[k].as_py() for c in range(6))
            done = 0
            for no, (a, b, kind) in enumerate(cut(content, limit, overlap)):
                for c, v in zip(_OUT.names, (chunk, no, start + a, start + b, max(0, done - a), kind, content[a:b]), strict=True):
                    rows[c].append(v)
                done = b
            held += len(content)
            if held > 16_000_000:
                yield pa.RecordBatch.from_pydict(rows, _OUT)
                rows, held = {c: [] for c in _OUT.names}, 0
        yield pa.RecordBatch.from_pydict(rows, _OUT)


def pieces(items: DataFrame, limits: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, piece_no, start_byte, end_byte, shared_bytes, break_at, piece) of every item above its limit, in bytes of the
    document's text; shared_bytes: with the piece before; break_at: the boundary the piece ends at; piece: its text (bytes that
    are no UTF-8 because the item itself starts or ends inside a character are replaced)."""
    schema = "chunk_id string, piece_no bigint, start_byte bigint, end_byte bigint, shared_bytes bigint, break_at string, piece binary"
    big = oversized(items, limits, documents)
    return big.mapInArrow(_cut_all, schema).withColumn("piece", F.make_valid_utf8(F.col("piece").cast("string")))
