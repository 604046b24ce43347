"""Encoding of a whole corpus with a public byte-level BPE tokenizer, in numpy.

Per Arrow batch: the code points of all texts lie in one flat array; a class table (letter, number, space, other) and a few
array comparisons place the borders that the tokenizer's split pattern would place. Words that were not met before are merged
in batched rounds: the symbols of all of them lie in one flat array, each round looks every adjacent pair up by binary search
over the sorted pair keys and merges each word's lowest-ranked pair, until no word has one left. Words met before come from a
dictionary of the worker. Words of more than LONG bytes are merged one by one with a heap, as rounds would cost their length squared.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; invalid UTF-8 is replaced
before encoding.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of a word from which it is merged with a heap.
LONG = 192
#: Bytes of text that are laid flat at a time.
FLAT = 3_000_000
#: Words a worker remembers before it starts anew.
REMEMBER = 400_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# The code points of the property White_Space, and the pattern's contractions.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; points that Python's Unicode tables don't know yet are no letters."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """One vocabulary, and the words met so far."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, byte_of = model["vocab"], _byte_of()
        self.first = np.zeros(256, np.int64)
        for shown, byte in byte_of.items():
            self.first[byte] = vocab[shown]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.by_key = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = [np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64)]
        self.flat, self.at = self.pool[0], self.ends[0]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of short words, and each word's length in ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        spot = np.arange(len(symbol))
        done_symbol, done_spot, done_word = [], [], []
        while len(symbol):
            rank = np.full(len(symbol), self.none)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self.rank(symbol[:-1][same], symbol[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, starts)
            count = np.diff(np.r_[starts, len(symbol)])
            live = np.repeat(lowest < self.none, count)
            if not live.all():
                done_symbol.append(symbol[~live])
                done_spot.append(spot[~live])
                done_word.append(word[~live])
                symbol, word, spot, rank = symbol[live], word[live], spot[live], rank[live]
                lowest, count = lowest[lowest < self.none], count[lowest < self.none]
                if not len(symbol):
                    break
            hit = rank == np.repeat(lowest, count)
            # Of overlapping hits, a run of equal symbols, every second one counts from the left.
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            if hit.sum() > len(run):
                index = np.flatnonzero(hit)
                since = index - run[np.searchsorted(run, index, "right") - 1]
                hit[index[since % 2 == 1]] = False
            symbol[hit] = self.merged[rank[hit]]
            keep = ~np.r_[False, hit[:-1]]
            symbol, word, spot = symbol[keep], word[keep], spot[keep]
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        order = np.argsort(np.concatenate(done_spot), kind="stable")
        lengths = np.bincount(np.concatenate(done_word), minlength=len(words))
        return np.concatenate(done_symbol)[order].astype(np.int32), lengths

    def heap(self, word: bytes) -> np.ndarray:
        """Ids of one long word: pairs by rank and place, stale ones skipped."""
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.by_key.get
        queue = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := get(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := get(symbol[x] << 20 | symbol[y])) is not None:
                    heapq.heappush(queue, (q, x, symbol[x], symbol[y]))
        return np.array([s for s in symbol if s >= 0], np.int32)

    def learn(self, words: list[bytes]) -> None:
        short, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        flat, lengths = self.rounds(short)
        more = [self.heap(w) for w in long]
        base = len(self.known)
        for k, w in enumerate(short + long):
            self.known[w] = base + k
        self.pool += [flat, *more]
        self.ends.append(self.ends[-1][-1] + np.cumsum(np.r_[lengths, [len(m) for m in more]].astype(np.int64)))
        self.flat, self.at = np.concatenate(self.pool), np.concatenate(self.ends)
        self.pool, self.ends = [self.flat], [self.at]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word among the known ones; unknown ones are learnt first."""
        if len(self.known) > REMEMBER:
            self.forget()
        new = list(set(words).difference(self.known))
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.at[numbers + 1] - self.at[numbers]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.lengths(numbers)
        place = np.repeat(self.at[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[place]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def borders(point: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words begin: indices into the flat code points; a text's start always is one."""
    n = len(point)
    kind = classes()[point]
    fresh = np.zeros(n + 1, bool)
    fresh[text_starts] = True
    fresh[n] = True
    starts = fresh[:n].copy()
    turn = np.r_[True, kind[1:] != kind[:-1]]
    starts |= turn
    space = kind == SPACE
    # The last of a run of spaces before something else stands alone, or, if a plain blank, leads the next word.
    last = space & ~np.r_[space[1:], False] & ~fresh[1:]
    starts |= last
    leads = last & (point == 32)
    starts[1:][leads[:-1]] = False
    # A contraction: an apostrophe that starts a word, by itself, right before its letters.
    quote = np.flatnonzero((point == 39) & starts & ~np.r_[False, leads[:-1]])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~fresh[quote + 1]]
    if len(quote):
        one = point[quote + 1]
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], point[np.minimum(quote + 2, n - 1)], 0)
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            size[(one == ord(c[0])) & ((two == ord(c[1])) if len(c) == 2 else True) & (size == 0)] = len(c)
        starts[quote[size > 0] + 1] = False
        after = quote[size > 0] + size[size > 0] + 1
        starts[after[after < n]] = True
    return np.flatnonzero(starts)


def _flat(data: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Words of texts laid end to end, and the byte each word begins at. text_starts: byte offsets of the non-empty texts."""
    if data.isascii():
        at = borders(np.frombuffer(data, np.uint8), text_starts)
    else:
        raw = np.frombuffer(data, np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        point = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = heads[borders(point, np.searchsorted(heads, text_starts))]
    cut = at.tolist()
    return at, [data[a:b] for a, b in zip(cut, [*cut[1:], len(data)], strict=True)]


def encode(texts: pa.Array, path: str = VOCABULARY, count_only: bool = False):
    """For an Arrow string array: (length of each text in ids, flat ids or None)."""
    enc = encoder(path)
    texts = texts.cast(pa.large_string())
    raw = texts.buffers()[2]
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    valid = np.ones(len(texts), bool) if not texts.null_count else texts.is_valid().to_numpy(zero_copy_only=False)
    start, size = offset[:-1], np.where(valid, np.diff(offset), 0)
    counts, out = np.zeros(len(texts), np.int64), []
    view = memoryview(raw) if raw is not None else memoryview(b"")
    i = 0
    while i < len(texts):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), FLAT, "right")))
        take = np.flatnonzero(size[i:j]) + i
        if len(take):
            data = b"".join(view[start[k] : start[k] + size[k]] for k in take)
            begin = np.cumsum(size[take]) - size[take]
            at, words = _flat(data, begin)
            number = enc.numbers(words)
            length = np.r_[0, np.cumsum(enc.lengths(number))]
            first = np.searchsorted(at, begin)
            counts[take] = np.diff(length[np.r_[first, len(at)]])
            if not count_only:
                out.append(enc.ids(number))
        i = j
    return counts, None if count_only else (np.concatenate(out) if out else np.zeros(0, np.int32))


def _batches(parts: Iterator[pa.RecordBatch], key: str, text: str, path: str, count_only: bool) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        counts, ids = encode(batch.column(text), path, count_only)
        if count_only:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts)], [key, "n_tokens"])
        else:
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "ids"])


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    rows = documents.select(key, F.make_valid_utf8(text).alias(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(lambda parts: _batches(parts, key, text, path, False), f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row."""
    rows = documents.select(key, F.make_valid_utf8(text).alias(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(lambda parts: _batches(parts, key, text, path, True), f"`{key}` {kind}, n_tokens bigint")
