import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import tokenizer as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def mine(texts):
    counts, ids = T.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for c, e in zip(counts, ends, strict=True)]


def test_chosen_texts(public):
    texts = [
        "", "a", " ", "  ", "\n", "x \n\n y", "it's they're I'll 'S 's ''s '", " 's\n's\t're", "<|endoftext|> hi", "aaaaaaa" * 50, "a" * 5000, "ab" * 700,
        "héllo wörld ½ ٣", "日本語のテキスト" * 60, "🙂🙃👩‍👩‍👧", " x　y  z", "a​b", "1234567 12ab", "end  ", "﻿# T", "x'", "don't've'd'm", "\r\n\r\n x", "don'", "'", "s", "'\n", "'re", "'r", "e",
    ]
    assert mine(texts) == public(texts)
    # borders of texts are borders of words: the last text's end and the next one's start never join
    assert mine([x for t in texts for x in (t, "'", "s")]) == public([x for t in texts for x in (t, "'", "s")])


def test_random_texts(public):
    rnd = random.Random(1)
    alphabet = " \n\t'sdmtrevl.aé1２中🙂-_ "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    assert mine(texts) == public(texts)


def test_every_assigned_code_point(public):
    points = [c for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = [f"a{chr(c)} {chr(c)}1\n{chr(c)}'s" for c in points]
    assert [p for p, a, b in zip(points, mine(texts), public(texts), strict=True) if a != b] == []


def test_small_memory_and_null(monkeypatch, public, spark):
    monkeypatch.setattr(T, "REMEMBER", 3)
    monkeypatch.setattr(T, "FLAT", 5)
    texts = ["one two three", None, "", "four five", "one"]
    assert mine(texts) == [x and y for x, y in zip([1, [], [], 1, 1], public([t or "" for t in texts]), strict=True)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    assert [r.ids for r in T.encoded(df).orderBy("doc_id").collect()] == [x or [] for x in mine(texts)]
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df).collect()} == {i: len(x) for i, x in enumerate(mine(texts))}
    assert T.encoded(df.limit(0)).count() == 0
