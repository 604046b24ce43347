import random
from collections import Counter, defaultdict

import pytest

from tracewell.llm import packing as P


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_every_item(seed):
    rnd = random.Random(seed)
    histogram = Counter(rnd.randrange(1, 101) ** (1 + seed % 2) % 100 + 1 for _ in range(5000))
    found = P.patterns(histogram, 100)
    assert all(sum(lengths) <= 100 for _, lengths in found)
    assert sum((Counter({length: n * k for length, k in Counter(lengths).items()}) for n, lengths in found), Counter()) == histogram


def test_containers(spark):
    rnd = random.Random(7)
    sizes = {i: rnd.choice([5, 5, 5, rnd.randrange(1, 60), rnd.randrange(100, 350)]) for i in range(2000)} | {5000: 0, 5001: None, 5002: 100, 5003: 200}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    rows = P.packed(df, 100).collect()
    by_doc, boxes = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece_no, r.piece_start, r.piece_size))
        if r.container_id is not None:
            boxes[r.container_id].append((r.container_offset, r.piece_size))
    for k, n in sizes.items():
        pieces, at = sorted(by_doc[k]), 0
        for i, (no, start, size) in enumerate(pieces):
            assert (no, start) == (i, at) and (size == 100 or i == len(pieces) - 1)
            at += size
        assert at == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 100))
    for inside in boxes.values():
        at = 0
        for offset, size in sorted(inside):
            assert offset == at
            at += size
        assert at <= 100
    assert sorted(boxes) == list(range(len(boxes)))
    s = P.summary(P.packed(df, 100), 100).collect()[0]
    assert s.containers == len(boxes) and s.fill > 0.97
    assert P.packed(df.limit(0), 100).count() == 0
