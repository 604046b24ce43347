import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import splitting as S


def check(content, limit, overlap, pieces):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(content)
    heads = {i for i, b in enumerate(content) if b & 0xC0 != 0x80} | {0, len(content)}
    for a, b, _ in pieces:
        assert b > a and a in heads and b in heads and b - a <= max(limit, 4)
    for (_, b, _), (a2, b2, _) in zip(pieces, pieces[1:], strict=False):
        assert b2 > b and overlap <= b - a2 <= overlap + 3 or a2 == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n#`é中🙂-"), min_size=1, max_size=1500), st.integers(30, 200), st.integers(0, 15))
def test_pieces_cover(text, limit, overlap):
    content = text.encode()
    check(content, limit, overlap, S.cut(content, limit, overlap))


def test_cuts_at_headings_and_paragraphs():
    part = "Sentence one is here. Sentence two is there.\n\n"
    content = ("# A\n\n" + part * 4 + "## B\n\n" + part * 4 + "## C\n\n" + part * 4).encode()
    got = S.cut(content, 250, 0)
    assert [k for _, _, k in got] == ["heading", "heading", "end"]
    assert content[got[1][0] :].startswith(b"## B")
    fence = b"x" * 150 + b"\n\n```\n" + b"code line\n" * 12 + b"```\n\n" + b"y" * 150
    assert all(not (fence.find(b"```") < b < fence.rfind(b"```")) for _, b, _ in S.cut(fence, 300, 0)[:-1])


def test_hard_contents():
    assert S.cut(b"x" * 10, 10, 5) == [(0, 10, "end")]
    check(b"x" * 10_000, 100, 20, S.cut(b"x" * 10_000, 100, 20))
    check(b"\n" * 10_000, 100, 20, S.cut(b"\n" * 10_000, 100, 20))
    assert len(S.cut("🙂".encode() * 5, 2, 1)) == 5
    check("中".encode() * 50, 10, 0, S.cut("中".encode() * 50, 10, 0))
    check(b"a" * 100, 10, 5, S.cut(b"a" * 100, 10, 90))
    assert S.cut(b"\x80\x80" + b"a" * 200, 100, 10)[0][0] == 0


def test_wide_overlaps():
    for limit, overlap in ((120, 100), (60, 50), (50, 49), (20, 12)):
        content = b"word " * 300
        got = S.cut(content, limit, overlap)
        check(content, limit, overlap, got)
    check("中".encode() * 50, 12, 5, S.cut("中".encode() * 50, 12, 10))


def least_cost(content, limit, overlap):
    """The cheapest way over all natural boundaries, one by one."""
    raw = S.np.frombuffer(content, S.np.uint8)
    place, penalty, _ = S._boundaries(raw)
    n, end, cut = len(content), [0, *place.tolist(), len(content)], [0, *penalty.tolist(), 0]
    start = [max(0, e - overlap) for e in end]
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    even = (n + (pieces - 1) * overlap) / pieces
    best = [0.0] + [float("inf")] * (len(end) - 1)
    for j in range(1, len(end)):
        for i in range(j):
            if end[j] - start[i] <= limit:
                best[j] = min(best[j], best[i] + cut[j] + S.UNEVEN * ((end[j] - start[i]) / even - 1) ** 2)
    return best[-1], dict(zip(end, cut, strict=True)), even


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abc   ..\n#"), min_size=150, max_size=700), st.sampled_from([(90, 0), (90, 30), (60, 40), (150, 10)]))
def test_no_way_over_the_boundaries_is_cheaper(text, shape):
    content = text.encode()
    if len(content) > shape[0]:
        least, cut, even = least_cost(content, *shape)
        got = S.cut(content, *shape)
        cost = sum(cut.get(b, S.CHARACTER) + S.UNEVEN * ((b - a) / even - 1) ** 2 for a, b, _ in got)
        assert cost <= least + 1e-6


@pytest.mark.parametrize("empty", [False, True])
def test_items(spark, empty):
    text = "Été. " * 100
    n = len(text.encode())
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, content string")
    rows = [
        (1, "old-is-big", 1, "section", 0, n, 5, None), (2, "old-is-big", 1, "section", 0, 10, 6, None), (3, "tie", 1, "section", 0, 10, 5, None), (4, "tie", 1, " SECTION", 0, n, 5, None),
        (5, "past-the-end", 1, "Section ", 0, 10**9, 5, "h"), (5, "past-the-end", 1, "Section ", 0, 10**9, 5, "h"), (6, "short-by-text", 1, "section", n - 50, n + 900, 5, None), (7, "reversed", 1, "section", 400, 10, 5, None),
        (8, "no-text", 2, "section", 0, 900, 5, None), (9, "blank", 3, "section", 0, 900, 5, None), (10, "gone", 99, "section", 0, 900, 5, None), (11, "unknown", 1, "page", 0, 900, 5, None),
        (12, "nulls", 1, None, 0, 900, 5, None), (13, "null-start", 1, "section", None, 900, 5, None), (14, None, 1, "section", 0, 900, 5, None), (15, "before", 1, "section", -50, 101, 5, None), (16, "exact", 1, "section", 0, 100, 5, None),
    ]
    items = spark.createDataFrame([] if empty else rows, "id long, chunk_id string, owner_row_id long, granularity string, start_byte long, end_byte long, updated_at long, heading string")
    limits = spark.createDataFrame([("section", 100, 10)], "granularity string, max_bytes long, overlap_bytes long")
    got = S.pieces(items, limits, docs).collect()
    assert {r.chunk_id for r in got} == (set() if empty else {"tie", "past-the-end", "before"})
    for r in got:
        assert r.piece.encode() == text.encode()[r.start_byte : r.end_byte] and r.end_byte - r.start_byte <= 100
