import random

import pytest
from tracewell.llm import conversations as C

SCHEMA = "id long, session_id string, role string, content string, created_at string, context_json string"


def test_instants(spark):
    cases = {
        "2025-09-02T11:10:33.315369898Z": (1756811433, 315369898), "2025-09-02T11:10:33Z": (1756811433, 0), "2025-09-02 11:10:33": (1756811433, 0),
        "2025-09-02T13:10:33.5+02:00": (1756811433, 500_000_000), "2025-09-02T06:10:33-05:00": (1756811433, 0), "1756811433315": (1756811433, 315_000_000),
        "1756811433": (1756811433, 0), "1756811433315369898": (1756811433, 315369898), "0000-00-00": None, "n/a": None, "": None, None: None, "yesterday": None,
        "2025-09-02": (1756771200, 0), "2025-09-02T11:10|33Z": None, " 2025-09-02t11:10:33z ": (1756811433, 0), "2025-13-01T00:00:00Z": None, "2025-09-02T25:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: None if r.s is None else (r.s, r.ns) for r in C.instants(df, "t").collect()}
    assert got == cases


def kept(spark, rows, hot=C.HOT):
    df = spark.createDataFrame([(i, s, r, c, t, None) for i, s, r, c, t in rows], SCHEMA)
    return sorted((r.session_id, r.turn_no, r.id) for r in C.conversations(df, hot).collect())


@pytest.mark.parametrize("hot", [C.HOT, 1])
def test_rules(spark, hot):
    t = lambda k: f"2025-01-01T00:00:{k:02d}Z"
    rows = [
        (1, "ok", "user", "a", t(1)), (2, "ok", "system", "s", t(2)), (3, "ok", " Human ", " a\n", t(3)), (4, "ok", "bot", "b", t(4)), (4, "ok", "bot", "b", t(4)), (5, "ok", "AI", "\u200b", t(5)),
        (10, "starts-wrong", "bot", "b", t(1)), (11, "starts-wrong", "user", "b", t(2)), (12, "starts-wrong", "bot", "b", t(3)),
        (20, "no-reply", "user", "b", t(1)),
        (30, "two", "user", "b", t(1)), (31, "two", "user", "c", t(2)), (32, "two", "bot", "c", t(3)),
        (40, "role", "user", "b", t(1)), (41, "role", None, "c", t(2)), (42, "role", "bot", "c", t(3)),
        (50, "time", "user", "b", "n/a"), (51, "time", "bot", "c", t(2)),
        (60, "tie", "bot", "c", t(1)), (59, "tie", "user", "b", t(1)),
        (70, "empty", "user", None, t(1)), (71, "empty", "user", "", t(1)),
        (80, None, "user", "b", t(1)), (81, None, "bot", "b", t(2)),
        (90, "skip", "user", "q", t(1)), (91, "skip", "???", " ", "n/a"), (92, "skip", "model", "r", t(2)),
    ]
    random.Random(3).shuffle(rows)
    assert kept(spark, rows, hot) == [("ok", 1, 1), ("ok", 2, 4), ("skip", 1, 90), ("skip", 2, 92), ("tie", 1, 59), ("tie", 2, 60)]


def test_slabs_give_the_same(spark):
    rnd = random.Random(5)
    rows = [(i, f"s{i % 3}", "user" if (i // 3) % 2 == 0 else "assistant", "same" if rnd.random() < 0.1 else f"c{i}", f"2025-01-{1 + i // 100:02d}T00:00:{i % 60:02d}.{i:06d}Z") for i in range(0, 900)]
    rows = [(i, s, r, c, f"2025-01-01T{i // 60:02d}:{i % 60:02d}:00Z") for i, s, r, c, _ in rows]
    rows += [(5000 + i, "s1", r, c, t) for i, s, r, c, t in rows if s == "s1" and i % 4 == 0]
    assert kept(spark, rows, 10) == kept(spark, rows)
    assert kept(spark, rows)


def test_a_hot_conversation_within_one_second(spark):
    """The slabs don't rest on the time alone."""
    rows = [(i, "s", "user" if i % 2 == 0 else "bot", f"c{i}", "2025-01-01T00:00:00Z") for i in range(400)]
    assert kept(spark, rows, 10) == [("s", i + 1, i) for i in range(400)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert C._slabbed(C.messages(df), 10)[0].select("slab").distinct().count() > 50
    none = [(i, "s", r, c, None) for i, _, r, c, _ in rows]
    df = spark.createDataFrame([(*r, None) for r in none], SCHEMA)
    assert C._slabbed(C.messages(df), 10)[0].select("slab").distinct().count() > 50
    assert [(r.kept, r.reason) for r in C.verdicts(df, 10).collect()] == [(False, "unreadable")]


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", symbol string, slab int, n string")
    assert C.conversations(none).count() == 0
    one = spark.createDataFrame([(None, "s", "user", "x", "1756811433", None, "q"), (None, "s", "ai", "y", "1756811434", None, "q")], SCHEMA + ", digest string")
    assert [(r.turn_no, r.id) for r in C.conversations(one).orderBy("turn_no").collect()] == [(1, None), (2, None)]
