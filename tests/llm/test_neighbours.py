import numpy as np
import pytest

from tracewell.llm import neighbours as N

SCHEMA = "key string, dimensions int, vector binary, cosine string, d string"


def frame(spark, vectors, dims=None):
    rows = [(k, len(v) if dims is None else dims, np.asarray(v, "<f4").tobytes(), "clash", "x") for k, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def truth(vectors, k=10, floor=None):
    keys = sorted(vectors)
    x = np.array([vectors[q] for q in keys], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    near = {keys[i]: [keys[j] for j in top[i]] for i in range(len(keys))}
    pairs = {tuple(sorted((keys[i], keys[j]))) for i in range(len(keys)) for j in top[i] if floor is not None and s[i, j] >= floor}
    return near, pairs


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    vectors = {f"k{i:05d}": centres[rng.integers(40)] + rng.normal(size=24) * 0.8 for i in range(2600)}
    for i in range(150):
        vectors[f"n{i:05d}"] = (vectors[f"k{i:05d}"] + rng.normal(size=24) * 0.15) * rng.uniform(0.1, 9)
    return vectors


def test_pairs_and_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(N, "LIST", 64)
    monkeypatch.setattr(N, "GROUP", 500)
    df = frame(spark, clustered.items())
    near, pairs = truth(clustered, 10, 0.9)
    got = {(r.key_a, r.key_b) for r in N.similar_pairs(df).collect()}
    assert len(got & pairs) >= 0.98 * len(pairs) and got <= pairs
    rows = N.neighbours(df).collect()
    found = {k: set() for k in clustered}
    for r in rows:
        found[r["key"]].add(r.neighbour)
    assert all(len(v) == 10 and k not in v for k, v in found.items())
    assert sum(len(found[k] & set(v)) for k, v in near.items()) >= 0.9 * 10 * len(near)


def test_copies_and_unusable(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(f"c{i:02d}", base) for i in range(30)] + [("c00", base), ("other", rng.normal(size=16)), ("nan", [np.nan] * 16), ("inf", [np.inf] + [1.0] * 15), ("zero", [0.0] * 16), ("tiny", base * 1e-30), ("huge", base * 1e30), (None, base)]
    df = frame(spark, rows).union(frame(spark, [("short", base)], dims=17)).union(spark.createDataFrame([("none", 16, None, "", ""), ("nodim", None, base.astype("<f4").tobytes(), "", "")], SCHEMA))
    got = {}
    for r in N.neighbours(df).collect():
        got.setdefault(r["key"], []).append((r["rank"], r.neighbour, round(r.cosine, 4)))
    assert set(got) == {f"c{i:02d}" for i in range(30)} | {"other", "tiny", "huge"}
    assert all(sorted(x[0] for x in v) == list(range(1, 11)) for v in got.values())
    assert all(c == 1.0 for k, v in got.items() if k != "other" for _, _, c in v)
    assert [x[1] for x in sorted(got["c29"])] == [f"c{i:02d}" for i in range(10)]
    assert N.neighbours(df.limit(0)).count() == 0
    assert N.similar_pairs(df.limit(0)).count() == 0


def test_border_of_the_cosine(spark):
    a = np.zeros(8)
    a[0] = 1
    at = lambda c: np.r_[c, (1 - c * c) ** 0.5, np.zeros(6)]
    df = frame(spark, [("a", a), ("b", at(0.900005)), ("c", -at(0.899995)), ("d", -a)])
    assert {(r.key_a, r.key_b) for r in N.similar_pairs(df).collect()} == {("a", "b")}


def test_lists_divided_by_a_second_level(spark, clustered, monkeypatch):
    monkeypatch.setattr(N, "LIST", 32)
    monkeypatch.setattr(N, "LISTS", 8)
    df = frame(spark, clustered.items())
    near, pairs = truth(clustered, 10, 0.9)
    own = N.owners(df)
    assert {m.sub for m in N.fit(df, own).values()} == {round(len(clustered) / 32 / 8)}
    assert len({(r.key_a, r.key_b) for r in N.similar_pairs(df).collect()} & pairs) >= 0.98 * len(pairs)
    found = {k: set() for k in clustered}
    for r in N.neighbours(df).collect():
        found[r["key"]].add(r.neighbour)
    assert sum(len(found[k] & set(v)) for k, v in near.items()) >= 0.9 * 10 * len(near)


def test_a_list_heavier_than_a_group(spark, monkeypatch):
    """Half of all vectors point the same way, with lengths of their own, so no centroid divides them."""
    monkeypatch.setattr(N, "GROUP", 60)
    monkeypatch.setattr(N, "LIST", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=12)
    vectors = {f"{i:064x}": base * (1 + i) for i in range(200)} | {f"{1000 + i:064x}": rng.normal(size=12) for i in range(200)}
    df = frame(spark, vectors.items())
    assert any((m.split > 1).any() for m in N.fit(df, N.owners(df)).values())
    got = {}
    for r in N.neighbours(df).collect():
        got.setdefault(r["key"], []).append((r.neighbour, r.cosine))
    assert set(got) == set(vectors) and all(len(v) == 10 for v in got.values())
    assert all(c > 0.99999 and n < f"{1000:064x}" for k, v in got.items() if k < f"{1000:064x}" for n, c in v)


def test_an_unusable_row_of_a_key_on_the_border(spark):
    at = lambda c: np.r_[c, (1 - c * c) ** 0.5, np.zeros(6)]
    rows = [("a", at(1.0)), ("b", at(0.900005))] + [(k, [np.nan] * 7 + [float(i)]) for i in range(20) for k in "ab"]
    assert [(r.key_a, r.key_b) for r in N.similar_pairs(frame(spark, rows)).collect()] == [("a", "b")]
