"""Neighbours against brute force: recall, exact scores, ties and odd vectors."""

import numpy as np
import pytest

from parchment.llm import op06_neighbours as op6


def brute(ids, x, q, k=20):
    out = {}
    for i in q:
        s = x @ x[ids.index(i)]
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
        out[i] = [(ids[j], s[j]) for j in order]
    return out


def run(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int").repartition(3)
    got = {}
    for r in sorted(op6.search(op6.valid(df), op6.F.col("vec_id") % 20 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        assert len(got.setdefault(r.query_id, [])) == r.rank - 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("unit", [True, False])
def test_recall(spark, unit):
    r = np.random.default_rng(0)
    x = r.normal(size=(6000, 16)) + 2 * r.normal(size=(8, 16))[r.integers(0, 8, 6000)]
    x[500:1500] = x[7]  # many equal ones
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(float)
    ids = list(range(6000))
    got = run(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x)])
    want = brute(ids, x, range(0, 6000, 20))
    assert got.keys() == want.keys()
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and all(abs(s - x[q] @ x[i]) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda p: (-round(p[1], 9), p[0]))


def test_recall_beyond_the_sample(spark, monkeypatch):
    """Most vectors neither make centroids nor choose ratios; directions without clusters are the hardest case."""
    monkeypatch.setattr(op6, "SAMPLE", 800)
    monkeypatch.setattr(op6, "REST", 400)
    x = np.random.default_rng(1).normal(size=(5000, 24)).astype(np.float32).astype(float)
    got, want = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), brute(list(range(5000)), x, range(0, 5000, 20))
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_a_bound_hands_on_less(spark):
    """Lists that a query asks later hand on only what reaches its bound."""
    x = np.random.default_rng(2).normal(size=(300, 8))
    kept = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "list int, c long, v array<double>")
    asks = spark.createDataFrame([(0, i, x[i].tolist(), (1e9, float("-inf"), 3.0, 3.0, 3.0)[i]) for i in range(5)], "list int, c long, v array<double>, bound double")
    s = x[:5] @ x.T
    want = {q: [(i, s[q][i]) for i in np.argsort(-s[q])[:11] if s[q][i] >= (1e9, -np.inf, 3, 3, 3)[q]] for q in range(5)}
    got = {q: [] for q in range(5)}
    for r in op6._met(kept, asks, 10).orderBy("q", "score", ascending=[True, False]).collect():
        got[r.q].append((r.c, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()} and not got[0] and len(got[1]) == 11


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [nan, 1.0], 1), (1, [inf, 1.0], 1), (2, [None, 1.0], 1), (None, [1.0, 1.0], 1), (3, [1.0, 1.0], 1), (4, [1.0, 1.0], 1), (5, [1.0], 1), (4, [1.0, 1.0], 1)]
    assert run(spark, rows) == {0: [(3, 1.0), (4, 1.0), (20, 0.0)], 20: [(3, 1.0), (4, 1.0), (0, 0.0)]}
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0], 2)]) == {}


def test_the_fit_holds_for_rows_that_made_the_centroids():
    """Without clusters ratios of distances are large near a centroid's own vectors; recall over all rows is what the fit asks for."""
    x = np.random.default_rng(2).normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = op6.fit(x, 1.0 + 1e-9, 2000, 20)
    posts = {}
    for i, at in zip(*index.lists(x, False)[:2]):
        posts.setdefault(at, set()).add(i)
    found = [set() for _ in x]
    for i, at in zip(*index.lists(x, True)[:2]):
        found[i] |= posts.get(at, set())
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    true = np.argpartition(-s, 19, 1)[:, :20]
    assert np.mean([len(f & set(t)) / 20 for f, t in zip(found, true)]) >= op6.WANTED - 0.015
