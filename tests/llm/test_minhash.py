"""Signatures against exact similarity, classes against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from parchment.llm import op08_minhash as op8

R = random.Random(8)


def jaccard(s, t):
    """By how often each run of five words occurs."""

    def sh(x):
        w = (x or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    a, b = sh(s), sh(t)
    return (a & b).total() / (a | b).total() if a | b else 0.0


def rows():
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: [R.choice(vocab) for _ in range(n)]
    out = [None, "", "  ", "one", "One ", "two words", "two  WORDS", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = text(R.randint(30, 200))
        out.append(" ".join(base))
        for _ in range(R.randint(0, 4)):
            t = list(base)
            for _ in range(R.randint(0, 4)):
                t[R.randrange(len(t))] = R.choice(vocab)
            out.append(" ".join(t))
    out += [out[-1]] * 3
    base = text(60)  # near as sets of shingles, not as weighted ones
    out += [" ".join(base), " ".join(base + base), " ".join(base * 3), " ".join(base * 3 + ["end"])]
    out += [" ".join(text(30_000))]
    out += [out[-1] + " more"]
    base = text(150)  # a long chain: each text near the next
    for _ in range(30):
        base = list(base)
        base[R.randrange(150)] = "new" + str(R.random())
        out.append(" ".join(base))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(rows())], "doc_id long, text string, a string, label int").repartition(4)


def brute(texts):
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "").lower().split() == (texts[j] or "").lower().split() and (texts[i] or "").split()
            if same or jaccard(texts[i], texts[j]) >= 0.8:
                links += 1
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(texts))]


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    n, k = 400, 2000
    x, y = r.integers(0, 4, n) / 2, r.integers(0, 4, n) / 2
    el = r.integers(0, 2**63, n).astype(np.uint64)
    doc = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    sig = op8.dart_signatures(doc, np.concatenate([el[x > 0], el[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, k)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_classes(docs):
    texts = rows_of(docs)
    got = {r.doc_id: r.class_id for r in op8.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def rows_of(docs):
    return [r.text for r in docs.orderBy("doc_id").collect()]


def test_deduplicated(docs, spark):
    texts = rows_of(docs)
    firsts = {i for i, c in enumerate(brute(texts)) if i == c}
    out = op8.deduplicated(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == firsts
    odd = spark.createDataFrame([(None, "same words here"), (None, "Same words here"), (7, "same words  here"), (7, "same words  here"), (7, "other"), (8, None), (8, None), (None, "x y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "") for r in op8.deduplicated(odd).collect())
    assert got == sorted([("7", "same words  here"), ("7", "other"), ("8", ""), ("8", ""), ("None", "x y")])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op8.classes(none).count() == 0 and op8.deduplicated(none).count() == 0


def test_parity_sketch_never_differs_in_more_bits_than_sets_do():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3_000, n)).astype(np.uint64) for n in (0, 1, 40, 900, 2_500)]
    doc = np.concatenate([np.full(len(x), i) for i, x in enumerate(sets)])
    weights = [rng.integers(1, 4, len(x)) for x in sets]
    got = op8.parity(doc, np.concatenate(sets), np.concatenate(weights), len(sets)).view(np.uint64)
    bags = [Counter(dict(zip(x.tolist(), n.tolist()))) for x, n in zip(sets, weights)]
    for i, x in enumerate(bags):
        for j, y in enumerate(bags):
            apart = sum(int(a ^ b).bit_count() for a, b in zip(got[i], got[j]))
            assert apart <= ((x | y) - (x & y)).total() and (apart == 0 or i != j)


def test_texts_that_share_a_digest_stay_apart(spark, monkeypatch):
    real = op8.digest

    def small(w, docs):
        a, b, has = real(w, docs)
        return a & 7, b, has

    monkeypatch.setattr(op8, "digest", small)
    texts = [f"word{i} of text {i} that no other one has, number {i * i}" for i in range(40)] * 2
    signs, clashing = op8.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert 5 < len(clashing) <= 8
    got = signs.groupBy("a").agg(op8.F.countDistinct("b").alias("n")).collect()
    assert len(got) == 40 and all(r.n == 1 for r in got)
