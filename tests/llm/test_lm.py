"""The language model against plain counting, and its probabilities' sum."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parchment.llm import op09_lm as op9

R = random.Random(2)
TONGUES = [["".join(R.choice(s) for _ in range(R.randint(1, 6))) for _ in range(300)] for s in ("abcde", "fghij", "klméß")]


def texts(n=400):
    out = [None, "", " \t\n", "Ab aB\x0bab\x1cab AB", "ÀÀ àà"]
    for _ in range(n):
        t = R.choice(TONGUES)
        out.append(" ".join(R.choice(t[:20]) if R.random() < 0.5 else R.choice(t) for _ in range(R.randint(0, 80))))
    return out


@pytest.fixture(scope="module")
def docs():
    return texts()


def brute(docs):
    toks = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for t in docs]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(docs))]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for t in toks]
    return toks, held, c, n, base


@pytest.mark.parametrize("frequent", [1 << 18, 40])
def test_base_and_counts(spark, docs, frequent, monkeypatch):
    monkeypatch.setattr(op9, "FREQUENT", frequent)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in op9.scored(df).collect()}
    toks, held, c, n, base = brute(docs)
    assert len(got) == len(docs)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - base[i]) < 1e-6
    out = [i for i, h in enumerate(held) if h]
    assert sum(got[i].score for i in out) > sum(base[i] for i in out)


def test_sums_to_one():
    pairs = np.zeros((op9.CLASSES, op9.CLASSES))
    pairs[op9.START, :5] = 10
    pairs[:5, 3:9] = 20
    pairs[:9, op9.END] = 5
    logs = op9.train(pairs, rounds=50)
    assert np.allclose((10.0**logs).sum(1), 1)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op9.scored(none).count() == 0
    one = spark.createDataFrame([(None, None), (None, "a"), (4, "a a")], "doc_id long, text string")
    assert op9.scored(one).count() == 3
