"""Resampling, toxicity and token counts on small fixtures."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parchment.llm import op01_resample as op1
from parchment.llm import op03_toxicity as op3
from parchment.llm import op05_token_counts as op5
from parchment.llm.common import kth_largest
from parchment.llm.op04_packing import tokenizer_path
from parchment.llm.textnp import buffers, shingles, words

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 8))) for _ in range(400)]


def sentence(bad=False, toxic=False):
    ws = [R.choice(VOCAB) for _ in range(R.randint(20, 90))]
    if bad:
        ws = [w.upper() + "!!" for w in ws] if R.random() < 0.5 else [w for w in ws[:4] for _ in range(12)]
    if toxic:
        for w in ("zounds", "fiend", "knave"):
            ws.insert(R.randrange(len(ws)), w)
    return " ".join(ws)


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for i in range(1500):
        bad, toxic = R.random() < 0.2, R.random() < 0.15
        rows.append((i, sentence(bad, toxic), "x"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1500, None, "x"), (1501, "", "x"), (1502, "  ", None), (None, "some text", "x"), (3, rows[3][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int"), labels


def test_words():
    texts = ["Ab c", "", None, "d  E\n", " x", "é"]
    import pyarrow as pa

    buf, offs = buffers(pa.array(texts))
    w = words(buf, offs)
    got = [(int(d), bytes(buf[a:b]).decode()) for d, a, b, _ in zip(*w)]
    assert got == [(0, "Ab"), (0, "c"), (3, "d"), (3, "E"), (4, "x"), (5, "é")]
    assert w.hash[1] != w.hash[2] and len(set(w.hash.tolist())) == 6
    doc, h = shingles(w, 6, 2)
    assert doc.tolist() == [0, 3, 4, 5] and len(set(h.tolist())) == 4


def test_resampling(tables):
    docs, labels, truth = tables
    model, _ = op1.fit(docs, labels)
    kept = {r.doc_id for r in op1.resampled(docs, labels).collect()}
    good = [i for i, q, _ in truth if q]
    bad = [i for i, q, _ in truth if not q]
    assert np.mean([i in kept for i in good]) > 0.98 and np.mean([i in kept for i in bad]) < 0.02
    assert model.k == op1.resampled(docs, labels).count()
    assert op1.resampled(docs, labels).columns == docs.columns


def shape(word):
    kinds = ["a" if c.islower() or ord(c) > 127 else "A" if c.isupper() else "0" if c.isdigit() else c for c in word]
    return "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)


def grams(text):
    ws = (text or "").split()
    for of, seq in (("w", ws), ("s", [shape(w) for w in ws])):
        for i, w in enumerate(seq):
            yield of, w
            yield of + "2", ("again",) if of == "w" and i and seq[i - 1] == w else (seq[i - 1] if i else None, w)


def test_resampling_by_brute_force(spark):
    """Counts by dictionaries, weights, cut, k and draw against the operator's; rows at the k-th key are all kept."""
    g = random.Random(4)
    few = ["alpha", "beta", "Gamma", "d4", "x-y", "zeta", "NO!", "eta"]
    text = lambda bad: " ".join(g.choice(few[4:] if bad and g.random() < 0.6 else few) for _ in range(g.randint(1, 12)))
    rows = [(i, text(i % 4 == 0)) for i in range(300)] + [(300, None), (301, ""), (None, "alpha beta"), (7, "alpha alpha alpha"), (7, "alpha alpha alpha")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 200)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, bad = ({i for i, q, _ in labels if q == k} for k in (1, 0))
    target, raw = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        target.update(grams(t) if i in good else ())
    ratio = {k: np.log((target[k] + 1) / (target.total() + op1.BUCKETS)) - np.log((n + 1) / (raw.total() + op1.BUCKETS)) for k, n in raw.items()}
    weight = [sum(ratio[k] for k in grams(t)) for _, t in rows]
    model, scored = op1.fit(docs, lab)
    got = scored.collect()
    assert sorted(round(r.log_weight, 6) for r in got) == sorted(round(w, 6) + 0.0 for w in weight)
    noise = {r.doc_id: r.key - r.log_weight for r in got}
    g_, b_ = ([w for (i, _), w in zip(rows, weight) if i in s] for s in (good, bad))
    errors = lambda at: np.mean([w < at for w in g_]) + np.mean([w >= at for w in b_])
    cut = op1.best_cut(np.array(g_), np.array(b_))
    assert errors(cut) <= min(errors(w) for w in weight) + 1e-12
    k = sum(w >= cut - 1e-9 for w in weight)
    keys = sorted((w + noise[i] for (i, _), w in zip(rows, weight)), reverse=True)
    want = sorted((str(i), t) for (i, t), w in zip(rows, weight) if w + noise[i] >= keys[k - 1] - 1e-9)
    assert model.k == k and sorted((str(r.doc_id), r.text) for r in op1.resampled(docs, lab).collect()) == want


def test_resampling_without_labels(tables):
    docs, labels, _ = tables
    assert op1.resampled(docs, labels.limit(0)).count() == docs.count()
    assert op1.resampled(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    vals = [float(R.randint(-50, 50)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for k in (1, 2, 1500, 2999, 3000):
        assert kth_largest(df, "v", k, few=10) == sorted(vals, reverse=True)[k - 1]


def test_toxicity(tables):
    docs, labels, truth = tables
    model = op3.fit(docs, labels)
    got = {r.doc_id: r.score for r in op3.scored(docs.drop("score"), model, ["doc_id"]).collect()}
    toxic = {i: t for i, _, t in truth}
    hits = np.array([(got[i] >= 0.5) == bool(t) for i, t in toxic.items()])
    assert hits.mean() > 0.97 and got[1500] == got[1501] < 0.5
    assert all(0 <= s <= 1 for s in got.values())
    assert op3.clean(docs, labels).columns == docs.columns
    assert op3.clean(docs.limit(0), labels).count() == 0
    assert op3.clean(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_counts(spark):
    """Features are counted over all texts outside the held-out fold, and a seldom toxic word gets a weight."""
    g = random.Random(8)
    rows = [(i, " ".join(g.choice(VOCAB) for _ in range(30)) + (" zounds" if i % 8 == 0 else "") + (" quagmired" if i % 80 == 0 else "")) for i in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(3200)], "doc_id long, toxic int")
    model = op3.fit(docs, labels)
    buf, offs = buffers(pa.array(["quagmired", "zounds"]))
    doc, bucket, _ = op3.features(buf, offs)
    assert (model.weights[bucket[doc == 0]] > 0).all() and (model.weights[bucket[doc == 1]] > 0).all()
    texts = {k: [0, 0] for k in (-1, int(bucket[0]))}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % op3.FOLDS:
            for k in texts:
                if k < 0 or k in op3.features(*buffers(pa.array([t])))[1]:
                    texts[k][0] += i % 8 == 0
                    texts[k][1] += 1
    seen = op3.marked(docs, labels.where("toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    got = {r.bucket: [r.p, r.u] for r in op3.counted(seen).collect()}
    assert {k: got[k] for k in texts} == texts


def plain_risk(texts, toxic, w, prior):
    """The non-negative risk by loops over texts: dictionaries of feature: times."""
    f = [w[-1] + sum(w[k] * np.log2(1 + min(n, 7)) for k, n in t.items()) for t in texts]
    loss = lambda x: np.log1p(np.exp(-x))
    p = [x for x, y in zip(f, toxic) if y]
    return prior * np.mean([loss(x) for x in p]) + max(0.0, np.mean([loss(-x) for x in f]) - prior * np.mean([loss(-x) for x in p]))


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_and_gradient_by_loops(spark, prior):
    g = random.Random(3)
    toxic = [i % 5 == 0 for i in range(60)]
    texts = [dict(Counter(g.choices(range(6), k=8)) + Counter({0: 9} if y and i % 2 else {})) for i, y in enumerate(toxic)]
    size = np.array([len(t) for t in texts], np.int32)
    cells = np.array(toxic), size, np.array([k for t in texts for k in t], np.int16), np.array([min(7, n) for t in texts for n in t.values()], np.int8)
    block = spark.createDataFrame([tuple(bytearray(x.tobytes()) for x in part) for part in (cells,)], "p binary, size binary, at binary, n binary")
    sums = op3.summed(block)
    w = np.random.default_rng(1).normal(size=7)
    u, p = sums(w)
    f = lambda w: [w[-1] + sum(w[k] * np.log2(1 + min(n, 7)) for k, n in t.items()) for t in texts]
    assert abs(u[-2] - sum(np.log1p(np.exp(x)) for x in f(w))) < 1e-9 and u[-1] == 60 and p[-1] == 12
    for i in range(7):
        e = 1e-6 * (np.arange(7) == i)
        assert abs(u[i] - sum(np.log1p(np.exp(a)) - np.log1p(np.exp(b)) for a, b in zip(f(w + e), f(w - e))) / 2e-6) < 1e-4
    got, bias = op3.train(lambda w: op3.block_sums(cells, w), 6, prior)
    start = plain_risk(texts, toxic, np.append(np.zeros(6), np.log(prior / (1 - prior))), prior)
    assert plain_risk(texts, toxic, np.append(got, bias), prior) < start


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_token_counts(spark, block):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.encode_special_tokens = True
    texts = [None, "", "a", "b <|endoftext|> c", *(sentence() for _ in range(20)), "", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in op5.counted(docs, block=block).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_scan_tail(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), 10), (str(tmp_path / "b.bin"), 0)], "file string, bytes long")
    got = sorted((r.ordinal, r.start, r.n_tokens) for r in op5.scan(files, 9, 2, 4).collect())
    assert got == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]
