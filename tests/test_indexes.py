"""Indexes of many collections, blends of two ranked lists, packed contexts and vectors by decomposition, against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.operators import indexes, latent, retrieval, sections
from parchment.plans import searches

R = random.Random(3)
WORDS = ["".join(R.choice("abcde") for _ in range(R.randint(1, 3))) for _ in range(40)] + ["the", "of"]
TEXTS = [(c, k, " ".join(R.choice(WORDS) for _ in range(R.randrange(40)))) for c in range(6) for k in range(R.choice([1, 3, 30]))] + [(7, 1, ""), (7, 2, "the of"), (8, 1, None)]
QUESTIONS = [(q, " ".join(R.choice(WORDS) for _ in range(12))) for q in range(5)] + [(5, "zzz unknown"), (6, "")]
STOP = ["the", "of"]


def terms(text):
    w = [x for x in re.findall(r"\b\w\w+\b", (text or "").lower()) if x not in STOP]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute():
    out, groups = {}, defaultdict(dict)
    for c, k, t in TEXTS:
        groups[c][k] = terms(t)
    for c, texts in groups.items():
        df = Counter(t for x in texts.values() for t in x)
        idf = {t: math.log((len(texts) + 1) / (n + 1)) + 1 for t, n in df.items()}
        unit = lambda x: (lambda v: {t: w / math.sqrt(sum(z * z for z in v.values())) for t, w in v.items()})({t: (1 + math.log(n)) * idf[t] for t, n in x.items() if t in idf})  # noqa: E731, B023
        rows = {k: unit(x) for k, x in texts.items()}
        for q, t in QUESTIONS:
            qv = unit(terms(t))
            for k, v in rows.items():
                s = sum(w * v[t] for t, w in qv.items() if t in v)
                if s:
                    out[c, q, k] = s
    return out


@pytest.mark.parametrize("apart", [False, True])
def test_index_of_each_collection(spark, apart):
    texts = spark.createDataFrame(TEXTS, "c long, k long, text string")
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    asks = texts.select("c").distinct().crossJoin(questions.select("query_id"))
    index = indexes.indexed(texts, "c", "k", questions, STOP, apart)
    got = {(r.c, r.query_id, r.k): r.sparse for r in indexes.sparse_scores(index, "c", "k", asks, questions, STOP).collect()}
    want = brute()
    assert got.keys() == want.keys() and len(want) > 200 and all(abs(got[x] - want[x]) < 1e-9 for x in want)


@pytest.mark.parametrize("k, listed", [(5, 5), (3, 1), (2, 16)])
def test_fused_lists_equal_the_full_blend(spark, k, listed):
    """Some texts are in one list only, some scores are equal, some collections have no vectors."""
    s = {(c, q, i): round(R.random(), 1) for c in range(4) for q in range(3) for i in range(60) if R.random() < 0.5}
    d = {(c, q, i): R.choice([R.random(), 0.5, -0.3]) for c in range(3) for q in range(3) for i in range(60) if R.random() < 0.8}
    want = {}
    for c in range(4):
        for q in range(3):
            blend = {i: (0.45 * s.get((c, q, i), 0) + 0.55 * max(d.get((c, q, i), 0), 0)) if c < 3 else s.get((c, q, i), 0) for i in range(60)}
            want[c, q] = [i for i in sorted(blend, key=lambda i: (-round(blend[i], 6), i)) if blend[i] > 0][:k]  # noqa: B023
    sparse = spark.createDataFrame([(*x, v) for x, v in s.items()], "c long, query_id long, i long, sparse double")
    dense = spark.createDataFrame([(*x, v) for x, v in d.items()], "c long, query_id long, i long, dense double")
    mode = spark.createDataFrame([(c, c < 3) for c in range(4)], "c long, hybrid boolean")
    got = defaultdict(list)
    for r in sorted(indexes.fused(sparse, dense, "c", "i", mode, k, listed).collect(), key=lambda r: r["rank"]):
        got[r.c, r.query_id].append(r.i)
    assert got == want
    assert indexes.fused(sparse.limit(0), dense.limit(0), "c", "i", mode, k).count() == 0


def test_packed(spark):
    rows = [(g, q, r, R.randrange(8), R.randrange(1, 60)) for g in range(30) for q in range(3) for r in range(1, 5)]
    rows = [(g, q, r, k, k * 7 + 5) for g, q, r, k, _ in rows]
    want = {}
    for g in range(30):
        keys, size = [], 0
        for q in range(3):
            for _, _, _, k, n in sorted(x for x in rows if x[:2] == (g, q)):
                if k in keys:
                    continue
                if size + n > 90:
                    break
                keys.append(k)
                size += n
        want[g] = (keys, size)
    got = indexes.packed(spark.createDataFrame(rows, "g long, query int, rank int, key long, size long"), ["g"], 90)
    assert {r.g: (r.parts, r["size"]) for r in got.collect()} == want


def test_chunks_of_odd_documents(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "x" * 5000 + "\n" + "y" * 30), (4, "\n".join(f"line {i} " + "z" * 60 for i in range(100))), (5, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sections.chunks(searches.document_lines(spark, str(tmp_path))).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.chunk)):
        by[r.doc_id].append(r.text)
    assert set(by) == {3, 4} and len(by[3]) == 2 and by[3][0].startswith("[Part 1]\nxxx")
    assert all(f"line {i} " in "\n".join(by[4]) for i in range(100))


@pytest.fixture(scope="module")
def matrix(spark):
    topics = [[f"w{t}x{i}" for i in range(25)] for t in range(6)]
    texts = [(i, " ".join(R.choice(topics[i % 6]) for _ in range(60))) for i in range(150)] + [(900, ""), (901, None)]
    return texts, spark.createDataFrame(texts, "k long, text string").repartition(4)


def test_decomposition(spark, matrix):
    """Singular values and the subspace are those of numpy on the whole matrix."""
    _, df = matrix
    model = latent.fit(df, "k", [], rank=6, columns=512, more=10, passes=4)
    rows, _ = latent.rows_of(df, "k", [], 512)
    a = np.zeros((152, 512))
    for i, r in enumerate(rows.collect()):
        a[i, r["_at"]] = r["_w"]
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.strength, s[:6], rtol=1e-3)
    assert np.linalg.norm(model.basis.T @ vt[:6].T, 2) <= 1 + 1e-9 and np.linalg.svd(model.basis.T @ vt[:6].T)[1].min() > 0.99


def test_near_vectors_are_of_one_topic(spark, matrix):
    texts, df = matrix
    model = latent.fit(df, "k", [], rank=6, columns=1 << 12)
    got = {r.k: r.v for r in model.vectors(df, "k").collect()}
    assert got[900] is None and got[901] is None and len(got) == 152
    v = np.array([got[i] for i in range(150)])
    near = np.argsort(-(v @ v.T), 1)[:, :6]
    assert np.mean(near % 6 == (np.arange(150) % 6)[:, None]) > 0.95
    assert np.allclose((v * v).sum(1), 1)


def test_rows_of_unknown_terms(spark, matrix):
    _, df = matrix
    model = latent.fit(df, "k", [], rank=6, columns=1 << 12)
    other = spark.createDataFrame([(1, "w0x1 w0x2"), (2, "nothing of these")], "query_id long, text string")
    got = {r.query_id: r.v for r in model.vectors(other, "query_id").collect()}
    assert len(got[1]) == 6 and set(got) == {1, 2}


def test_products_of_few_and_of_many_queries(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "k long, v array<double>")
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(4)], "query_id long, qv array<double>")
    want = {(q, i): i + q for q in range(4) for i in range(30)}
    for few in (10, 2):
        assert {(r.query_id, r.k): r.dense for r in retrieval.dense_scores(queries, vectors, "k", few).collect()} == want


def test_terms_counted_within_a_row(spark):
    rows = [(i, t) for i, (_, _, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r.k: sorted(x.tf for x in r.c or []) for r in df.select("k", retrieval.counted_terms(F.col("text"), STOP).alias("c")).collect()}
    assert got == {i: sorted(terms(t).values()) for i, t in rows}


def test_found_terms_are_those_of_own_questions(spark):
    """Scores are the same if a collection lists only terms of its questions, wherever batches are cut."""
    texts = spark.createDataFrame(TEXTS, "c long, k long, text string").withColumn("page", F.col("k") + 1)
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    asks = texts.select("c", (F.col("c") % 3).alias("query_id")).distinct()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in (1, 7, 1000):
            spark.conf.set(name, size)
            index = indexes.indexed(texts, "c", "k", questions, STOP, asks=asks)
            rows = index.collect()
            assert len(rows) == len(TEXTS) and all(r.page == r.k + 1 for r in rows)
            assert all(len(r.found) <= len(terms(QUESTIONS[r.c % 3][1])) for r in rows)
            got = {(r.c, r.query_id, r.k): r.sparse for r in indexes.sparse_scores(index, "c", "k", asks, questions, STOP).collect()}
            want = {x: s for x, s in brute().items() if x[1] == x[0] % 3}
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    finally:
        spark.conf.set(name, before)


def test_heads_of_blocks_hold_the_best(spark):
    """Equal vectors, products below 0, missing labels, a null vector: the five best are those of all pairs."""
    vec = [(i, [R.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] if i != 7 else None, R.choice([0, 1, None])) for i in range(300)]
    vectors = spark.createDataFrame(vec, "k long, v array<double>, label int")
    queries = vectors.where("k % 9 = 0 AND v IS NOT NULL").select(F.col("k").alias("query_id"), F.col("v").alias("qv"), F.col("label").alias("ql"))
    want = {}
    for q, qv, ql in vec[::9]:
        scores = [(0.55 * max(sum(x * y for x, y in zip(qv, v)), 0) * (1.15 if label is not None and label == ql else 1), i) for i, v, label in vec if v]
        want[q] = [i for s, i in sorted(scores, key=lambda x: (-round(x[0], 6), x[1])) if s > 0][:5]
    rows = retrieval.dense_heads(queries, vectors, "k")
    got = retrieval.top_k(rows.withColumn("score", 0.55 * F.greatest("dense", F.lit(0.0)) * F.when(F.col("same"), 1.15).otherwise(1.0)), "k").collect()
    assert rows.count() <= len(want) * 4 * 15
    assert {q: [r.k for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want


def test_lexical_heads_of_blocks(spark, monkeypatch):
    """Many blocks and pieces, few queries at once: copies, keys of two rows, null and short texts, unknown terms; against plain loops."""
    monkeypatch.setattr(retrieval, "LETTERS", 200)
    monkeypatch.setattr(retrieval, "PIECE", 4)
    monkeypatch.setattr(retrieval, "ASKED", 3)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("sea Öl wind x rock tide_2 the foam is".split()) for _ in range(rng.randrange(12))) for _ in range(150)]
    docs = [*enumerate(texts), (0, "sea of glass"), *[(i, "rock tide foam") for i in range(200, 240)], (300, None), (301, "")]
    asked = [*enumerate(texts[:6]), (7, "rock tide foam"), (8, "never seen"), (9, None), (10, "rock glass never")]

    def counts(rows):
        out = {}
        for i, t in rows:
            w = re.findall(r"\w\w+", (t or "").lower())
            out.setdefault(i, Counter()).update([*w, *map(" ".join, zip(w, w[1:]))])
        return out

    own = counts(docs)
    df = Counter(t for c in own.values() for t in c)

    def unit(c):
        w = {t: (1 + math.log(n)) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t, n in c.items() if df[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    units, want = {i: unit(c) for i, c in own.items()}, {}
    for q, c in counts(asked).items():
        scores = [(-round(sum(v * u.get(t, 0) for t, v in unit(c).items()), 6), i) for i, u in units.items()]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:5], 1)}
    frames = spark.createDataFrame(docs, "k long, text string").repartition(3), spark.createDataFrame(asked, "query_id int, text string")
    rows = retrieval.lexical_heads(*frames, "k", []).cache()
    got = {(r.query_id, r["rank"]): (r.k, round(r.score, 6)) for r in retrieval.top_k(rows, "k").collect()}
    assert got == want and {q for q, _ in got} == {*range(6), 7, 10} - {i for i in range(6) if not unit(counts(asked)[i])}
    scored = sum(1 for c in counts(asked).values() for u in units.values() if unit(c).keys() & u.keys())
    monkeypatch.undo()
    assert retrieval.lexical_heads(*frames, "k", []).count() < scored  # not a row for each pair that shares a term


def test_texts_are_split_once(spark, monkeypatch):
    """Frequencies, passes and the vectors of the texts themselves come from rows that were split once; more rows than one matrix holds, and one without terms."""
    words = ["room", "rent", "care", "claim", "bonus", "cover", "limit", "share"]
    texts = [(i, " ".join(words[(i * j + j * j) % 8] for j in range(3 + i % 9))) for i in range(2 * latent.ROWS + 5)] + [(-1, ""), (-2, None)]
    df = spark.createDataFrame(texts, "k long, text string")
    split = []
    monkeypatch.setattr(latent, "term_list", lambda *a: split.append(a) or retrieval.term_list(*a))
    model = latent.fit(df, "k", [], rank=4, columns=64)
    own = {r.k: r.v for r in model.own().collect()}
    assert len(split) == 1
    other = {r.k: r.v for r in model.vectors(df, "k").collect()}
    assert len(own) == len(texts) and own[-1] is None and own[-2] is None
    assert all((v is None and own[k] is None) or np.allclose(v, own[k], atol=1e-12) for k, v in other.items())
