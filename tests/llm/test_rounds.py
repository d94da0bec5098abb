"""Phrases, shards and draws towards a target, against plain loops; and what odd tables give."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchment.llm import op11_phrases, op12_shards, op13_target
from parchment.llm.ranks import ranked

R = random.Random(5)
FEW = ["the", "The", "red", "Fox", "jumps", "over", "ä", "x1", "é-b", "naïve"]


def said(n):
    return "".join(R.choice(FEW) + R.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(n))


ROWS = [(i, said(R.randrange(60)), R.choice(["en", "en", "de", None]), R.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(400)]
ROWS += [(i, ROWS[7][1], "en", "a") for i in range(400, 600)]  # a group of copies, a third of all
ROWS += [(None, None, None, None), (None, None, None, None), (700, "", "fr", "b"), (701, " \n.", None, "b"), (702, "x" * 100_000, "en", "c"), (703, "wörter " * 30_000, "de", "c"), (5, ROWS[5][1], ROWS[5][2], ROWS[5][3]), (5, "other words " * 12, "en", "b")]
TARGET = [(i, said(30)) for i in range(20)] + [(None, None), (20, "")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(5)
    return rows.withColumns({c: F.lit(1) for c in ("row", "id", "key", "n", "rank", "shard", "weight", "score", "digest", "_part", "a_b")}).withColumn("a.b", F.lit("x"))


def phrases(rows, least):
    """Each language's (phrase, a, l, r, n, score), by loops."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = {}
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        for g, a in found.items():
            longer = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * b >= 80 * a for b in longer):
                s, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                out[lang, " ".join(g)] = (a, c[g[:k]], c[g[k:]], n[lang], s)
    return out


@pytest.mark.parametrize("bits, size", [(op11_phrases.BITS, op11_phrases.SHARD), (64, 300)])  # a full map and small shards change nothing
def test_phrases(docs, monkeypatch, bits, size):
    monkeypatch.setattr(op11_phrases.shards, "__defaults__", (size,))
    got = op11_phrases.collocations(docs, least=6, most_bits=bits).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got} == phrases(ROWS, 6)
    assert len(got) > 50


def test_phrases_ranked(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/a/documents.parquet")
    want = defaultdict(list)
    for (lang, g), x in phrases(ROWS, 30).items():
        want[lang].append((-x[4], -x[0], g.encode()))
    got = defaultdict(list)
    for r in sorted(op11_phrases.op11_suffix_phrases(spark, f"{tmp_path}/a").collect(), key=lambda r: r["rank"]):
        got[r.lang].append((r["rank"], r.phrase.encode()))
    assert got == {k: [(i + 1, x[2]) for i, x in enumerate(sorted(v))][:2000] for k, v in want.items()}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op11_phrases.op11_suffix_phrases(spark, f"{tmp_path}/b").count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    rank = rng.integers(1, 5, 300)
    left = np.concatenate([np.arange(k, 0, -1) for k in (1, 2, 7, 90, 150, 50)])
    order, shared = op11_phrases.suffix_array(rank, left, 4)
    piece = [tuple(rank[i : i + min(4, left[i])]) for i in range(300)]
    assert [piece[i] for i in order] == sorted(piece)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert list(shared) == [0] + [common(piece[a], piece[b]) for a, b in zip(order, order[1:])]


def test_words_that_share_a_hash():
    buf = np.frombuffer(b"ab cd ab", np.uint8)
    start, end = np.array([0, 3, 6]), np.array([2, 5, 8])
    ids = op11_phrases.exact_ids(buf, start, end, np.array([9, 9, 9], np.uint64))
    assert ids[0] == ids[2] != ids[1]


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    big = 5 * 10**12
    rows = [("en", "a b", 2, big - 7), ("en", "a", 1, big), ("en", "b", 1, big + 3), ("en", None, 0, 3 * big)]
    known = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op11_phrases, "frequent_phrases", lambda *a: known)
        assert op11_phrases.collocations(known).first().score == 2_000_000 * (big - 7) // (2 * big + 3)


def test_shards(docs):
    got = op12_shards.sharded(docs, 40).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in ROWS) and all(r["a.b"] == "x" for r in got)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    for source, n in Counter(r[3] for r in ROWS).items():
        mine = Counter(r.shard for r in got if r.source == source)
        assert all(abs(mine[s] - n / 40) < 2 for s in range(40)), source
    again = op12_shards.sharded(docs.repartition(3), 40).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert op12_shards.sharded(docs.limit(0)).count() == 0
    few = op12_shards.sharded(docs.limit(3)).collect()
    assert sorted(r.shard for r in few) == [0, 13, 26] and {r.slot for r in few} == {0}


def test_shard_files(docs, tmp_path, spark):
    op12_shards.write_shards(docs.drop("a.b"), f"{tmp_path}/s", 3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == len(ROWS) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_shard_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_shards.op12_interleaved_shards(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def runs(text, longest):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_target(spark, docs, longest):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    raw, aim = Counter(), Counter()
    for _, t, _, _ in ROWS:
        raw.update(runs(t, longest)[1])
    for _, t in TARGET:
        aim.update(runs(t, longest)[1])
    total, aims = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (total + 10000) / ((raw[b] + 1) * (aims + 10000)))) for b in range(10_000)}
    want = []
    for i, t, _, _ in ROWS:
        n, found = runs(t, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in found)
        want.append((i, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    may = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    places = {x[:4]: k + 1 for k, x in enumerate(may[: len(may) // 10])}
    got = op13_target.drawn(op13_target.weighed(docs, target, longest=longest)).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in want)
    assert {(r.doc_id, r.n_features, r.weight, r.score): r["rank"] for r in got if r["rank"]} == places
    kept = op13_target.resampled(docs, target, longest=longest)
    assert kept.dtypes == docs.dtypes and Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in may[: len(may) // 10])
    assert op13_target.resampled(docs.limit(0), target).count() == 0 and op13_target.resampled(docs, target.limit(0)).count() > 0


def test_copies_are_weighed_once(docs):
    once = op13_target.distinct_texts(docs.select("text"))
    assert once.count() == len({r[1] or "" for r in ROWS}) and once.agg(F.sum("copies")).first()[0] == len(ROWS)


def test_ranks_of_equal_rows(spark):
    """Ranks are 1, 2, 3... even if most rows are equal and groups have one row or most."""
    df = spark.range(3000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id"))).alias("g"), F.lit(1).alias("x"))
    got = defaultdict(list)
    for r in ranked(df, [F.col("x")], "rank", "g").collect():
        got[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and len(got) == 1001
    assert sorted(r["rank"] for r in ranked(df, [F.col("x").desc()], "rank").collect()) == list(range(1, 3001))


def test_slices():
    buf = np.frombuffer("añb c".encode(), np.uint8)
    assert op11_phrases.slices(buf, np.array([0, 1, 5]), np.array([4, 3, 6])).to_pylist() == ["añb", "ñ", "c"]
    assert op11_phrases.slices(buf, np.array([], int), np.array([], int)).cast(pa.string()).to_pylist() == []
