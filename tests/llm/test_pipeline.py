"""The pipeline's stages in order, each on what its predecessor kept."""

import random

import corpus_pipeline

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 8))) for _ in range(500)]


def text(n=60):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def tables(spark, folder):
    rows, labels = [], []
    for i in range(900):
        t, kind = text(), i % 10
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if kind == 1:
            t += " zounds you fiend you knave"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    base = text(200)
    near = base.rsplit(" ", 1)[0] + " other"
    rows += [(1000, base, "en", "s", len(base)), (1001, near, "en", "s", len(near)), (1002, rows[5][1], "en", "s", 0), (1003, None, "en", "s", None), (1004, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = tables(spark, tmp_path)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id for r in docs.collect()}
    ids = range(900)
    assert not [i for i in ids if i % 10 == 1 and i in seen["toxicity"]] and sum(i in seen["toxicity"] for i in ids if i % 10 != 1) > 800
    assert not [i for i in ids if i % 10 == 0 and i in seen["quality"]]
    assert 1002 not in seen["line_dedup"] and {1000, 1001, 1003, 1004} & seen["quality"] <= seen["line_dedup"]
    assert 1000 in seen["near_dedup"] and 1001 not in seen["near_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == seen["near_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
