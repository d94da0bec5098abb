"""What every operator makes of odd tables: clashing names, nulls, repeated rows, very long texts, none at all."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import op01_resample, op02_digest, op03_toxicity, op04_packing, op05_token_counts, op07_bpe, op08_minhash, op09_lm, op10_lines

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 8))) for _ in range(300)]
ODD = ["a.b", "row", "id", "t", "key", "n", "marks", "score", "log_weight", "__log_weight", "__key", "__toxic", "__t", "__kept", "doc", "label", "c0"]


def said(n, *more):
    ws = [R.choice(WORDS) for _ in range(n)]
    for m in more:
        ws.insert(R.randrange(len(ws)), m)
    return " ".join(ws)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, said(40, *(["zounds", "fiend"] if i % 6 == 0 else [])) + "\n" + said(30)) for i in range(240)]
    labels = [(i, int(i % 7 != 0), int(i % 6 == 0)) for i in range(200)]
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in rows]
    rows += [(None, None), (None, None), (300, None), (301, ""), (302, " \n "), (5, rows[5][1]), (5, rows[5][1]), (5, "another text of this id"), (None, rows[8][1]), (400, said(60_000)), (401, "x" * 200_000), (402, "y " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.withColumns({c: F.lit(1) for c in ODD if c != "a.b"}).withColumn("a.b", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


STAGES = {
    "toxicity": op03_toxicity.clean, "quality": op01_resample.resampled, "line_dedup": lambda d, _: op10_lines.deduplicated(d),
    "near_dedup": lambda d, _: op08_minhash.deduplicated(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_columns_pass(tables, name):
    docs, labels = tables
    out = STAGES[name](docs, labels)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert 0 < len(got) <= docs.count() and all(r["a.b"] == "x" and r["row"] == 1 for r in got)
    none = STAGES[name](docs.limit(0), labels)
    assert none.columns == docs.columns and none.count() == 0
    # rows without words stay and so do long texts, in all but a quality cut
    if name != "quality":
        assert {300, 301, 302, 400} <= {r.doc_id for r in got}


RESULTS = {
    "op1": lambda d, lab: op01_resample.fit(d, lab)[1], "op2": lambda d, _: op02_digest.fingerprints(d), "op4": lambda d, _: op04_packing.pack(d).where("piece = 0"),
    "op5": lambda d, _: op05_token_counts.counted(d), "op7": lambda d, _: op07_bpe.digests(d), "op8": lambda d, _: op08_minhash.classes(d), "op9": lambda d, _: op09_lm.scored(d),
}


@pytest.mark.parametrize("name", RESULTS)
def test_a_row_for_each(tables, name):
    """Null and repeated ids, repeated rows, empty and very long texts, clashing columns: as many rows as documents."""
    docs, labels = tables
    got = RESULTS[name](docs, labels).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert RESULTS[name](docs.limit(0), labels).count() == 0


def test_pipeline_over_odd_tables(spark, tables, tmp_path):
    docs, labels = tables
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    kept = {r.doc_id for r in got}
    assert {300, 301, 302} <= kept and not kept & {i for i in range(0, 240, 6)}
    assert sum(r.doc_id == 5 and r.piece == 0 for r in got) <= 2  # of three rows two are the same
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
