"""Pages by ranges of bytes, reports by two steps, streams that can be replayed, and the registry of models."""

import os
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from parchment.operators import models, registry, reports
from parchment.sources import pages
from parchment.streaming import ingest


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_no_page_is_lost_at_any_split(spark, tmp_path, split):
    r = random.Random(split)
    text = "\f".join("".join(r.choice("aö\n ") for _ in range(r.randrange(12))) for _ in range(25))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(text.encode())
    (tmp_path / "in" / "end.txt").write_bytes(b"one\ftwo\f")
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    (tmp_path / "in" / "other.pdf").write_bytes(b"x")
    got, bad = pages.read(spark, str(tmp_path / "in"), split=split, suffix=".txt")
    by = {}
    for p in got.orderBy("page").collect():
        by.setdefault(p.doc_id, []).append(p.text)
    want = text.split("\f")
    assert by["a.txt"] == (want if want[-1] else want[:-1]) and by["end.txt"] == ["one", "two"]
    assert [tuple(x) for x in bad.collect()] == [("empty.txt", 0, "empty")]


def test_rejects(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"%HEAD good\f\xff\xfe bad")
    (tmp_path / "b.dat").write_bytes(b"none" * 100)
    got, bad = pages.read(spark, str(tmp_path), head="%HEAD", split=50)
    assert [(p.doc_id, p.page) for p in got.orderBy("page").collect()] == [("a.dat", 1), ("a.dat", 2)]
    assert {(x.doc_id, x.error) for x in bad.collect()} == {("a.dat", "not UTF-8 at byte 0"), ("b.dat", "another kind of file")}


def test_page_by_page_choice(spark):
    schema = "doc_id string, page int, text string"
    first = spark.createDataFrame([("a", 1, "x" * 50), ("a", 2, "few"), ("a", 3, "  "), ("a", 4, "some")], schema)
    other = spark.createDataFrame([("a", 1, "y" * 90), ("a", 2, "much more of it"), ("a", 3, None), ("a", 5, "new")], schema)
    got = {r.page: (r.text, r.ocr) for r in pages.chosen(first, other).collect()}
    assert got == {1: ("x" * 50, False), 2: ("much more of it", True), 3: ("  ", False), 4: ("some", False), 5: ("new", True)}


def test_reports_are_whole_or_not_there(spark, tmp_path):
    clauses = spark.createDataFrame([("a/b", 1, "UIN", "U1", "p.1"), ("a/b", 2, "Term", "1", "-"), ("c", 1, "UIN", "U2", "p.3")], "doc_id string, ord int, label string, value string, page string")
    text = spark.createDataFrame([("c", 1, "why")], "doc_id string, ord int, text string")
    pages.write_reports(reports.sections(clauses, text, text.limit(0)), f"{tmp_path}/out")
    names = sorted(os.listdir(f"{tmp_path}/out"))
    assert len(names) == 3 and names[-1] == "c.md" and names[1].startswith("a_b-") and os.listdir(f"{tmp_path}/out/_temporary") == []
    assert open(f"{tmp_path}/out/c.md").read() == "## clauses\n\n| UIN | U2 | p.3 |\n\n## reasons\n\n- why"
    fail = F.raise_error(F.lit("lost"))
    rows = spark.createDataFrame([("x.md", 1), ("y.md", 2)], "name string, i int").coalesce(1).select("name", F.when(F.col("i") == 2, fail).otherwise(F.lit("body")).alias("body"))
    spark.dataSource.register(pages.Reports)
    with pytest.raises(Exception):  # noqa: B017
        rows.write.format("reports").mode("append").option("path", f"{tmp_path}/half").save()
    assert not [n for n in os.listdir(f"{tmp_path}/half") if n.endswith(".md")] and os.listdir(f"{tmp_path}/half/_temporary") == [] if os.path.exists(f"{tmp_path}/half") else True


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    documents = ingest.Documents(spark, f"{tmp_path}/docs")
    schema = "doc_id long, text string, changed long"
    put = lambda name, *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put("1", (1, "a", 1), (2, "b", 1), (1, "a2", 2))
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    ingest.kept_up(stream(), documents, f"{tmp_path}/check").awaitTermination(60)
    assert {(r.doc_id, r.text) for r in documents.read().collect()} == {(1, "a2"), (2, "b")}
    put("2", (2, "old", 0), (3, "c", 5))
    ingest.kept_up(stream(), documents, f"{tmp_path}/check").awaitTermination(60)
    want = {(1, "a2"), (2, "b"), (3, "c")}
    assert {(r.doc_id, r.text) for r in documents.read().collect()} == want
    last = documents.versions()[-1]
    documents.upsert(spark.createDataFrame([(9, "again", 9)], schema), last)
    assert {(r.doc_id, r.text) for r in documents.read().collect()} == want and documents.versions()[-1] == last
    (tmp_path / "docs" / "v99").mkdir()  # a batch that was broken off
    assert documents.versions()[-1] == last
    documents.upsert(spark.createDataFrame([(3, "c2", 9)], schema), 99)
    assert {(r.doc_id, r.text) for r in documents.read().collect()} == {(1, "a2"), (2, "b"), (3, "c2")}


def test_last_answers_of_a_session(spark, tmp_path):
    schema = "session string, at long, answer string"
    rows = [("s", i, f"a{i}") for i in range(12)] + [("t", 1, "only")]
    for k, part in enumerate((rows[6:], rows[:6])):  # late ones too
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []
    q = ingest.last_answers(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    final = {r.session: r.answers for r in got}
    batch = reports.latest(spark.createDataFrame(rows, schema), "session", "at").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("at", "answer"))).alias("l")).select("session", "l.answer").collect()
    assert final == {r.session: r.answer for r in batch} and len(final["s"]) == 8


def test_registry(spark, tmp_path):
    root = f"{tmp_path}/models"
    os.makedirs(root)
    stage = lambda v: PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {v}D AS prediction FROM __THIS__")])
    assert registry.obtained(spark, root) == (None, "rules")
    registry.publish(root, (stage(1), stage(50)), {"best": "one"})
    version = registry.publish(root, (stage(2), stage(60)), {"best": "two"})
    models.save(f"{root}/versions/half", stage(3), stage(3))  # written, but not named by the manifest
    pair, how = registry.obtained(spark, root)
    assert how == f"loaded {version}" and pair[0].transform(spark.range(1)).first().prediction == 2 and registry.manifest(root)["metrics"] == {"best": "two"}
    os.rename(f"{root}/versions/{version}/classifier", f"{root}/gone")
    assert registry.obtained(spark, root) == (None, "rules")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(models, "train", lambda df, **_: (stage(4), stage(5), {"n": df.count()}))
        pair, how = registry.obtained(spark, root, spark.range(3))
        assert how.startswith("trained") and registry.manifest(root)["metrics"] == {"n": 3}
        assert registry.obtained(spark, root)[1].startswith("loaded") and registry.obtained(spark, f"{root}/none", spark.range(0)) == (None, "rules")
