"""Sources, replies, models and the path from clauses to features, on small fixtures."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from parchment.functions import replies
from parchment.operators import analysis, models, scoring
from parchment.sources import files


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\nlines", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"no")
    (tmp_path / "d.pdf").write_bytes(b"")
    good, bad = files.documents(spark, str(tmp_path), b"%PDF-", "*.pdf")
    assert {r.doc_id for r in good.collect()} == {"b.pdf"} and {r.doc_id for r in bad.collect()} == {"c.pdf"}
    got = files.pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.doc_id, r.page, r.text, r.ocr) for r in got] == [("a.txt", 1, "one", False), ("a.txt", 2, "two\nlines", False)]
    (tmp_path / "t.json").write_text('{"_note": {"x": 1}, "p.pdf": {"_why": "n", "uin": "U1", "ok": true, "n": 5}}')
    assert {(r.doc_id, r.field, r.expected) for r in files.truths(spark, str(tmp_path / "t.json")).collect()} == {("p.pdf", "uin", "U1"), ("p.pdf", "ok", "true"), ("p.pdf", "n", "5")}
    (tmp_path / "q.csv").write_text('id,q,a\n1,"two\nlines","say ""x"""\n2,b,\n')
    assert [tuple(r) for r in files.questions(spark, str(tmp_path / "q.csv"), "id int, q string, a string").orderBy("id").collect()] == [(1, "two\nlines", 'say "x"'), (2, "b", "")]
    assert [tuple(r) for r in files.first_rows(spark, str(tmp_path / "q.csv"), 1, "id int, q string, a string").select("id").collect()] == [(1,)]
    assert files.templates(spark, str(tmp_path)) == {"a": "one\ftwo\nlines"}
    for kind in ("csv", "json", "parquet"):
        df = spark.createDataFrame([(1, 'a\n"b"')], "i int, s string")
        files.save_table(df, str(tmp_path / kind), kind)
        read = spark.read.schema("i int, s string").options(header=True, multiLine=True, escape='"').format(kind).load(str(tmp_path / kind))
        assert [tuple(r) for r in read.collect()] == [(1, 'a\n"b"')]


@pytest.mark.parametrize("said, want", [("groq  # note", "groq"), ('"quoted"', "quoted"), (" 'x' ", "x"), ("", "base"), ("a#b", "a#b")])
def test_setting(said, want):
    assert files.setting("NAME", "base", {"NAME": said}) == want


def test_replies(spark):
    raw = ['```json\n{"a": 1}\n```', 'Sure {"a": {"b": 2}} ok', "[1]", "none", "{broken", None, ""]
    got = [r.j for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").orderBy("i").select(replies.json_reply(F.col("raw")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": {"b": 2}}', "[1]", None, None, None, None]
    one = spark.range(1).select(replies.plain_glyphs(F.lit("₹  5 – 6 ≥ 7")).alias("g"), replies.bold(F.lit("a < **b**")).alias("b"), analysis.short(F.lit("word " * 40)).alias("s"), analysis.slim(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(""), F.lit("evidence"), F.lit("y"))).alias("m")).first()
    assert one.g == "Rs 5 - 6 >= 7" and one.b == "a &lt; <b>b</b>" and one.s == " ".join(["word"] * 22) + "…" and one.m == {"a": "x"}


def policies(spark, n=500):
    """Features in their ranges, flags by the rules, a noisy score by the published weights and a label by its bands."""
    g, rows = random.Random(42), []
    for i in range(n):
        r = {k: g.uniform(lo, hi) if k in ("premium_to_coverage_ratio", "copayment_percentage") else g.randint(lo, hi) for k, (lo, hi) in scoring.RANGES.items()}
        r |= {k: g.randint(0, 1) for k in analysis.PRESENT} | {"policy_id": i, "policy_type": g.choice([*scoring.TYPES, "Other"]), "noise": g.gauss(0, 3)}
        rows.append(r)
    df = scoring.flagged(spark.createDataFrame(rows)).withColumn("coverage_clarity_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), scoring.raw_score() + F.col("noise"))))
    return df.withColumn("risk_label", scoring.label(F.col("coverage_clarity_score"))).drop("noise").cache()


def test_models(spark, tmp_path):
    df = policies(spark)
    own = {"labelCol": "label", "featuresCol": "features"}
    makers = {"Tree": lambda: DecisionTreeClassifier(maxDepth=2, weightCol="weight", seed=1, **own), "Linear": lambda: LogisticRegression(maxIter=60, regParam=0.003, weightCol="weight", **own)}
    classifier, regressor, metrics = models.train(df, makers=makers, rounds=15)
    assert metrics["best_model"] == "Linear" and metrics["model_comparison"]["Linear"]["test_accuracy"] > 0.7
    assert metrics["score_regressor"]["test_r2"] > 0.5 and metrics["n_train"] + metrics["n_test"] == 500 and metrics["rule_baseline"]["test_accuracy"] > 0.7
    models.save(str(tmp_path), classifier, regressor)
    got = models.served(df.drop("risk_label"), models.load(spark, str(tmp_path))).select("label", "rule_label", "score", "confidence", "agreement", "label_display").collect()
    assert len(got) == 500 and all(0 <= r.score <= 100 and 0 < r.confidence <= 1 and r.agreement == (r.label == r.rule_label) for r in got)
    assert any(r.label_display == "High Risk / Needs Advisor Review" for r in got)
    assert models.load(spark, str(tmp_path / "none")) is None


def test_score_reasons_before_rounding(spark):
    """0.65 of co-payment is 0.4875 points: no reason, though it rounds to half a point."""
    df = policies(spark, 3).withColumn("copayment_percentage", F.lit(0.65))
    assert all("copayment_percentage" not in [x.feature for x in r.reasons] for r in scoring.scored(df).collect())


def test_features_from_clauses(spark):
    x = spark.createDataFrame(
        [("a", "Dental", None, 0, 24, None, 10.0, True, None, ["x", "y"], 7, False, None, True, None, [], True, None, "within 24 hours", None, None, {"copayment_percentage": (4, "q")}),
         ("b", "Group Health", 600000, 9000, None, 48, 45.0, None, False, [], None, None, True, False, True, ["v"], None, True, None, True, "within 30 days", {})],
        "doc_id string, policy_type string, sum_insured long, annual_premium long, specific_disease_waiting_period_months int, ped_waiting_period_months int, copayment_percentage double, room_rent_limit_present boolean, icu_limit_present boolean, "
        "disease_sub_limits array<string>, exclusion_count int, restoration_benefit boolean, no_claim_bonus boolean, maternity_covered boolean, child_coverage boolean, ambiguous_clauses array<string>, cashless_available boolean, "
        "reimbursement_available boolean, claim_intimation_timeline string, claim_documents_listed boolean, claim_settlement_timeline string, evidence map<string, struct<page: int, quote: string>>",
    )
    own = spark.createDataFrame([("a", 0, 20000)], "doc_id string, sum_insured long, annual_premium long")
    a, b = analysis.features(x, own).orderBy("doc_id").collect()
    assert (a.policy_type, b.policy_type) == ("Individual Health", "Group Health") and (a.sum_insured, a.annual_premium, b.annual_premium) == (1_000_000, 20000, 9000)
    assert a.unclear == ["Sum insured", "Pre-existing disease waiting period", "ICU limit"] and b.unclear == ["Specified-disease waiting period", "Exclusion list", "Room rent limit", "Restoration benefit"]
    assert (a.room_rent_limit_present, a.icu_limit_present, a.disease_sub_limit_count, b.copayment_percentage, b.ambiguous_clause_count) == (1, 0, 2, 30, 1)
    assert (a.claim_process_clarity_score, b.claim_process_clarity_score) == (61, 74) and (a.pre_existing_disease_waiting_period_months, b.exclusion_count) == (36, 13)
    profile = F.struct(F.lit(70).alias("age"), F.lit(True).alias("has_ped"), F.lit(True).alias("planning_child"), F.lit(True).alias("adding_child")).alias("profile")
    risks = {r.doc_id: r.risks for r in analysis.risk_flags(analysis.features(x, own).withColumn("profile", profile), F.array(F.lit("p.2: 24/36"))).collect()}
    said = [(r.severity, r.flag, r.source) for r in risks["a"]]
    assert ("High", "Co-payment of 10% or more", "p.4") in said and ("High", "Co-payment applies and policyholder age is 70", "p.4") in said
    assert ("Verify", "ICU limit not clearly found in the document", "-") in said and said[-1][1] == "Extraction cross-check" and risks["a"][-1].why == "p.2: 24/36"
    assert "Maternity cover not found but a child is planned" not in [s[1] for s in said] and "Maternity cover not found but a child is planned" in [r.flag for r in risks["b"]]
