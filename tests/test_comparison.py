"""Validation and answers on small cases."""

import pytest
from pyspark.sql import functions as F

from parchment.operators import answers, comparison, scoring, validation


@pytest.mark.parametrize("field,value,want", [
    ("ped_waiting_period_months", "4 years", "48"), ("sum_insured", "Rs 5 lakh", "500000"), ("grace_period_days", "1 month", "30"), ("ayush_covered", "Yes", "true"), ("ayush_covered", "perhaps", None),
    ("copayment_percentage", "12.5%", "12.5"), ("insurer_name", " A ", "A"), ("insurer_name", "N/A", None), ("sum_insured", None, None), ("sum_insured", "none at all", None),
])
def test_coerced(spark, field, value, want):
    df = spark.createDataFrame([(field, value)], "f string, v string")
    assert df.select(validation.coerced(F.col("f"), F.col("v")).alias("x")).first().x == want


def test_merged_open(spark):
    own = spark.createDataFrame([("d", 1, "x" * 70), ("d", 2, "b")], "doc_id string, ord int, clause string")
    other = spark.createDataFrame([("d", 1, "x" * 65), ("d", 2, "c")], "doc_id string, ord int, clause string")
    assert [r.clause for r in validation.merged_open(own, other).orderBy("ord").collect()] == ["x" * 70, "b", "c"]


def test_answered(spark):
    rows = [(1, "What is the copay for dialysis?", 1, "Each claim has a co-payment; for a copay of 10% see the list.", 0.5), (2, "Is a room capped?", 1, "Nothing.", 0.05)]
    got = {r.question_id: r for r in answers.answered(spark.createDataFrame(rows, "question_id int, question string, rank int, text string, score double")).collect()}
    assert got[1].grounded and "does not mention: dialysis" in got[1].answer and "[S1]" in got[1].answer
    assert not got[2].grounded and got[2].answer == answers.NOT_FOUND


def test_merged_lists_and_evidence(spark):
    schema = "doc_id int, field string, value string, evidence struct<page: int, quote: string>"
    own = [
        (1, "permanent_exclusions", '["war", "rest cure", "cosmetic"]', (3, "a")), (2, "permanent_exclusions", '["war", "rest cure"]', None), (3, "temporary_exclusions", '["x"]', None), (4, "disease_sub_limits", '["a", "b"]', None),
        (5, "disease_sub_limits", None, None), (1, "copayment_percentage", "10.0", (7, "b")), (2, "copayment_percentage", "10.0", None), (1, "uin", "U1", (1, "c")), (6, "disease_sub_limits", '["a"]', None),
    ]
    said = [
        (1, "permanent_exclusions", '["war", "hazard", " ", ""]', (9, "z")), (2, "permanent_exclusions", '["war", "bed rest"]', None), (3, "temporary_exclusions", "[]", None), (4, "disease_sub_limits", "Cataract: 25%, at most", None),
        (5, "disease_sub_limits", "[1, \"two\", null]", None), (1, "copayment_percentage", "20%", None), (2, "copayment_percentage", "20", (8, "d")), (1, "uin", None, (2, "e")), (1, "made_up", "x", (1, "f")), (6, "disease_sub_limits", "[Cataract", None),
    ]
    got = {(r.doc_id, r.field): r for r in validation.merged(spark.createDataFrame(own, schema), spark.createDataFrame(said, schema)).collect()}
    value = {k: r.value for k, r in got.items()}
    assert value == {
        (1, "permanent_exclusions"): '["war","rest cure","cosmetic"]', (2, "permanent_exclusions"): '["war","bed rest"]', (3, "temporary_exclusions"): '["x"]', (4, "disease_sub_limits"): '["a","b"]',
        (5, "disease_sub_limits"): '["1","two","None"]', (1, "copayment_percentage"): "10.0", (2, "copayment_percentage"): "10.0", (1, "uin"): "U1", (6, "disease_sub_limits"): '["[Cataract"]',
    }
    assert {k: r.evidence and r.evidence.page for k, r in got.items() if k[0] < 3} == {(1, "permanent_exclusions"): 9, (2, "permanent_exclusions"): None, (1, "copayment_percentage"): 7, (2, "copayment_percentage"): 8, (1, "uin"): 2}
    assert "(p.7)" in got[1, "copayment_percentage"].notes[0] and "(p.?)" in got[2, "copayment_percentage"].notes[0] and got[1, "uin"].notes == []


def test_both_notes_of_a_field(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id int, field string, value string")
    got = validation.merged(rows((1, "copayment_percentage", "140.0"), (1, "opd_covered", "false")), rows((1, "copayment_percentage", "20"), (1, "opd_covered", "yes"))).collect()
    notes = {r.field: r.notes for r in got}
    assert [n[:34] for n in notes["copayment_percentage"]] == ["copayment_percentage: LLM read '20", "copayment_percentage=140.0 is outs"]
    assert notes["opd_covered"][0].startswith("opd_covered: LLM read 'True', rule extractor found 'False' (p.?)")


@pytest.mark.parametrize("premium, insured", [(1815, 300000), (1, 3), (605, 100000), (1, 32), (5, 100000), (123456, 1000003), (25, 100000), (3, 32000)])
def test_ratio_is_rounded_as_the_double_that_it_is(spark, premium, insured):
    df = spark.createDataFrame([(premium, insured)], "annual_premium long, sum_insured long")
    got = df.select(scoring.rounded(F.col("annual_premium") / F.col("sum_insured"), 4).alias("r")).first().r
    assert got == round(premium / insured, 4)


def test_cross_checked(spark):
    rows = [(1, 600, 1000, None, "1%", None, ["a", "b"], ["old"]), (2, 500, 1000, False, "1%", 7, ["a"], None), (3, None, 1000, None, "", None, [], []), (4, 5, 0, None, None, None, None, [])]
    df = spark.createDataFrame(rows, "k int, annual_premium long, sum_insured long, room_rent_limit_present boolean, room_rent_limit string, exclusion_count int, permanent_exclusions array<string>, validation_notes array<string>")
    got = [(r.room_rent_limit_present, r.exclusion_count, [n[:7] for n in r.validation_notes]) for r in validation.cross_checked(df).orderBy("k").collect()]
    assert got == [(True, 2, ["old", "Premium"]), (False, 7, []), (None, None, []), (None, None, [])]


def test_pairs_meet_by_lists(spark):
    """Two joins, one for each side; the aspects of a pair don't meet row by row."""
    policy = "policy_id int, x struct<" + ", ".join(f"{k}:double" for _, side, k, _, _ in comparison.ASPECTS if side == "x") + ">, f struct<" + ", ".join(f"{k}:double" for _, side, k, _, _ in comparison.ASPECTS if side == "f") + ">, score int, given struct<sum_insured:double,annual_premium:double>"
    x, f = sum(a[1] == "x" for a in comparison.ASPECTS), sum(a[1] == "f" for a in comparison.ASPECTS)
    policies = spark.createDataFrame([(1, (1.0,) * x, (1.0,) * f, 5, (1.0, 1.0)), (2, (1.0,) * x, (2.0,) * f, 4, (1.0, 1.0))], policy)
    got = comparison.compared(spark.createDataFrame([(7, 1, 2), (8, 2, 1)], "pair_id int, current int, proposed int"), policies)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert got.count() == 2 * (len(comparison.ASPECTS) + 1)
    last = {r.pair_id: (r.current, r.proposed, r.change) for r in got.where("aspect = 'Coverage Clarity Score'").collect()}
    assert last == {7: ("5", "4", "Worse"), 8: ("4", "5", "Improved")}
