"""Text expressions on small cases."""

import pytest
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import cleaning, scoring
from parchment.operators.evaluation import same_value


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,out", [
    ("call 9876543210 now", "call [PHONE] now"), ("PAN ABCDE1234F", "PAN [PAN]"), ("id 1234 5678 9012.", "id [AADHAAR]."), ("a.b@c.de x", "[EMAIL] x"),
    ("Policy No: AB/12345-6", "Policy No: [POLICY_NO]"), ("DOB: 01/02/1990", "DOB: [DOB]"), ("1987654321012", "1987654321012"),
])
def test_masks(spark, text, out):
    assert one(spark, T.anonymize(F.col("t")), t=text) == out


def test_sentences(spark):
    assert one(spark, F.size(T.sentences(F.col("t"))), t="Pay Rs. 5,000 per day. Next one.") == 2
    assert one(spark, T.sentences(F.col("t")), t="See 2.1. Then e.g. This; And that.") == ["See 2.1. Then e.g. This;", "And that."]
    assert one(spark, T.sentences(F.col("t")), t="  ") == []


@pytest.mark.parametrize("line,cat,head", [
    ("o. Maternity: Code - Excl18:", "exclusions", True), ("Code - Excl02 waiting", "waiting_period", True), ("SECTION D CO-PAYMENT", "copay_limits", True),
    ("This is a plain sentence about nothing.", None, False), ("7.15 Room Rent", "copay_limits", True), ("ab", None, False), ("Claims, and so on,", "claims", False),
])
def test_headings(spark, line, cat, head):
    assert one(spark, T.category(F.col("t")), t=line) == cat
    assert one(spark, T.heading(F.col("t")), t=line) is head


@pytest.mark.parametrize("line,want", [("7.15 Room", ("n", "7", 2)), ("SECTION D", ("a", "d", 1)), ("Part 2 x", ("n", "2", 1)), ("D.1 Foo", ("a", "d", 2)), ("Foo", None)])
def test_section_number(spark, line, want):
    got = one(spark, T.section_number(F.col("t")), t=line)
    assert (tuple(got) if got else None) == want


def test_guardrails(spark):
    assert one(spark, T.asks_advice(F.col("t")), t="Should I buy this policy?")
    assert not one(spark, T.asks_advice(F.col("t")), t="What is covered?")
    assert "should buy" not in one(spark, T.sanitize(F.col("t")), t="You should buy this policy")


def test_rupees(spark):
    for n, u, want in (("5", "lakh", 500_000), ("1,000", None, 1000), ("1.5", "Crore", 15_000_000)):
        assert spark.sql("select 1").select(T.rupees(F.lit(n), F.lit(u)).alias("x")).first().x == want


def test_clean_pages(spark):
    head, pages = "Policy wording {}", []
    for i in range(4):
        pages.append(("d", i, head.format(i) + f"\nline {i} of hos-\npital care\n• item – x\n\nfiller a{i}\nfiller b{'x' * i}\nPage {i}"))
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    got = {r.page: r.text for r in cleaning.clean_pages(df).collect()}
    assert len(got) == 4 and all("Policy wording" not in t and "Page" not in t and "hospital care" in t and "• item - x" in t for t in got.values())


def test_scores(spark):
    base = dict.fromkeys(["waiting_period_months", "pre_existing_disease_waiting_period_months", "room_rent_limit_present", "icu_limit_present", "disease_sub_limit_count", "restoration_benefit_present", "no_claim_bonus_present", "child_coverage_present", "maternity_coverage_present", "claim_process_clarity_score", "ambiguous_clause_count"], 0)
    row = base | {"sum_insured": None, "annual_premium": 10_000, "copayment_percentage": 20.0, "exclusion_count": 20}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if 'copay' in k else 'long'}" for k in row))
    r = scoring.scored(scoring.featured(df)).first()
    assert r.unclear == ["sum_insured"] and r.sum_insured == 1_000_000 and r.premium_to_coverage_ratio == 0.01
    assert [f.feature for f in r.flags] == ["copayment_percentage", "exclusion_count", "restoration_benefit_present", "claim_process_clarity_score"]
    assert r.raw_score == 103 - 28 - 15 and r.label == "Moderate Coverage" and [x.feature for x in r.reasons] == ["risk_flags_count", "copayment_percentage"]


@pytest.mark.parametrize("a,b,want", [(None, "x", None), ("true", "True", True), ("5", "5.0000001", True), ("5", None, False), (" ab", "AB", True), ("10", "ten", False)])
def test_same_value(spark, a, b, want):
    assert spark.sql("select 1").select(same_value(F.lit(a).cast("string"), F.lit(b).cast("string")).alias("x")).first().x is want


def test_blanks_of_all_kinds(spark):
    """White space is what str.split takes for it and nothing else, at the ends and between words."""
    signs = [c for c in map(chr, range(0x3001)) if c.isspace()]
    assert sorted(signs) == sorted(T.BLANKS)
    for c in [*signs, "\u200b", "\ufeff", "\0"]:
        t = f"{c}one{c}{c}two {c}"
        assert one(spark, F.struct(T.strip(F.col("t")), T.word_count(F.col("t")), T.quote(F.col("t"))), t=t) == (t.strip(), len(t.split()), " ".join(t.split()))
