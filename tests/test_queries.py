"""Registered queries on small tables of their own."""

import hashlib
import re

from parchment.operators import answers
from parchment.plans import queries as plans

#: The reference's masks, by Python's re.
MASKS = [
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"), (r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)", "[PHONE]"), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "[PAN]"), (r"(?<!\d)\d{4}\s?\d{4}\s?\d{4}(?!\d)", "[AADHAAR]"),
    (r"(?i)(policy\s*(?:no|number)\.?\s*[:\-]?\s*)([A-Z0-9/\-]{6,})", r"\1[POLICY_NO]"), (r"(?i)((?:insured|proposer|policyholder)(?:'s)?\s*name\s*[:\-]\s*)([A-Za-z .]{3,40})", r"\1[NAME]"),
    (r"(?i)(date of birth|dob)\s*[:\-]?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\1: [DOB]"),
]


def test_personal_data_masked(spark, tmp_path):
    texts = [
        "call 9876543210 or +91 9876543210, not 19876543210", "ids 1234 5678 9012, 123456789012 and 1234567890123", "Policy No: 987654321098 of +91-6123456789", "Policy No: AB/12345-6, dob 1/2/90\nInsured name: A. Bee",
        "a.b@c.de 9876543210 ABCDE1234F 9876543210", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        for pattern, put in MASKS if t else []:
            t = re.sub(pattern, put, t)
        want[i] = t if t is None else hashlib.md5(t.encode()).hexdigest()
    assert {r.doc_id: r.masked_md5 for r in plans.personal_data_masked(spark, str(tmp_path)).collect()} == want


def test_sentences_are_dealt_by_question(spark):
    """Hits of one file on all cores: one shuffle, below the sentences; short sentences and equal heads go, ties go to the better hit, then to the earlier sentence."""
    long = "Documents for admission are kept by the hospital desk"
    hits = [(1, "Which documents for admission?", 1, f"Documents. {long} here. The admission documents are sent within days of it."), (1, "Which documents for admission?", 2, f"{long} there.\nAdmission needs 3 documents of the kind stated."), (2, "Which documents?", 1, None), (3, "Is it paid?", 1, "Nothing that is asked for stands in here at all.")]
    got = answers.sentences(spark.createDataFrame(hits, "question_id long, question string, rank int, text string").coalesce(1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate")
    assert [(r.question_id, r.n, r["rank"], r.sentence, r.score) for r in got.orderBy("question_id", "n").collect()] == [
        (1, 1, 2, "Admission needs 3 documents of the kind stated.", 5.9), (1, 2, 1, f"{long} here.", 5.7), (1, 3, 1, "The admission documents are sent within days of it.", 5.7),
    ]
