"""Sections, sentences, chunks and clauses of small policies."""

import pytest
from pyspark.sql import functions as F

from parchment.operators import clauses, cleaning, sections
from parchment.storage import dealt, nearby, once_each

PAGES = [
    "Northlake Health Insurance Company Limited | Northlake Plan\nNORTHLAKE HEALTH INSURANCE COMPANY LIMITED\nNorthlake Family Plan - Policy Wording\nUIN: NLKHLIP21001V012122\nPREAMBLE\nThis is a contract of insurance.\n"
    "POLICY SCHEDULE\nSum Insured: Rs. 5,00,000 on family floater basis. Annual premium: Rs. 14,800 with tax. Policy period: 1 year.\nELIGIBILITY\nDependent children can be covered.\n"
    "SECTION A - DEFINITIONS\nA.1 Pre-existing Disease means any disease diagnosed within 48 months prior to the start.\nSECTION B - COVERAGE\n1.1 In-patient Hospitalisation\nIn-patient care is payable.\n"
    "1.2 Room Rent and ICU Charges\nRoom rent is payable up to 1% of the Sum Insured. ICU expenses are payable up to 2% of it.\n1.3 Pre-hospitalisation Expenses\nExpenses during the 30 days before admission are covered.\n"
    "1.4 Road Ambulance\nAmbulance is paid up to Rs. 2,000.\n1.5 Day Care Procedures\nDay care treatment is covered.\n1.6 Domiciliary care\nDomiciliary care is not covered here.\nPage 1",
    "Northlake Health Insurance Company Limited | Northlake Plan\nSECTION C - CO-PAYMENT AND SUB-LIMITS\n2.1 Co-payment\nEvery claim has a co-payment of 10% of the amount.\n2.2 Sub-limits\n"
    "Cataract is limited to Rs. 40,000. Knee or joint replacement is limited to Rs. 1,50,000. Robotic surgery and oral chemotherapy are limited to 50% of the Sum Insured.\n"
    "SECTION D - WAITING PERIODS\nD.1 Pre-Existing Diseases - Code Excl01\nSuch treatment is excluded until the expiry of 24/36 months of continuous coverage.\nD.2 Specified Disease - Code Excl02\nListed conditions are excluded until the expiry of 2 years of continuous coverage:\n"
    "9. Cataract\n1. Hernia\nD.3 First 30 Days - Code Excl03\nIllness within 30 days from the start is excluded.\nPage 2",
    "Northlake Health Insurance Company Limited | Northlake Plan\nSECTION E - EXCLUSIONS\nE.1 Investigation - Code Excl04\nDiagnostics only.\nE.2 Rest Cure - Code Excl05\nBed rest.\nE.3 Maternity - Code Excl18\nMaternity expenses are excluded.\nE.4 War\nWar is out.\nE.5 Non-payable items\nGloves are not payable.\nPage 3",
    "Northlake Health Insurance Company Limited | Northlake Plan\nSECTION F - CLAIM PROCEDURE\nF.1 Cashless Claims\nCashless care needs notice within 24 hours of admission, please.\nThe claim form and bills are documents to submit.\nF.2 Settlement\nThe Company shall settle or reject a claim within 30 days.\n"
    "It may ask for more at its sole discretion.\nSECTION G - RENEWAL\nG.1 Grace Period\nA grace period of 15 days is allowed. The policy is ordinarily renewable.\nPage 4",
]


@pytest.fixture(scope="module")
def parts(spark):
    raw = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(PAGES)] + [("list", 1, "6. Waiting Period\nListed are the following.\n9. Cataract surgery\n5. Older care\n7.1 Hernia\n8. Claims process"), ("empty", 1, ""), ("none", 1, None)], "doc_id string, page int, text string")
    clean = cleaning.clean_pages(raw)
    lines = sections.sectioned(sections.page_lines(clean)).cache()
    return raw, clean, lines, sections.sentences(lines).cache()


def test_sections(parts):
    rows = parts[2].where("doc_id = 'a'").orderBy("page", "line_no").collect()
    cat = {r.title: r.category for r in rows}
    assert rows[0].title.startswith("NORTHLAKE") and rows[0].first
    assert cat["D.1 Pre-Existing Diseases - Code Excl01"] == "waiting_period" and cat["E.4 War"] == "exclusions"
    assert cat["E.3 Maternity - Code Excl18"] == "exclusions" and cat["F.2 Settlement"] == "claims"
    assert all("Page" not in r.line for r in rows)
    listed = {r.title: r.category for r in parts[2].where("doc_id = 'list'").collect()}  # 9 skips sections, 5 goes back
    assert listed == {"6. Waiting Period": "waiting_period", "7.1 Hernia": "waiting_period", "8. Claims process": "claims"}


def test_sentences(parts):
    s = {r.text: r for r in parts[3].where("doc_id = 'a'").collect()}
    assert s["D.1 Pre-Existing Diseases - Code Excl01"].heading and not s["Bed rest."].heading
    assert s["Bed rest."].low == "e.2 rest cure - code excl05 :: bed rest."
    assert sorted(r.ord for r in s.values()) == list(range(1, len(s) + 1))


def test_clauses(parts):
    raw, clean, lines, sents = parts
    got = {r.doc_id: r for r in clauses.extract(clean, lines, sents, raw).collect()}
    r = got["a"].asDict()
    want = {
        "insurer_name": "Northlake Health Insurance Company Limited", "uin": "NLKHLIP21001V012122", "policy_name": "| Northlake Plan", "policy_type": "Family Floater", "sum_insured": 500_000, "annual_premium": 14_800, "policy_term_years": 1.0,
        "pre_hospitalization_days": 30, "post_hospitalization_days": None, "inpatient_hospitalization": True, "day_care_covered": True, "domiciliary_covered": False, "ayush_covered": None, "restoration_benefit": None, "maternity_covered": False,
        "child_coverage": True, "ped_waiting_period_months": 36, "specific_disease_waiting_period_months": 24, "initial_waiting_period_days": 30, "copayment_percentage": 10.0, "room_rent_limit_present": True, "icu_limit_present": True,
        "exclusion_count": 6 + 1, "non_payable_items_mentioned": True, "cashless_available": True, "reimbursement_available": None, "claim_documents_listed": True, "claim_intimation_timeline": "within 24 hours of admission",
        "claim_settlement_timeline": "within 30 days", "grace_period_days": 15, "portability_mentioned": None,
    }
    assert {k: r[k] for k in want} == want
    assert [x.split(":")[0] for x in r["disease_sub_limits"]] == ["Cataract", "Knee", "Modern Treatments"]
    assert [a.split(":")[0] for a in r["ambiguous_clauses"]] == ["p.4", "p.2"] and "24/36 months" in r["ambiguous_clauses"][1]
    assert r["evidence"]["ped_waiting_period_months"]["page"] == 2 and "ayush_covered" not in r["evidence"]
    for k in ("empty", "none"):
        assert got[k].sum_insured is None and got[k].exclusion_count is None and got[k].ambiguous_clauses == []


def chunked(lines, title, size, overlap):
    """The plain way, one line after the other."""
    out, buf, n = [], [], 0
    for i, x in enumerate(lines):
        buf.append(x)
        n += len(x) + 1
        if n >= size or i == len(lines) - 1:
            body = "\n".join(buf)
            if len(body.strip()) > 25:
                out.append(body if body.startswith(title) else f"[{title}]\n{body}")
            keep = []
            while buf and sum(map(len, keep)) < overlap:
                keep.insert(0, buf.pop())
            buf, n = keep, sum(map(len, keep))
    return out


@pytest.mark.parametrize("size,overlap", [(1000, 150), (120, 40), (60, 10)])
def test_chunks(parts, size, overlap):
    lines = parts[2]
    blocks = {}
    for r in lines.where("doc_id = 'a'").orderBy("page", "line_no").collect():
        blocks.setdefault((r.block, r.title), []).append(r.line)
    want = [c for (_, t), b in blocks.items() for c in chunked(b, t, size, overlap)]
    assert [r.text for r in sections.chunks(lines, size, overlap).where("doc_id = 'a'").orderBy("chunk").collect()] == want


def test_plans_named_by_long_numbers(spark):
    """Five digits make a line a registration, except at the end of a plan's name if plans are numbered."""
    front = "HARBOUR LIGHT COMPANY LIMITED\nCare Plan {} - Policy Wording\nHealth plan of reg 12345\nPOLICY SCHEDULE"
    rows = spark.createDataFrame([(n, front.format(n)) for n in (9_999, 10_000, 899_999)], "n long, front string")
    of = lambda numbered: {r.n: r.name for r in rows.select("n", clauses.policy_name(F.col("front"), F.lit(None).cast("string"), numbered).alias("name")).collect()}
    assert of(True) == {n: f"Care Plan {n}" for n in (9_999, 10_000, 899_999)}
    assert of(False) == {9_999: "Care Plan 9999", 10_000: "POLICY SCHEDULE", 899_999: "POLICY SCHEDULE"}


def test_nothing_of_each_document_is_broadcast(spark, parts):
    """The planner counts a text of any length as 20 bytes; joins of rows of documents go by a shuffle whatever it thinks."""
    raw, clean, lines, sents = parts
    for df in (cleaning.clean_pages(raw), sections.sectioned(sections.page_lines(clean)), clauses.extract(clean, lines, sents, raw)):
        plan = df._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents_are_dealt_once(spark):
    """Pages are dealt by document; lines, sections, sentences and rules need no further shuffle, and what is looked at once for many documents is as if looked at in each."""
    rows = [(f"{d}", i + 1, t.replace("Northlake", f"North {d}")) for d in range(3) for i, t in enumerate(PAGES)]
    raw = dealt(spark.createDataFrame([*rows, ("empty", 1, ""), ("none", 1, None)], "doc_id string, page int, text string"), "doc_id")
    made = []
    for repeating in (False, True):
        clean = nearby(cleaning.clean_pages(raw))
        lines = nearby(sections.sectioned(sections.page_lines(clean), repeating))
        sents = nearby(sections.sentences(lines, repeating))
        hits = clauses.chosen(sents, repeating)
        for df in (clean, sections.sectioned(sections.page_lines(clean)), sections.sentences(lines), clauses.chosen(sents)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        made.append([sorted(map(str, df.collect())) for df in (lines, sents, hits)])
    assert made[0] == made[1] and len(made[0][2]) == 3


def test_frequent_keys_are_looked_at_once(spark):
    rows = spark.createDataFrame([("a", True)] * 3 + [("a", False), ("b", True), ("x" * 2000, True), ("x" * 2000, True)], "t string, f boolean")
    got = once_each(rows, ["t", "f"], "n", lambda k: F.when(k["f"], F.length(k["t"])))
    assert sorted(str((r.t[:1], r.f, r.n)) for r in got.collect()) == sorted(map(str, [("a", True, 1)] * 3 + [("a", False, None), ("b", True, 1), ("x", True, 2000), ("x", True, 2000)]))
