"""The 47 expected values of two policies, from pages in our own words to the share of right fields."""

from pyspark.sql import functions as F

from parchment.operators import clauses, cleaning, evaluation, sections

#: What the two policies' fields are.
EXPECTED = {
    "uin": ("NILHLIP21001V012122", "NILHLIP24007V022425"), "sum_insured": (500000, 1000000), "annual_premium": (14800, 21600), "pre_hospitalization_days": (30, 60), "post_hospitalization_days": (60, 180),
    "ped_waiting_period_months": (48, 36), "specific_disease_waiting_period_months": (24, 24), "initial_waiting_period_days": (30, 30), "copayment_percentage": (10.0, 0.0), "room_rent_limit_present": (True, False), "icu_limit_present": (True, False),
    "restoration_benefit": (False, True), "no_claim_bonus": (True, True), "maternity_covered": (False, True), "child_coverage": (True, True), "domiciliary_covered": (False, True), "ayush_covered": (True, True), "day_care_covered": (True, True),
    "opd_covered": (None, False), "cashless_available": (True, True), "reimbursement_available": (True, True), "grace_period_days": (30, 30), "disease_sub_limit_count": (4, 1), "exclusion_count": (18, 17),
}
EXCLUDED = ["Tests alone", "Rest cure", "Weight control", "Change of appearance", "Beauty surgery", "Hazardous sport", "Breach of law", "Unlisted providers", "Addiction", "Wellness stays", "Supplements", "Eye refraction", "Unproven treatment", "Sterility", "Maternity"]


def pages(plan, uin, schedule, cover, pay, limits, wait, coded):
    head = f"Hillcrest Health Insurance Company Limited | {plan}\n"
    one = head + f"HILLCREST HEALTH INSURANCE COMPANY LIMITED\n{plan} - Policy Wording\nUIN: {uin}\nPREAMBLE\nThis is a contract of insurance.\nPOLICY SCHEDULE\n{schedule}\nELIGIBILITY\nDependent children from 91 days to 25 years can be included.\n"
    one += "SECTION A - DEFINITIONS\nA.1 Pre-existing Disease means one found within 48 months prior to the start.\nSECTION B - COVERAGE\n1.1 In-patient Hospitalisation\nIn-patient care is payable.\n"
    one += "".join(f"1.{i} {title}\n{said}\n" for i, (title, said) in enumerate(cover, 2)) + "Page 1"
    two = head + f"SECTION C - CO-PAYMENT AND SUB-LIMITS\n2.1 Co-payment\n{pay}\n2.2 Sub-limits\n{limits}\nSECTION D - WAITING PERIODS\nD.1 Pre-Existing Diseases - Code Excl01\nSuch diseases are excluded until the expiry of {wait} months of continuous coverage.\n"
    two += "D.2 Specified Diseases - Code Excl02\nListed conditions are excluded until the expiry of 24 months of continuous coverage.\nD.3 Initial Waiting Period - Code Excl03\nIllness within 30 days of the start is excluded.\nPage 2"
    three = head + "SECTION E - EXCLUSIONS\nNothing is paid for what follows.\n" + "".join(f"E.{i} {x} - Code Excl{i + 3:02d}\nSuch expenses are excluded.\n" for i, x in enumerate(EXCLUDED[:coded], 1)) + "Page 3"
    four = head + "SECTION F - CLAIM PROCEDURE\nF.1 Cashless Claims\nCashless care needs notice within 48 hours of admission.\nF.2 Reimbursement Claims\nReimbursement needs the claim form and the bills within 30 days.\nSECTION G - RENEWAL\nG.1 Grace Period\nA grace period of 30 days is allowed.\nPage 4"
    return [one, two, three, four]


BASIC = pages(
    "Hillcrest Basic Plan", "NILHLIP21001V012122", "Sum Insured: Rs. 5,00,000 on family floater basis. Annual premium: Rs. 14,800 with taxes. Policy period: 1 year.",
    [("Room Rent", "Room rent is payable up to 1% of the Sum Insured per day."), ("Intensive Care", "ICU charges are payable up to 2% of the Sum Insured per day."), ("Pre-hospitalisation Expenses", "Expenses of the 30 days before admission are covered."),
     ("Post-hospitalisation Expenses", "Expenses of the 60 days after discharge are covered."), ("Day Care", "Day care treatment is covered."), ("Care at Home", "Domiciliary hospitalisation is not covered."), ("AYUSH", "AYUSH treatment is covered."),
     ("Refill", "Restoration benefit is not available under this plan."), ("Cumulative Bonus", "A cumulative bonus of 5% is added each year.")],
    "Each claim has a co-payment of 10%. For persons of 61 or more it is 20%.", "Cataract is limited to Rs. 40,000 per eye. Knee replacement is limited to Rs. 1,50,000. Hernia surgery is limited to Rs. 50,000. Dialysis is limited to Rs. 1,00,000 a year.", 48, 15,
)
PLUS = pages(
    "Hillcrest Plus Plan", "NILHLIP24007V022425", "Sum Insured: Rs. 10,00,000 on family floater basis. Annual premium: Rs. 21,600 with taxes. Policy period: 1 year.",
    [("Room Rent", "There is no capping on room rent."), ("Intensive Care", "ICU charges are payable at actuals."), ("Pre-hospitalisation Expenses", "Expenses of the 60 days before admission are covered."), ("Post-hospitalisation Expenses", "Expenses of the 180 days after discharge are covered."),
     ("Day Care", "Day care treatment is covered."), ("Care at Home", "Domiciliary hospitalisation is covered."), ("AYUSH", "AYUSH treatment is covered."), ("OPD", "OPD visits are not covered."), ("Refill", "The Sum Insured is restored once a year."),
     ("Cumulative Bonus", "A cumulative bonus of 10% is added each year."), ("Maternity", "Maternity expenses are covered up to Rs. 50,000 after 24 months.")],
    "There is no co-payment under this policy. Persons who join at 65 or later bear a co-payment of 15%.", "Cataract is limited to Rs. 60,000 per eye.", 36, 14,
)


def test_47_of_47(spark):
    raw = spark.createDataFrame([(d, i + 1, t) for d, p in (("basic", BASIC), ("plus", PLUS)) for i, t in enumerate(p)], "doc_id string, page int, text string")
    clean = cleaning.clean_pages(raw)
    lines = sections.sectioned(sections.page_lines(clean)).cache()
    got = clauses.extract(clean, lines, sections.sentences(lines), raw).withColumn("disease_sub_limit_count", F.size("disease_sub_limits"))
    truth = [(d, f, str(v[i]).lower() if isinstance(v[i], bool) else str(v[i])) for i, d in enumerate(("basic", "plus")) for f, v in EXPECTED.items() if v[i] is not None]
    assert len(truth) == 47
    checked = evaluation.checked(spark.createDataFrame(truth, "doc_id string, field string, expected string"), evaluation.long_form(got, list(EXPECTED))).collect()
    assert len(checked) == 47 and [(r.doc_id, r.field) for r in checked if not r.correct] == []
