"""Values from another reader (long form, as text): typed, checked, merged with the rules' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Words for no value, yes and no; plausible ranges; fields where the rules' value stands.
NO_VALUE = ["", "null", "none", "n/a", "na", "not mentioned", "not found", "unknown"]
YES = ["true", "yes", "covered", "available", "1"]
NO = ["false", "no", "not covered", "excluded", "not available", "0"]
PLAUSIBLE = {
    "copayment_percentage": (0, 100), "ped_waiting_period_months": (0, 96), "specific_disease_waiting_period_months": (0, 96), "initial_waiting_period_days": (0, 365), "pre_hospitalization_days": (0, 365),
    "post_hospitalization_days": (0, 365), "grace_period_days": (0, 120), "sum_insured": (10_000, 1_000_000_000), "annual_premium": (100, 5_000_000), "policy_term_years": (0.5, 5),
}
RULE_STANDS = [
    "copayment_percentage", "ped_waiting_period_months", "specific_disease_waiting_period_months", "initial_waiting_period_days", "room_rent_limit_present", "icu_limit_present", "restoration_benefit",
    "maternity_covered", "newborn_covered", "opd_covered", "domiciliary_covered", "pre_hospitalization_days", "post_hospitalization_days",
]
INTS = ["sum_insured", "annual_premium", "pre_hospitalization_days", "post_hospitalization_days", "ped_waiting_period_months", "specific_disease_waiting_period_months", "initial_waiting_period_days", "grace_period_days", "exclusion_count"]
FLOATS = ["policy_term_years", "copayment_percentage"]
BOOLS = [
    "inpatient_hospitalization", "day_care_covered", "domiciliary_covered", "ayush_covered", "opd_covered", "restoration_benefit", "no_claim_bonus", "maternity_covered", "newborn_covered", "child_coverage",
    "room_rent_limit_present", "icu_limit_present", "non_payable_items_mentioned", "cashless_available", "reimbursement_available", "claim_documents_listed", "portability_mentioned", "moratorium_mentioned",
]
LISTS = ["disease_sub_limits", "permanent_exclusions", "temporary_exclusions"]
TEXTS = [
    "insurer_name", "policy_name", "uin", "policy_type", "sum_insured_options", "family_members_covered", "age_band", "coverage_category", "ambulance_cover", "restoration_details", "no_claim_bonus_details",
    "maternity_details", "child_coverage_details", "copayment_conditions", "room_rent_limit", "icu_limit", "claim_intimation_timeline", "claim_settlement_timeline", "renewal_conditions",
]
#: What another reader is asked for: exclusions are counted, not asked.
FIELDS = [f for f in [*INTS, *FLOATS, *BOOLS, *LISTS, *TEXTS] if f != "exclusion_count"]
MOST_OPEN = 15


def number(field: Column, value: Column) -> Column:
    """The first number, with its unit: lakh and crore, years in fields of months, months in fields of days."""
    low = F.regexp_replace(F.lower(value), ",", "")
    pattern = r"(\d+(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|years?|months?)?"
    n, unit = F.regexp_extract(low, pattern, 1).try_cast("double"), F.regexp_extract(low, pattern, 2)
    factor = (
        F.when(unit.startswith("lakh") | unit.startswith("lac"), 100_000).when(unit.startswith("crore"), 10_000_000)
        .when(unit.startswith("year") & field.endswith("_months"), 12).when(unit.startswith("month") & field.endswith("_days"), 30).otherwise(1)
    )
    return n * factor


def items(value: Column) -> Column:
    """A list's items that aren't blank; a text that is no JSON array is one item."""
    held = F.when(strip(value).startswith("["), F.from_json(value, "array<string>"))
    listed = F.filter(F.transform(held, lambda x: F.coalesce(x, F.lit("None"))), lambda x: strip(x) != "")
    return F.when(value.isNotNull(), F.coalesce(listed, F.array(value)))


def coerced(field: Column, value: Column) -> Column:
    """value as text of its field's type, a list as a JSON array; null where it says nothing or doesn't fit."""
    low = F.lower(F.trim(value))
    n = number(field, value)
    flag = F.when(low.isin(YES), "true").when(low.isin(NO), "false")
    typed = F.when(field.isin(INTS), F.bround(n, 0).cast("long").cast("string")).when(field.isin(FLOATS), n.cast("string")).when(field.isin(BOOLS), flag).when(field.isin(LISTS), F.to_json(items(value))).otherwise(F.trim(value))
    return F.when(value.isNull() | low.isin(NO_VALUE), None).otherwise(typed)


def checked(rows: DataFrame) -> DataFrame:
    """(doc_id, field, value, notes) and evidence, if rows have it: values out of range go and leave a note, after those that rows have."""
    f = F.col("field")
    bound = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in PLAUSIBLE.items() for x in (k, float(v[i]))]), f)
    label = F.try_element_at(F.create_map(*[F.lit(x) for k, v in PLAUSIBLE.items() for x in (k, f"[{v[0]}, {v[1]}]")]), f)
    out = F.coalesce(~F.col("value").try_cast("double").between(bound(0), bound(1)), F.lit(False))
    note = F.array_compact(F.array(F.when(out, F.concat(f, F.lit("="), "value", F.lit(" is outside the plausible range "), label, F.lit(" - ignored.")))))
    notes = F.concat("notes", note) if "notes" in rows.columns else note
    return rows.select("doc_id", "field", F.when(~out, F.col("value")).alias("value"), notes.alias("notes"), *[c for c in rows.columns if c == "evidence"])


def merged(rules: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, field, value, notes) of rules and other(doc_id, field, value), one row a field; evidence too, if one of them has it.

    A value that the other reader lacks is the rules'; where the rules' value stands and they differ, a note says so,
    and where the value that is kept is out of range, a second one.
    Of two lists the longer one wins, the other reader's if both are as long. The other reader's evidence goes over the rules'.
    """
    proof = lambda df: [F.col("evidence")] if "evidence" in df.columns else []
    f = F.col("field")
    o = other.where(f.isin(FIELDS)).select("doc_id", "field", coerced(f, F.col("value")).alias("theirs"), *[c.alias("their_evidence") for c in proof(other)])
    r = rules.select("doc_id", "field", F.when(f.isin(LISTS), coerced(f, F.col("value"))).otherwise(F.col("value")).alias("ours"), *[c.alias("our_evidence") for c in proof(rules)])
    both = r.join(o, ["doc_id", "field"], "full")
    same = F.coalesce(F.col("theirs").try_cast("double") == F.col("ours").try_cast("double"), F.col("theirs") == F.col("ours"))
    stands = f.isin(RULE_STANDS) & F.col("ours").isNotNull() & F.col("theirs").isNotNull() & ~same
    longer = f.isin(LISTS) & F.coalesce(F.size(items(F.col("ours"))) > F.size(items(F.col("theirs"))), F.lit(False))
    page = F.coalesce(F.col("our_evidence")["page"].cast("string"), F.lit("?")) if proof(rules) else F.lit("?")
    shown = lambda c: F.when(f.isin(BOOLS), F.initcap(c)).otherwise(F.col(c))
    note = F.when(stands, F.concat("field", F.lit(": LLM read '"), shown("theirs"), F.lit("', rule extractor found '"), shown("ours"), F.lit("' (p."), page, F.lit(") - kept the rule value (base wording); verify in the document.")))
    found = [c for c in ("their_evidence", "our_evidence") if c in both.columns]
    value = F.when(stands | longer, F.col("ours")).otherwise(F.coalesce("theirs", "ours"))
    return checked(both.select("doc_id", "field", value.alias("value"), F.array_compact(F.array(note)).alias("notes"), *([F.coalesce(*found).alias("evidence")] if found else [])))


def merged_open(rules: DataFrame, other: DataFrame, most: int = MOST_OPEN) -> DataFrame:
    """(doc_id, ord, clause) of both (doc_id, ord, clause): the rules' first, one for each beginning of 60 characters, the first 15."""
    both = rules.select("doc_id", F.lit(0).alias("side"), "ord", "clause").union(other.select("doc_id", F.lit(1), "ord", "clause"))
    first = Window.partitionBy("doc_id", F.left("clause", F.lit(60))).orderBy("side", "ord")
    rank = Window.partitionBy("doc_id").orderBy("side", "ord")
    kept = both.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most)
    return kept.select("doc_id", F.col("n").alias("ord"), "clause")


def cross_checked(x: DataFrame) -> DataFrame:
    """Wide rows with notes: a premium above half the sum insured; a limit's text implies the limit; exclusions are counted from their list."""
    high = F.coalesce(F.try_divide("annual_premium", "sum_insured") > 0.5, F.lit(False))
    note = F.array_compact(F.array(F.when(high, "Premium looks too high relative to sum insured - please check both values.")))
    note = F.concat(F.coalesce("validation_notes", F.array().cast("array<string>")), note) if "validation_notes" in x.columns else note
    limit = F.coalesce("room_rent_limit_present", F.when(F.coalesce("room_rent_limit", F.lit("")) != "", True))
    n = F.nullif(F.size("permanent_exclusions"), F.lit(0))
    return x.withColumns({"validation_notes": note, "room_rent_limit_present": limit, "exclusion_count": F.coalesce("exclusion_count", F.when(n > 0, n))})
