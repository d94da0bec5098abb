"""Rows of a report: clause tables, latest entries, sections and counters of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import plain_glyphs

#: What a clause table calls the extracted fields, in order.
CLAUSES = [
    ("Insurer", "insurer_name"), ("Policy / plan", "policy_name"), ("UIN", "uin"), ("Policy type", "policy_type"), ("Sum insured", "sum_insured"), ("Annual premium", "annual_premium"),
    ("In-patient hospitalisation", "inpatient_hospitalization"), ("Pre-hospitalisation days", "pre_hospitalization_days"), ("Post-hospitalisation days", "post_hospitalization_days"), ("Day care", "day_care_covered"),
    ("Ambulance", "ambulance_cover"), ("AYUSH", "ayush_covered"), ("Domiciliary", "domiciliary_covered"), ("Restoration benefit", "restoration_benefit"), ("No-claim bonus", "no_claim_bonus"),
    ("Maternity", "maternity_covered"), ("Newborn", "newborn_covered"), ("Dependent child", "child_coverage"), ("Initial waiting (days)", "initial_waiting_period_days"), ("PED waiting (months)", "ped_waiting_period_months"),
    ("Specified disease waiting (months)", "specific_disease_waiting_period_months"), ("Co-payment %", "copayment_percentage"), ("Co-payment conditions", "copayment_conditions"), ("Room rent limit", "room_rent_limit"), ("ICU limit", "icu_limit"),
    ("Disease sub-limits", "disease_sub_limits"), ("Exclusions (count)", "exclusion_count"), ("Cashless", "cashless_available"), ("Reimbursement", "reimbursement_available"), ("Claim intimation", "claim_intimation_timeline"),
    ("Grace period (days)", "grace_period_days"), ("Portability described", "portability_mentioned"),
]
NONE = "Not clearly found"


def displayed(c: Column, kind: str) -> Column:
    """A value of this type as a report shows it."""
    if kind == "boolean":
        return F.when(c.isNull(), NONE).when(c, "Yes").otherwise("No")
    if kind.startswith("array"):
        few = F.array_join(F.slice(c, 1, 6), "; ")
        return F.when(F.size(c) > 6, F.concat(few, F.lit(" ..."))).when(F.size(c) > 0, few).otherwise(NONE)
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NONE))


def clause_table(extracted: DataFrame) -> DataFrame:
    """(doc_id, ord, label, value, page): the clauses of each document in order; values of 220 characters at most."""
    kinds = {f.name: f.dataType.simpleString() for f in extracted.schema.fields}
    proof = F.col("evidence")
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.left(plain_glyphs(displayed(F.col(field), kinds[field])), F.lit(220)).alias("value"),
                 F.coalesce(F.concat(F.lit("p."), F.nullif(F.try_element_at(proof, F.lit(field))["page"], F.lit(0)).cast("string")), F.lit("-")).alias("page"))
        for i, (label, field) in enumerate(CLAUSES) if field in kinds
    ]
    return extracted.select("doc_id", F.inline(F.array(*rows)))


def latest(log: DataFrame, of: str, order: str, n: int = 8) -> DataFrame:
    """The last n entries of each of's log, in order."""
    back = Window.partitionBy(of).orderBy(F.col(order).desc())
    return log.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n).drop("back")


def sections(clauses: DataFrame, reasons: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc_id, section, ord, cells) of a report: clauses, reasons(doc_id, ord, text) and questions(doc_id, ord, text)."""
    part = lambda df, name, *cells: df.select("doc_id", F.lit(name).alias("section"), F.col("ord").cast("int").alias("ord"), F.array(*cells).alias("cells"))
    return part(clauses, "clauses", "label", "value", "page").union(part(reasons, "reasons", "text")).union(part(questions, "questions", "text"))


def page_counters(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, ocr_pages)."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.col("ocr").cast("int")).alias("ocr_pages"))
