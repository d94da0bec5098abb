"""Features of a policy, rule flags, the transparent score and its label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in for a missing value.
IMPUTED = {"sum_insured": 1_000_000, "annual_premium": 24_350, "waiting_period_months": 24, "pre_existing_disease_waiting_period_months": 36, "copayment_percentage": 0, "exclusion_count": 13}
#: The ranges that features are clipped to.
RANGES = {
    "sum_insured": (300_000, 5_000_000), "annual_premium": (1_800, 288_400), "premium_to_coverage_ratio": (0.006, 0.062), "waiting_period_months": (0, 48),
    "pre_existing_disease_waiting_period_months": (0, 48), "copayment_percentage": (0, 30), "disease_sub_limit_count": (0, 6), "exclusion_count": (3, 22),
    "claim_process_clarity_score": (35, 100), "ambiguous_clause_count": (0, 6),
}
#: Feature, comparison, bound, flag.
FLAGS = [
    ("pre_existing_disease_waiting_period_months", ">=", 36, "Long pre-existing disease waiting period (>= 36 months)"),
    ("copayment_percentage", ">=", 10, "Co-payment of 10% or more"),
    ("room_rent_limit_present", "=", 1, "Room rent is capped"),
    ("icu_limit_present", "=", 1, "ICU charges are capped"),
    ("disease_sub_limit_count", ">=", 3, "Several disease / procedure sub-limits (>= 3)"),
    ("exclusion_count", ">=", 15, "Large number of exclusions (>= 15)"),
    ("ambiguous_clause_count", ">=", 3, "Several vague / discretionary clauses (>= 3)"),
    ("restoration_benefit_present", "=", 0, "No restoration / recharge of sum insured"),
    ("claim_process_clarity_score", "<", 60, "Claim process is not clearly described"),
    ("waiting_period_months", ">=", 24, "Long specified-disease waiting period (>= 24 months)"),
]
HIGH = ("pre_existing_disease_waiting_period_months", "copayment_percentage", "room_rent_limit_present")
#: Points of each unit of a feature, and of none; labels by score.
BASE = 103.0
WEIGHTS = {
    "risk_flags_count": -7.0, "copayment_percentage": -0.75, "pre_existing_disease_waiting_period_months": -0.25, "ambiguous_clause_count": -2.0,
    "restoration_benefit_present": 10.0, "no_claim_bonus_present": 5.0, "maternity_coverage_present": 1.0, "child_coverage_present": 0.5,
}
LABELS = [(80, "Strong Coverage"), (58, "Moderate Coverage"), (38, "Caution Required")]
TYPES = ["Family Floater", "Individual Health", "Senior Citizen", "Group Health", "Top-up Health", "Critical Illness"]
CLAIM_FIELDS = ["cashless_available", "reimbursement_available", "claim_intimation_timeline", "claim_documents_listed", "claim_settlement_timeline"]


def given(own: Column, extracted: Column) -> Column:
    """What the user says, else what was extracted; 0 counts as not given."""
    return F.coalesce(F.nullif(own, F.lit(0)), F.nullif(extracted, F.lit(0)))


def claim_clarity(fields: list[Column]) -> Column:
    return F.least(F.lit(100), F.lit(35) + 13 * reduce(lambda a, b: a + b, [F.coalesce(f.cast("int"), F.lit(0)) for f in fields]))


def clipped(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.least(F.greatest(F.col(k), F.lit(lo)), F.lit(hi)) for k, (lo, hi) in RANGES.items() if k in df.columns})


def imputed(df: DataFrame) -> DataFrame:
    """Missing values filled; unclear lists the features that were."""
    keys = [k for k in IMPUTED if k in df.columns]
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]))
    return df.withColumn("unclear", missing).withColumns({k: F.coalesce(F.col(k), F.lit(IMPUTED[k])) for k in keys})


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, half to even, of the value that the double has: x times ten to the digits is taken exactly, as two doubles."""
    scale = float(10**digits)
    product, part = x * scale, x * 134217729.0
    high = part - (part - x)
    rest = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    over = (product - whole - 0.5) + rest
    return (whole + F.when((over > 0) | ((over == 0) & (whole % 2 != 0)), 1).otherwise(0)) / scale


def featured(df: DataFrame) -> DataFrame:
    """Filled, with the premium's ratio, clipped, with the flags and their number."""
    df = imputed(df)
    df = df.withColumn("premium_to_coverage_ratio", rounded(F.col("annual_premium") / F.greatest(F.col("sum_insured"), F.lit(1)), 4))
    return flagged(clipped(df))


def _holds(feature: str, op: str, bound: float) -> Column:
    c = F.col(feature)
    return {">=": c >= bound, "=": c == bound, "<": c < bound}[op]


def flagged(df: DataFrame) -> DataFrame:
    one = [F.when(_holds(f, op, b), F.struct(F.lit("High" if f in HIGH else "Medium").alias("severity"), F.lit(text).alias("flag"), F.lit(f).alias("feature"))) for f, op, b, text in FLAGS]
    return df.withColumn("flags", F.array_compact(F.array(*one))).withColumn("risk_flags_count", F.size("flags"))


def raw_score(weights: dict[str, float] = WEIGHTS) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), reduce(lambda a, kw: a + F.col(kw[0]) * kw[1], weights.items(), F.lit(BASE))))


def label(score: Column) -> Column:
    return reduce(lambda c, b: c.when(score >= b[0], b[1]), LABELS[1:], F.when(score >= LABELS[0][0], LABELS[0][1])).otherwise("High Risk")


def scored(df: DataFrame) -> DataFrame:
    """score (half to even), label, and reasons: contributions of half a point or more (before they are rounded), largest first."""
    parts = [F.struct((-F.abs(F.bround(F.col(k) * w, 1))).alias("less"), (F.abs(F.col(k) * w) >= 0.5).alias("big"), F.lit(i).alias("i"), F.lit(k).alias("feature"), F.bround(F.col(k) * w, 1).alias("points")) for i, (k, w) in enumerate(WEIGHTS.items())]
    big = F.filter(F.array(*parts), lambda p: p["big"])
    reasons = F.transform(F.array_sort(big), lambda p: F.struct(p["feature"].alias("feature"), p["points"].alias("points")))
    s = raw_score()
    return df.withColumn("raw_score", s).withColumns({"score": F.bround("raw_score", 0).cast("int"), "label": label(F.col("raw_score")), "reasons": reasons})
