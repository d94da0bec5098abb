"""Two policies side by side: aspects, verdicts, lists, the premium's change, risks of a switch, cautions for a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import apart

#: What is compared; where it comes from (x extraction, f features), its kind, and which way is better.
ASPECTS = [
    ("Sum insured (Rs)", "f", "sum_insured", "num", "higher"),
    ("Annual premium (Rs)", "f", "annual_premium", "num", "lower"),
    ("Pre-existing disease waiting (months)", "x", "ped_waiting_period_months", "num", "lower"),
    ("Specified disease waiting (months)", "x", "specific_disease_waiting_period_months", "num", "lower"),
    ("Initial waiting period (days)", "x", "initial_waiting_period_days", "num", "lower"),
    ("Co-payment (%)", "x", "copayment_percentage", "num", "lower"),
    ("Room rent capped", "x", "room_rent_limit_present", "bool", "no"),
    ("ICU charges capped", "x", "icu_limit_present", "bool", "no"),
    ("Disease-wise sub-limits (count)", "f", "disease_sub_limit_count", "num", "lower"),
    ("Exclusions (count)", "x", "exclusion_count", "num", "lower"),
    ("Restoration / recharge benefit", "x", "restoration_benefit", "bool", "yes"),
    ("No-claim / cumulative bonus", "x", "no_claim_bonus", "bool", "yes"),
    ("Pre-hospitalisation (days)", "x", "pre_hospitalization_days", "num", "higher"),
    ("Post-hospitalisation (days)", "x", "post_hospitalization_days", "num", "higher"),
    ("Day care procedures", "x", "day_care_covered", "bool", "yes"),
    ("AYUSH treatment", "x", "ayush_covered", "bool", "yes"),
    ("Maternity cover", "x", "maternity_covered", "bool", "yes"),
    ("Newborn cover", "x", "newborn_covered", "bool", "yes"),
    ("Dependent child cover", "x", "child_coverage", "bool", "yes"),
    ("Claim process clarity (0-100)", "f", "claim_process_clarity_score", "num", "higher"),
]
SCORE = "Coverage Clarity Score"
PRICED = ("sum_insured", "annual_premium")
#: What to mind when policies are switched.
RISKS = [
    "Waiting periods (pre-existing, specified diseases, maternity) normally restart with a new policy. Under IRDAI portability rules you can ask for credit of the waiting period already served, usually only up to the previous sum insured - get this in writing before switching.",
    "Any accumulated no-claim / cumulative bonus on the current policy may not fully carry over.",
    "Do not let the current policy lapse until the new one is issued and the portability request is accepted (keep a gap-free continuity).",
]
LONGER = "The proposed policy has a LONGER pre-existing disease waiting period."
AFRESH = "For the increased part of the sum insured, waiting periods usually apply afresh."
CAUTIONS = [
    "Proposed policy has co-payment and policyholder is 55+.", "Child is planned but maternity cover is not found in the proposed policy.",
    "You reported a pre-existing condition - confirm the exact PED waiting credit on switching.",
]


def shown(value: Column, kind: str, none: str = "Not found") -> Column:
    """A value as text: Yes or No, whole numbers without a point, thousands from 10,000 on."""
    if kind == "bool":
        return F.when(value.isNull(), none).when(value != 0, "Yes").otherwise("No")
    whole = value == F.floor(value)
    text = F.when(whole & (value >= 10_000), F.format_number(value, 0)).when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.coalesce(text, F.lit(none))


def aspects(policies: DataFrame) -> DataFrame:
    """(policy_id, aspects): for policies(policy_id, x struct, f struct, score, given struct) the list of (ord, aspect, better, value, known, text).

    given holds sum_insured and annual_premium where document or user states them: what was imputed is not known.
    """
    rows = []
    for i, (name, side, key, kind, better) in enumerate(ASPECTS):
        value = F.col(f"{side}.{key}").cast("int").cast("double") if kind == "bool" else F.col(f"{side}.{key}").cast("double")
        known = F.nullif(F.col(f"given.{key}"), F.lit(0)).isNotNull() if key in PRICED else F.lit(True) if side == "f" else value.isNotNull()
        none = "Not provided" if key in PRICED else "Not found"
        text = F.when(known, shown(value, kind, none)).otherwise(none)
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("aspect"), F.lit(better).alias("better"), value.alias("value"), known.alias("known"), text.alias("text")))
    rows.append(F.struct(F.lit(len(ASPECTS)).alias("ord"), F.lit(SCORE).alias("aspect"), F.lit("higher").alias("better"), F.col("score").cast("double").alias("value"), F.lit(True).alias("known"), F.col("score").cast("long").cast("string").alias("text")))
    return policies.select("policy_id", F.array(*rows).alias("aspects"))


def compared(pairs: DataFrame, policies: DataFrame) -> DataFrame:
    """(pair_id, ord, aspect, current, proposed, change) of pairs(pair_id, current, proposed)."""
    a = aspects(policies)
    side = lambda n: apart(a.select(F.col("policy_id").alias(n), F.col("aspects").alias(f"{n}_aspects")))
    # both lists have all aspects in one order, so they meet without a join of their rows
    both = pairs.select("pair_id", "current", "proposed").join(side("current"), "current").join(side("proposed"), "proposed")
    both = both.select("pair_id", F.explode(F.arrays_zip(F.col("current_aspects").alias("a"), F.col("proposed_aspects").alias("b"))).alias("r")).select("pair_id", "r.a", "r.b")
    both = both.select("pair_id", "a.ord", "a.aspect", "a.better", *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for n, s in (("current", "a"), ("proposed", "b")) for c in ("value", "known")], F.col("a.text").alias("current"), F.col("b.text").alias("proposed"))
    x, y = F.col("current_value"), F.col("proposed_value")
    up = F.col("better").isin("higher", "yes")
    change = (
        F.when(~(F.col("current_known") & F.col("proposed_known")), "Unclear").when(x == y, "Same")
        .when(F.col("aspect") == "Annual premium (Rs)", F.when(y > x, "Higher cost").otherwise("Lower cost")).when((y > x) == up, "Improved").otherwise("Worse")
    )
    return both.select("pair_id", "ord", "aspect", "current", "proposed", change.alias("change"))


def summary(rows: DataFrame) -> DataFrame:
    """(pair_id, improved, worse, unclear): aspects of each verdict in order; costs are in none."""
    pick = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == v, F.struct("ord", "aspect")))), lambda r: r["aspect"])
    return rows.groupBy("pair_id").agg(pick("Improved").alias("improved"), pick("Worse").alias("worse"), pick("Unclear").alias("unclear"))


def outlook(pairs: DataFrame, policies: DataFrame) -> DataFrame:
    """(pair_id, premium_change_pct, switching_risks, cautions) of pairs(pair_id, current, proposed, profile struct).

    The change is null unless both premiums are known. profile has age, planning_child and has_ped; nulls count as no.
    """
    keep = policies.select("policy_id", F.struct("x", "f", "given").alias("p"))
    side = lambda n, p: apart(keep.select(F.col("policy_id").alias(n), F.col("p").alias(p)))
    df = pairs.join(side("current", "a"), "current").join(side("proposed", "b"), "proposed")
    known = F.nullif(F.col("a.given.annual_premium"), F.lit(0)).isNotNull() & F.nullif(F.col("b.given.annual_premium"), F.lit(0)).isNotNull()
    was, new = F.col("a.f.annual_premium"), F.col("b.f.annual_premium")
    pct = F.when(known, F.bround(F.try_divide((new - was) * 100.0, was), 1))
    longer = F.coalesce(F.coalesce("a.x.ped_waiting_period_months", F.lit(0)) < F.col("b.x.ped_waiting_period_months"), F.lit(False))
    risks = F.array(F.when(longer, LONGER), *map(F.lit, RISKS), F.when(F.col("b.f.sum_insured") > F.col("a.f.sum_insured"), AFRESH))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    old = F.coalesce(F.col("profile.age") >= 55, F.lit(False)) & (F.coalesce("b.x.copayment_percentage", F.lit(0.0)) > 0)
    cautions = F.array(F.when(old, CAUTIONS[0]), F.when(yes("profile.planning_child") & ~yes("b.x.maternity_covered"), CAUTIONS[1]), F.when(yes("profile.has_ped"), CAUTIONS[2]))
    return df.select("pair_id", pct.alias("premium_change_pct"), F.array_compact(risks).alias("switching_risks"), F.array_compact(cautions).alias("cautions"))
