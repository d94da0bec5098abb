"""Registered queries of whole analyses, from pages to scores, risks and comparisons; the SQL starts from the terms that were written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, comparison, scoring
from ..storage import apart, kept
from .queries import _POLICIES_SQL, _TERMS_SQL, _extracted, _t, policy_pages, query

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_PROFILE = {"age": "policy_id % 90", "has_ped": "policy_id % 4 = 2", "planning_child": "policy_id % 3 = 1", "adding_child": "policy_id % 5 = 1"}

#: x: the fields as written; p0: features before they are filled; p5: filled, clipped, flagged and scored.
_ANALYSED_SQL = f"""c AS (SELECT c_custkey AS k, c_acctbal FROM customer), x AS (SELECT k, k AS policy_id, {", ".join(f"{v} AS {f}" for f, v in _TERMS_SQL.items())}, CASE WHEN k % 3 = 1 THEN 2 ELSE 1 END AS n_limits, 1 + (k % 5 = 0)::INT AS n_open FROM c),
p0 AS (SELECT policy_id, sum_insured, annual_premium, specific_disease_waiting_period_months AS waiting_period_months, ped_waiting_period_months AS pre_existing_disease_waiting_period_months, copayment_percentage, exclusion_count,
 {", ".join(f"coalesce({f}::INT, 0) AS {k}" for k, f in analysis.PRESENT.items())}, n_limits AS disease_sub_limit_count, n_open AS ambiguous_clause_count,
 least(100, 35 + 13 * (coalesce(cashless_available, false)::INT + coalesce(reimbursement_available, false)::INT + (claim_intimation_timeline <> '')::INT + coalesce(claim_documents_listed, false)::INT + (claim_settlement_timeline <> '')::INT)) AS claim_process_clarity_score FROM x),
""" + _POLICIES_SQL[_POLICIES_SQL.index("p1 AS (") :] + """,
a AS (SELECT *, round_even(raw_score, 0)::INT AS score, CASE WHEN raw_score >= 80 THEN 'Strong Coverage' WHEN raw_score >= 58 THEN 'Moderate Coverage' WHEN raw_score >= 38 THEN 'Caution Required' ELSE 'High Risk' END AS label FROM p5)"""  # fmt: skip
_PAGES = {"pre_existing_disease_waiting_period_months": "p.2", "copayment_percentage": "p.2", "room_rent_limit_present": "p.1", "icu_limit_present": "p.1", "disease_sub_limit_count": "p.2", "restoration_benefit_present": "p.1", "waiting_period_months": "p.2"}
_SAY = lambda when, severity, text: f"CASE WHEN {when} THEN '{severity}: ' || {text} END"
_RISK_SQL = [_SAY(f"a.{k} {op} {b}", "High" if k in scoring.HIGH else "Medium", _Q(f"{t} ({_PAGES.get(k, '-')}) - {why}")) for (k, op, b, t), why in zip(scoring.FLAGS, analysis.WHY)] + [
    _SAY("a.policy_id % 90 >= 60 AND a.copayment_percentage > 0", "High", "'Co-payment applies and policyholder age is ' || a.policy_id % 90 || ' (p.2) - Senior-age claims are usually larger, so a % co-pay costs more.'"),
    _SAY("a.policy_id % 4 = 2 AND a.pre_existing_disease_waiting_period_months > 0", "High", "'You reported a pre-existing condition (p.2) - It may not be covered for ' || a.pre_existing_disease_waiting_period_months || ' months.'"),
    _SAY("a.policy_id % 3 = 1 AND NOT x.maternity_covered", "High", "'Maternity cover not found but a child is planned (p.3) - Delivery and newborn expenses may not be covered.'"),
    _SAY("a.policy_id % 5 = 1 AND x.child_coverage IS NULL", "Medium", "'Child coverage not clearly found (-) - Confirm whether / at what age a dependent child can be added.'"),
] + [_SAY(f"x.{f} IS NULL", "Verify", _Q(f"{name} not clearly found in the document (-) - A typical value was assumed for scoring - confirm the real value.")) for f, name in [(f, name) for _, f, name in analysis.IMPUTED_FROM] + analysis.UNCLEAR]


def _verdicts(spark, d) -> DataFrame:
    """Features, score and label of every policy of the pages, with what was extracted in x and who asks in profile."""
    got = kept(_extracted(policy_pages(spark, d)))
    profile = F.struct(*[F.expr(v.replace("policy_id", "doc_id")).cast("int" if k == "age" else "boolean").alias(k) for k, v in _PROFILE.items()])
    return kept(scoring.scored(analysis.features(got)).withColumn("profile", profile))


@query(f"WITH {_ANALYSED_SQL}, r AS (SELECT a.policy_id, score, label, a.premium_to_coverage_ratio, a.risk_flags_count, list_filter([{', '.join(_RISK_SQL)}], lambda v: v IS NOT NULL) AS r FROM a JOIN x USING (policy_id)) SELECT policy_id, score, label, premium_to_coverage_ratio, risk_flags_count::INT AS n_flags, len(r)::INT AS n_risks, array_to_string(r, chr(10)) AS risks FROM r")
def policy_verdicts(spark, d):
    """F01-F11, M01, M02, A01, A02 end to end: pages to clauses, features, score, label and risks with their pages."""
    got = analysis.risk_flags(_verdicts(spark, d))
    said = F.transform("risks", lambda r: F.concat(r["severity"], F.lit(": "), r["flag"], F.lit(" ("), r["source"], F.lit(") - "), r["why"]))
    return got.select(F.col("doc_id").alias("policy_id"), "score", "label", "premium_to_coverage_ratio", F.col("risk_flags_count").alias("n_flags"), F.size("risks").alias("n_risks"), F.array_join(said, "\n").alias("risks"))


_ASPECT = [
    ("p.sum_insured", "x.sum_insured IS NOT NULL"), ("p.annual_premium", "true"), ("x.ped_waiting_period_months", ""), ("x.specific_disease_waiting_period_months", ""), ("x.initial_waiting_period_days", ""), ("x.copayment_percentage", ""),
    ("x.room_rent_limit_present::INT", ""), ("x.icu_limit_present::INT", ""), ("p.disease_sub_limit_count", ""), ("x.exclusion_count", ""), ("x.restoration_benefit::INT", ""), ("x.no_claim_bonus::INT", ""), ("x.pre_hospitalization_days", ""),
    ("x.post_hospitalization_days", ""), ("x.day_care_covered::INT", ""), ("x.ayush_covered::INT", ""), ("x.maternity_covered::INT", ""), ("x.newborn_covered::INT", ""), ("x.child_coverage::INT", ""), ("p.claim_process_clarity_score", ""), ("p.score", ""),
]
_UP = (0, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20)


@query(f"""WITH {_ANALYSED_SQL}, v AS ({" UNION ALL ".join(f"SELECT p.policy_id, {i} AS ord, ({v})::DOUBLE AS v, {known or f'({v}) IS NOT NULL'} AS known, {i in _UP} AS up FROM a p JOIN x USING (policy_id)" for i, (v, known) in enumerate(_ASPECT))}),
m AS (SELECT s.policy_id AS pair_id, s.ord, CASE WHEN NOT (s.known AND t.known) THEN 'Unclear' WHEN s.v = t.v THEN 'Same' WHEN s.ord = 1 THEN 'Cost' WHEN (t.v > s.v) = s.up THEN 'Improved' ELSE 'Worse' END AS change FROM v s JOIN v t ON t.policy_id = s.policy_id + 1 AND t.ord = s.ord WHERE s.policy_id % 2 = 1),
n AS (SELECT pair_id, count(*) FILTER (change = 'Improved') AS n_improved, count(*) FILTER (change = 'Worse') AS n_worse, count(*) FILTER (change = 'Unclear') AS n_unclear FROM m GROUP BY pair_id)
SELECT n.*, round_even((b.annual_premium - a.annual_premium) * 100.0::DOUBLE / a.annual_premium, 1) AS premium_change_pct, (3 + (xa.ped_waiting_period_months < xb.ped_waiting_period_months)::INT + (b.sum_insured > a.sum_insured)::INT)::INT AS n_risks,
 ((pair_id % 90 >= 55 AND xb.copayment_percentage > 0)::INT + (pair_id % 3 = 1 AND NOT xb.maternity_covered)::INT + (pair_id % 4 = 2)::INT)::INT AS n_cautions
FROM n JOIN a ON a.policy_id = pair_id JOIN a b ON b.policy_id = pair_id + 1 JOIN x xa ON xa.policy_id = pair_id JOIN x xb ON xb.policy_id = pair_id + 1""")
def paired_policies(spark, d):
    """A03-A10 end to end: two policies of pages, aspect by aspect, with the premium's change, risks of a switch and cautions."""
    got = _verdicts(spark, d)
    policies = kept(got.select(F.col("doc_id").alias("policy_id"), "x", F.struct("sum_insured", "annual_premium", "disease_sub_limit_count", "claim_process_clarity_score").alias("f"), "score", F.struct("x.sum_insured", "x.annual_premium").alias("given")))
    k = F.col("c_custkey")
    profile = F.struct((k % 90).cast("int").alias("age"), (k % 3 == 1).alias("planning_child"), (k % 4 == 2).alias("has_ped")).alias("profile")
    pairs = kept(_t(spark, d, "customer").where(k % 2 == 1).select(k.alias("pair_id"), k.alias("current"), (k + 1).alias("proposed"), profile))
    counts = comparison.summary(comparison.compared(pairs, policies)).select("pair_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("improved", "worse", "unclear")])
    outlook = comparison.outlook(pairs, policies).select("pair_id", "premium_change_pct", F.size("switching_risks").alias("n_risks"), F.size("cautions").alias("n_cautions"))
    return counts.join(apart(outlook), "pair_id")


