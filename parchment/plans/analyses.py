"""Registered queries from features to answers, reports, evaluation and replies, each with its SQL."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as T
from ..operators import analysis, answers, evaluation, models, reports, scoring
from .queries import _POLICIES_SQL, _as_pages, _extracted, _policies, _t, policy_pages, query

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_FEATURED = f"WITH {_POLICIES_SQL}, a AS (SELECT p.*, g.pre_existing_disease_waiting_period_months AS said_ped, round_even(raw_score, 0)::INT AS score, CASE WHEN raw_score >= 80 THEN 'Strong Coverage' WHEN raw_score >= 58 THEN 'Moderate Coverage' WHEN raw_score >= 38 THEN 'Caution Required' ELSE 'High Risk' END AS label FROM p5 p JOIN p0 g USING (policy_id))"
_SHOWN = "CASE label WHEN 'High Risk' THEN 'High Risk / Needs Advisor Review' ELSE label END"
_VAGUE = ["at our sole discretion", "as we decide from time to time"]


def _analysed(spark, d) -> DataFrame:
    """Policies with features, score and label; x is what their wording might have said, profile who asks."""
    k = F.col("policy_id")
    own = _policies(spark, d)
    flag = lambda c: F.col(c) == 1
    page = lambda n: F.struct(F.lit(n).alias("page"), F.lit("here").alias("quote"))
    x = F.struct(
        flag("room_rent_limit_present").alias("room_rent_limit_present"), flag("icu_limit_present").alias("icu_limit_present"), flag("restoration_benefit_present").alias("restoration_benefit"), flag("maternity_coverage_present").alias("maternity_covered"),
        flag("child_coverage_present").alias("child_coverage"), flag("no_claim_bonus_present").alias("no_claim_bonus"), F.col("pre_existing_disease_waiting_period_months").alias("ped_waiting_period_months"),
        F.array_repeat(F.lit("Cataract"), F.col("disease_sub_limit_count").cast("int")).alias("disease_sub_limits"), F.slice(F.array(*map(F.lit, _VAGUE)), F.lit(1), (k % 3).cast("int")).alias("ambiguous_clauses"),
        F.when(k % 2 == 0, F.concat(F.lit("Care Plan "), k.cast("string"))).alias("policy_name"), F.lit("Harbour Light").alias("insurer_name"), F.when(k % 3 > 0, "Family Floater").alias("policy_type"),
        F.when(k % 4 > 0, k % 4 == 1).alias("inpatient_hospitalization"), F.when(k % 5 > 0, k % 5 == 1).alias("day_care_covered"), ((k % 3) * 30).cast("int").alias("pre_hospitalization_days"), ((k % 5) * 30).cast("int").alias("post_hospitalization_days"),
        F.lit(30).alias("initial_waiting_period_days"), F.lit(24).alias("specific_disease_waiting_period_months"), F.when(k % 6 == 0, F.repeat(F.lit("only  in other cities "), 9)).alias("copayment_conditions"), F.when(k % 7 == 0, "1% a day").alias("room_rent_limit"),
        F.lit(True).alias("newborn_covered"), F.lit(True).alias("cashless_available"), F.lit(None).cast("boolean").alias("reimbursement_available"),
        F.map_from_arrays(F.array(F.lit("copayment_percentage"), F.lit("ped_waiting_period_months")), F.array(page(2), page(3))).alias("evidence"),
    ).alias("x")
    profile = F.struct((k % 90).cast("int").alias("age"), (k % 4 == 2).alias("has_ped"), (k % 3 == 1).alias("planning_child"), (k % 5 == 1).alias("adding_child")).alias("profile")
    return scoring.scored(scoring.featured(own.select("*", x, profile)))


_x = lambda c: F.col(f"x.{c}")
_f = F.col
_p = lambda c: F.col(f"profile.{c}")


def _questions():
    return analysis.advisor_questions(_x, _f, _p, F.col("policy_id") % 4 == 0)


_ASKED = [
    "CASE WHEN copayment_percentage > 0 THEN 'The policy mentions ' || copayment_percentage::BIGINT || '% co-payment - does it apply to all claims or only certain ages / cities / non-network hospitals?' END",
    "CASE WHEN room_rent_limit_present = 1 THEN 'What exactly is the room rent limit, and will ''proportionate deduction'' reduce other bills if I choose a higher room category?' END",
    "CASE WHEN icu_limit_present = 1 THEN 'What is the ICU per-day limit and what happens if the ICU bill is above it?' END",
    "'Please confirm the pre-existing disease waiting period (' || coalesce(nullif(said_ped, 0)::VARCHAR, 'not found') || ' months) and which of my conditions it covers.'",
    "CASE WHEN disease_sub_limit_count > 0 THEN 'Which treatments have sub-limits (e.g. cataract, joint replacement) and what are the amounts?' END",
    "CASE WHEN restoration_benefit_present = 0 THEN 'Is there any restoration / recharge of the sum insured if it is exhausted during the year?' END",
    "'What is the list of non-payable items / consumables, and is there any add-on to cover them?'", "'What are the claim intimation timelines and documents needed for cashless and reimbursement?'",
    "CASE WHEN policy_id % 3 = 1 OR policy_id % 5 = 1 THEN 'From what age can a newborn / child be added, and is maternity covered with what waiting period?' END",
    "CASE WHEN policy_id % 4 = 0 THEN 'If I port to the new policy, how much waiting-period credit will I get, and is it in writing?' END", "CASE WHEN policy_id % 4 = 0 THEN 'Will my accumulated no-claim / cumulative bonus carry over?' END",
    f"CASE WHEN policy_id % 3 > 0 THEN 'Please explain this clause in simple terms: {_VAGUE[0]}' END", f"CASE WHEN policy_id % 3 > 1 THEN 'Please explain this clause in simple terms: {_VAGUE[1]}' END",
]
_LIST = lambda items: "list_filter([" + ", ".join(items) + "], lambda v: v IS NOT NULL)"


@query(f"{_FEATURED}, q AS (SELECT policy_id, {_LIST(_ASKED)}[1:12] AS q FROM a) SELECT policy_id, len(q)::INT AS n, md5(array_to_string(q, chr(10))) AS questions_md5 FROM q")
def advisor_question_lists(spark, d):
    """Questions for an advisor, in order."""
    return _analysed(spark, d).select("policy_id", _questions().alias("q")).select("policy_id", F.size("q").alias("n"), F.md5(F.array_join("q", "\n")).alias("questions_md5"))


_PED = "pre_existing_disease_waiting_period_months"
_AT = {"copayment_percentage": "p.2", _PED: "p.3"}
_RISKS = [f"CASE WHEN {k} {op} {b} THEN {{'s': '{'High' if k in scoring.HIGH else 'Medium'}', 't': {_Q(t + ' (' + _AT.get(k, '-') + ') - ' + why)}}} END" for (k, op, b, t), why in zip(scoring.FLAGS, analysis.WHY)] + [
    "CASE WHEN policy_id % 90 >= 60 AND copayment_percentage > 0 THEN {'s': 'High', 't': 'Co-payment applies and policyholder age is ' || policy_id % 90 || ' (p.2) - Senior-age claims are usually larger, so a % co-pay costs more.'} END",
    f"CASE WHEN policy_id % 4 = 2 AND {_PED} > 0 THEN {{'s': 'High', 't': 'You reported a pre-existing condition (p.3) - It may not be covered for ' || {_PED} || ' months.'}} END",
    "CASE WHEN policy_id % 3 = 1 AND maternity_coverage_present = 0 THEN {'s': 'High', 't': 'Maternity cover not found but a child is planned (-) - Delivery and newborn expenses may not be covered.'} END",
    "CASE WHEN policy_id % 5 = 1 AND child_coverage_present = 0 THEN {'s': 'Medium', 't': 'Child coverage not clearly found (-) - Confirm whether / at what age a dependent child can be added.'} END",
]


_ASSUMED = " not clearly found in the document (-) - A typical value was assumed for scoring - confirm the real value."
_VERIFY = _LIST([f"CASE WHEN {k} IS NULL THEN {{'s': 'Verify', 't': '{k}{_ASSUMED}'}} END" for k in scoring.IMPUTED] + ["CASE WHEN policy_id % 3 = 0 THEN {'s': 'Verify', 't': 'Extraction cross-check (-) - months: 24/36, policy ' || policy_id} END"])


@query(f"{_FEATURED}, v AS (SELECT policy_id, {_VERIFY} AS v FROM p0), r AS (SELECT policy_id, list_concat({_LIST(_RISKS)}, v) AS r FROM a JOIN v USING (policy_id)) SELECT policy_id, i - 1 AS ord, x.s AS severity, x.t AS said FROM (SELECT policy_id, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM r)")
def reasoned_risk_flags(spark, d):
    """Flags of the policy and of who asks, with reasons and pages, and what is to be verified."""
    notes = F.array_compact(F.array(F.when(F.col("policy_id") % 3 == 0, F.concat(F.lit("months: 24/36, policy "), F.col("policy_id").cast("string")))))
    rows = analysis.risk_flags(_analysed(spark, d), notes).select("policy_id", F.posexplode("risks").alias("ord", "r"))
    return rows.select("policy_id", F.col("ord").cast("long").alias("ord"), "r.severity", F.concat("r.flag", F.lit(" ("), "r.source", F.lit(") - "), "r.why").alias("said"))


_GOOD = _LIST([
    "CASE WHEN copayment_percentage = 0 THEN 'no general co-payment found' END", "CASE WHEN room_rent_limit_present = 0 THEN 'no room-rent cap found' END", "CASE WHEN restoration_benefit_present = 1 THEN 'restoration of sum insured available' END",
    "CASE WHEN no_claim_bonus_present = 1 THEN 'no-claim / cumulative bonus available' END", "CASE WHEN maternity_coverage_present = 1 THEN 'maternity cover available' END", "CASE WHEN policy_id % 5 >= 3 THEN 'long post-hospitalisation cover (' || policy_id % 5 * 30 || ' days)' END",
])


@query(f"""{_FEATURED}, q AS (SELECT policy_id, score, label, {_LIST(_ASKED)}[1:5] AS q, {_LIST(_RISKS)}[1:6] AS r, array_to_string({_GOOD}, ', ') AS g FROM a)
SELECT policy_id, md5('Coverage Clarity Score: **' || score || '/100 (' || {_SHOWN} || ')**.' || chr(10) || chr(10) || '**Appears stronger in:** ' || CASE WHEN g = '' THEN 'no clear strengths detected' ELSE g END || chr(10) || chr(10) || '**Needs caution in:**' || chr(10)
 || CASE WHEN len(r) = 0 THEN '- none detected' ELSE array_to_string(list_transform(r, lambda v: '- ' || v.t), chr(10)) END || chr(10) || chr(10) || '**Ask these before deciding:**' || chr(10) || array_to_string(list_transform(q, lambda v: '- ' || v), chr(10)) || chr(10) || chr(10) || {_Q(analysis.DECIDE)}) AS facts_md5 FROM q""")
def decision_facts(spark, d):
    """Q09: facts and questions in place of a verdict."""
    df = analysis.risk_flags(_analysed(spark, d))
    return df.select("policy_id", F.md5(analysis.decision_text(_f, _x("post_hospitalization_days"), F.col("score"), F.col("label"), F.col("risks"), _questions())).alias("facts_md5"))


_YN = lambda c: f"CASE WHEN ({c}) IS NULL THEN 'Not clearly stated (verify)' WHEN ({c}) THEN 'Yes' ELSE 'No' END"
_SUMMARY = [
    "'- This is a ' || CASE WHEN policy_id % 3 > 0 THEN 'Family Floater' ELSE 'health' END || ' policy' || CASE WHEN policy_id % 2 = 0 THEN ' named Care Plan ' || policy_id ELSE '' END || ' from Harbour Light.'",
    "'- Sum insured used for analysis: Rs ' || format('{:,}', sum_insured::BIGINT) || '; annual premium: Rs ' || format('{:,}', annual_premium::BIGINT) || '.'",
    f"'- Hospital stay (in-patient) cover: ' || {_YN('CASE WHEN policy_id % 4 > 0 THEN policy_id % 4 = 1 END')} || '; day-care procedures: ' || {_YN('CASE WHEN policy_id % 5 > 0 THEN policy_id % 5 = 1 END')} || '.'",
    "'- Expenses before/after hospitalisation: ' || CASE WHEN policy_id % 3 = 0 THEN '?' ELSE (policy_id % 3 * 30)::VARCHAR END || ' days before and ' || CASE WHEN policy_id % 5 = 0 THEN '?' ELSE (policy_id % 5 * 30)::VARCHAR END || ' days after.'",
    "'- Pre-existing diseases are covered only after ' || coalesce(nullif(said_ped, 0)::VARCHAR, '? (verify)') || ' months; specified illnesses after 24 months.'", "'- New illnesses (other than accidents) are not covered for the first 30 days.'",
    "'- Co-payment: ' || copayment_percentage::BIGINT || '% of each claim is paid by you' || CASE WHEN policy_id % 6 = 0 THEN ' (only in other cities only in other cities only in other cities only in other cities only in other cities only…)' ELSE '' END || '.'",
    f"'- Room rent limit: ' || {_YN('room_rent_limit_present = 1')} || CASE WHEN policy_id % 7 = 0 THEN ' (1% a day)' ELSE '' END || '.'", f"'- ICU limit: ' || {_YN('icu_limit_present = 1')} || '.'",
    "'- Disease-wise sub-limits found: ' || disease_sub_limit_count || '; exclusions listed: about ' || exclusion_count || '.'", f"'- Restoration of sum insured: ' || {_YN('restoration_benefit_present = 1')} || '; no-claim bonus: ' || {_YN('no_claim_bonus_present = 1')} || '.'",
    f"'- Maternity: ' || {_YN('maternity_coverage_present = 1')} || '; newborn: Yes; dependent child: ' || {_YN('child_coverage_present = 1')} || '.'", "'- Claims: cashless Yes, reimbursement Not clearly stated (verify); claim process clarity ' || claim_process_clarity_score || '/100.'",
    f"'- Coverage Clarity Score: ' || score || '/100 (' || {_SHOWN} || ').'", "'- ' || policy_id % 3 || ' vague / schedule-dependent clauses need verification.'",
]


@query(f"{_FEATURED}, s AS (SELECT policy_id, [{', '.join(_SUMMARY)}] AS l FROM a) SELECT policy_id, i AS n, line FROM (SELECT policy_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s)")
def policy_summaries(spark, d):
    """Fifteen lines about each policy."""
    rows = _analysed(spark, d).select("policy_id", F.posexplode(analysis.summary(_x, _f, F.col("score"), F.col("label"))).alias("n", "line"))
    return rows.select("policy_id", (F.col("n") + 1).cast("long").alias("n"), "line")


_CLASS = "CASE WHEN risk_flags_count >= 6 THEN 3 WHEN risk_flags_count >= 4 THEN 2 WHEN risk_flags_count >= 2 THEN 1 ELSE 0 END"
_VALUE = "97 - 6.5 * risk_flags_count"
_NAME = f"['Strong Coverage', 'Moderate Coverage', 'Caution Required', 'High Risk'][1 + {_CLASS}]"


@query(f"{_FEATURED}, m AS (SELECT *, {_NAME} AS said, round_even(least(greatest(({_VALUE})::DOUBLE, 0), 100), 0)::INT AS own FROM a) SELECT policy_id, own AS score, said AS label, score AS rule_score, label AS rule_label, said = label AS agreement, {_SHOWN.replace('label', 'said')} AS label_display FROM m")
def served_scores(spark, d):
    """What is served with a model (here one that counts flags), beside the rules' score and label."""
    stage = lambda say: PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, CAST({say} AS DOUBLE) AS prediction FROM __THIS__")])
    pair = stage(_CLASS), stage(_VALUE)
    return models.served(_analysed(spark, d).drop("score", "label"), pair).select("policy_id", "score", "label", "rule_score", "rule_label", "agreement", "label_display")


@query("""
WITH k AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer)
SELECT k AS doc_id, least(greatest(CASE WHEN k % 7 <> 0 THEN (k % 50 + 1) * 100000 ELSE 1000000 END, 300000), 5000000)::BIGINT AS sum_insured, least(greatest(floor(abs(b) * 10)::BIGINT + 1800, 1800), 288400)::BIGINT AS annual_premium,
 CASE WHEN k % 7 <> 0 THEN 'Family Floater' ELSE 'Individual Health' END AS policy_type, CASE WHEN k % 3 = 0 THEN 24 ELSE 12 END::INT AS waiting_period_months, CASE WHEN k % 5 = 0 THEN 36 ELSE (k % 4 + 1) * 12 END::INT AS pre_existing_disease_waiting_period_months,
 (k % 4 * 5)::DOUBLE AS copayment_percentage, (k % 2 <> 0)::INT AS room_rent_limit_present, (k % 3 <> 0)::INT AS icu_limit_present, CASE WHEN k % 3 = 1 THEN 2 ELSE 1 END::INT AS disease_sub_limit_count, (k % 5 >= 2)::INT AS restoration_benefit_present,
 (k % 6 >= 3)::INT AS maternity_coverage_present, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END::INT AS ambiguous_clause_count FROM k""")
def policy_analysis(spark, d):
    """F01-F11 end to end: pages, clauses, features; the SQL starts from the terms that were written."""
    got = analysis.features(_extracted(policy_pages(spark, d)))
    whole = lambda c, t: F.col(c).cast(t).alias(c)
    return got.select(
        "doc_id", whole("sum_insured", "long"), whole("annual_premium", "long"), "policy_type", whole("waiting_period_months", "int"), whole("pre_existing_disease_waiting_period_months", "int"), whole("copayment_percentage", "double"),
        *[whole(c, "int") for c in ("room_rent_limit_present", "icu_limit_present", "disease_sub_limit_count", "restoration_benefit_present", "maternity_coverage_present", "ambiguous_clause_count")],
    )


_ADVICE = r"'(?i)\b(should i|shall i|do i|must i|is it (good|better|worth)|which (one|policy) (is|should)|recommend|buy|switch|port|cancel|worth it)\b'"


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS question_id, regexp_matches(coalesce(text, ''), {_ADVICE}) AS advice, CASE WHEN turn % 7 > 0 THEN turn % 7 / 20 END AS best, conv_id % 3 = 0 AS decided, turn % 2 = 0 AS cited FROM conversations),
w AS (SELECT *, coalesce(best < 0.12, true) AS weak, CASE WHEN advice THEN {_Q(analysis.PREAMBLE + 'what the document says so you can discuss it with a licensed advisor:')} || chr(10) || chr(10) ELSE '' END || 'Rent is capped' || CASE WHEN cited THEN ' [S1]' ELSE chr(10) || chr(10) || 'Sources: [S1] p.1; [S2] p.2; [S3] p.3' END AS own FROM c)
SELECT question_id, CASE WHEN advice AND decided THEN {_Q(analysis.PREAMBLE + 'a factual summary to discuss with a licensed advisor:')} || chr(10) || chr(10) || 'Facts.' WHEN weak THEN {_Q(answers.NOT_FOUND + ' Please ask the insurer to point you to the exact clause.')} ELSE own END AS answer,
 (advice AND decided) OR NOT weak AS grounded, advice FROM w""")
def routed_answers(spark, d):
    """Q08: decision facts, a refusal, or the document's words, with sources."""
    t = F.col("turn")
    rows = _t(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + t).alias("question_id"), F.coalesce("text", F.lit("")).alias("question"), F.when(t % 7 > 0, t % 7 / 20).alias("best"), F.concat(F.lit("Rent is capped"), F.when(t % 2 == 0, " [S1]").otherwise("")).alias("extract"),
        F.array(*[F.lit(f"p.{i}") for i in range(1, 6)]).alias("citations"), F.when(F.col("conv_id") % 3 == 0, "Facts.").alias("decision"),
    )
    return analysis.routed(rows)


# ---------------------------------------------------------------- replies and prompts
@query("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def parsed_replies(spark, d):
    """JSON of replies with fences, with words around it, bare, or without any."""
    k, props = F.col("event_id") % 5, F.col("props")
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), props, F.lit(" as asked"))).when(k == 2, F.concat(F.lit("```\n"), props, F.lit("```\nDone"))).when(k == 3, "none {today").otherwise(props)
    return _t(spark, d, "events").select("event_id", F.get_json_object(replies.json_reply(raw), "$.k").alias("k"))


_PROMPT = 'Answer as {"answer": "..."} for {question}.\n{context}\n{question}'


@query(f"SELECT item_id, md5(replace(replace({_Q(_PROMPT)}, '{{question}}', 'item ' || item_id), '{{context}}', text)) AS prompt_md5 FROM benchmark")
def rendered_prompts(spark, d):
    """Templates with some keys filled."""
    values = {"question": F.concat(F.lit("item "), F.col("item_id").cast("string")), "context": F.col("text")}
    return _t(spark, d, "benchmark").select("item_id", F.md5(replies.rendered(F.lit(_PROMPT), values)).alias("prompt_md5"))


# ---------------------------------------------------------------- evaluation
@query("""SELECT unnest(['size', 'name', 'flag', 'absent']) AS field, unnest([count(*), count(*), count(*), count(*) FILTER (p_partkey % 2 = 0)]) AS n,
 round(unnest([avg((p_partkey % 4 <> 0)::INT), avg((p_partkey % 3 <> 0)::INT), avg((p_partkey % 5 <> 0)::INT), 0]), 9) AS accuracy FROM part""")
def truth_accuracy(spark, d):
    """Long-form extractions of two readers against the truth, and the share of right ones by field."""
    k = F.col("p_partkey")
    p = _t(spark, d, "part").select(k.alias("doc_id"), "p_size", "p_name")
    i = F.col("doc_id")
    wanted = p.select("doc_id", F.col("p_size").cast("double").alias("size"), "p_name", (i % 2 == 0).alias("flag"), F.when(i % 2 == 0, "x").alias("absent")).withColumnRenamed("p_name", "name")
    truth = evaluation.long_form(wanted, ["size", "name", "flag", "absent"]).withColumnRenamed("value", "expected")
    first = p.select("doc_id", (F.col("p_size") + F.when(i % 4 == 0, 1).otherwise(0)).alias("size"), F.when(i % 3 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("name"))
    second = p.select("doc_id", F.when(i % 5 > 0, F.upper((i % 2 == 0).cast("string"))).otherwise("maybe").alias("flag"))
    got = evaluation.united(evaluation.long_form(first, ["size", "name"]), evaluation.long_form(second, ["flag"]).withColumn("reader", F.lit("second")))
    return evaluation.field_accuracy(evaluation.checked(truth, got.select("doc_id", "field", "value"))).withColumn("accuracy", F.round("accuracy", 9))


@query(f"{_FEATURED}, o AS (SELECT unnest([0, 1, 2, 3, 4]) AS ord, unnest(['Strong Coverage', 'Moderate Coverage', 'Caution Required', 'High Risk', 'None']) AS value) SELECT ord, value, (SELECT count(*) FROM a WHERE a.label = o.value) AS n FROM o")
def label_counts(spark, d):
    """Labels in a fixed order, one of which doesn't occur."""
    return evaluation.value_counts(_analysed(spark, d), "label", [*models.LABELS, "None"])


@query("SELECT c_mktsegment, min(c_acctbal)::DOUBLE AS least, round(quantile_cont(c_acctbal, 0.25), 4)::DOUBLE AS q1, round(quantile_cont(c_acctbal, 0.5), 4)::DOUBLE AS median, round(quantile_cont(c_acctbal, 0.75), 4)::DOUBLE AS q3, max(c_acctbal)::DOUBLE AS most FROM customer GROUP BY c_mktsegment")
def balance_quartiles(spark, d):
    """What a box plot shows."""
    got = evaluation.quartiles(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return got.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS \"column\", round(unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice), corr(l_linenumber, l_extendedprice)]), 8) AS corr FROM lineitem")
def correlation_ranks(spark, d):
    """Columns by their correlation with a target."""
    return evaluation.ranked_correlations(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]).withColumn("corr", F.round("corr", 8))


@query(f"{_FEATURED} SELECT round(corr(risk_flags_count, greatest(risk_flags_count - (policy_id % 4 = 0)::INT, 0)), 8) AS corr, round(avg((risk_flags_count = greatest(risk_flags_count - (policy_id % 4 = 0)::INT, 0))::INT), 8) AS equal FROM a")
def flag_replication(spark, d):
    """How counted flags agree with given ones."""
    given = F.greatest(F.col("risk_flags_count") - (F.col("policy_id") % 4 == 0).cast("int"), F.lit(0))
    got = evaluation.replication(_analysed(spark, d).withColumn("given", given), "risk_flags_count", "given")
    return got.select(F.round("corr", 8).alias("corr"), F.round("equal", 8).alias("equal"))


# ---------------------------------------------------------------- reports
@query("""SELECT p_partkey AS doc_id, unnest([2, 5, 25, 27]) AS ord, unnest(['UIN', 'Annual premium', 'Disease sub-limits', 'Cashless']) AS label,
 unnest([CASE WHEN p_partkey % 3 = 0 THEN 'Not clearly found' ELSE 'U' || p_partkey END, CASE WHEN p_partkey % 4 = 0 THEN 'Not clearly found' ELSE p_size::VARCHAR END,
 CASE WHEN p_partkey % 8 = 0 THEN 'Not clearly found' ELSE array_to_string(list_transform(range(1, least(p_partkey % 8, 6) + 1), lambda i: 'Rs 5 <= ' || i), '; ') || CASE WHEN p_partkey % 8 > 6 THEN ' ...' ELSE '' END END,
 CASE WHEN p_partkey % 5 = 0 THEN 'Not clearly found' WHEN p_partkey % 5 < 3 THEN 'Yes' ELSE 'No' END]) AS value, unnest(['p.' || (p_partkey % 3 + 1), '-', '-', '-']) AS page FROM part""")
def clause_tables(spark, d):
    """Clauses as a report shows them."""
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(
        k.alias("doc_id"), F.when(k % 3 > 0, F.concat(F.lit("U"), k.cast("string"))).alias("uin"), F.when(k % 4 > 0, F.col("p_size")).alias("annual_premium"),
        F.transform(F.slice(F.sequence(F.lit(1), F.lit(8)), F.lit(1), (k % 8).cast("int")), lambda i: F.concat(F.lit("₹5 ≤ "), i.cast("string"))).alias("disease_sub_limits"),
        F.when(k % 5 > 0, k % 5 < 3).alias("cashless_available"), F.map_from_arrays(F.array(F.lit("uin")), F.array(F.struct((k % 3 + 1).cast("int").alias("page"), F.lit("").alias("quote")))).alias("evidence"),
    )
    return reports.clause_table(rows)


@query("""SELECT p_partkey, 3 AS n_rows, 3 AS n_cells, md5(p_name || '|' || p_brand || '|') AS second_md5 FROM part""")
def markdown_tables(spark, d):
    """Cells of pipe tables, without separators, padded."""
    lines = F.array(F.lit("| Name | Brand | More |"), F.lit("|---|:--:|---|"), F.concat(F.lit("|"), "p_name", F.lit(" |"), "p_brand", F.lit("|")), F.lit("a|b"))
    cells = replies.table_cells(lines)
    return _t(spark, d, "part").select("p_partkey", F.size(cells).alias("n_rows"), F.size(cells[2]).alias("n_cells"), F.md5(F.array_join(cells[1], "|")).alias("second_md5"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def latest_turns(spark, d):
    """The last entries of each log."""
    return reports.latest(_t(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("SELECT doc_id, ceil(len(string_split(text, chr(10))) / 6)::BIGINT AS pages, ceil(ceil(len(string_split(text, chr(10))) / 6) / 5)::BIGINT AS ocr_pages FROM documents WHERE text IS NOT NULL")
def page_counts(spark, d):
    """Pages, and those that were read from images."""
    return reports.page_counters(_as_pages(spark, d).withColumn("ocr", F.col("page") % 5 == 0))


def _markup_sql(text: str) -> str:
    for old, new in replies.GLYPHS.items():
        text = f"replace({text}, '{old}', '{new}')"
    text = rf"regexp_replace({text}, 'Rs\s+([0-9])', 'Rs \1', 'g')"
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = f"replace({text}, '{old}', '{new}')"
    return rf"regexp_replace({text}, '\*\*(.+?)\*\*', '<b>\1</b>', 'g')"


_ODD = "₹  5 → **x** – ½ ≥ 3"


@query(f"SELECT conv_id, turn, md5({_markup_sql(f"coalesce(text, '') || ' {_ODD}'")}) AS markup_md5 FROM conversations")
def marked_up(spark, d):
    """Whole texts as markup, with glyphs that plain fonts lack."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" " + _ODD))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(replies.bold(text)).alias("markup_md5"))
