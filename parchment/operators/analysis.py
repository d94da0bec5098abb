"""From extracted clauses to features, flags with reasons and sources, questions, summaries and routed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import apart
from . import answers, scoring

Field = Callable[[str], Column]

#: Feature, the extracted field it comes from, and its name where it is missing.
IMPUTED_FROM = [
    ("sum_insured", "sum_insured", "Sum insured"), ("annual_premium", "annual_premium", "Annual premium"),
    ("waiting_period_months", "specific_disease_waiting_period_months", "Specified-disease waiting period"),
    ("pre_existing_disease_waiting_period_months", "ped_waiting_period_months", "Pre-existing disease waiting period"),
    ("copayment_percentage", "copayment_percentage", "Co-payment"), ("exclusion_count", "exclusion_count", "Exclusion list"),
]
UNCLEAR = [("room_rent_limit_present", "Room rent limit"), ("icu_limit_present", "ICU limit"), ("restoration_benefit", "Restoration benefit")]
PRESENT = {
    "room_rent_limit_present": "room_rent_limit_present", "icu_limit_present": "icu_limit_present", "restoration_benefit_present": "restoration_benefit",
    "no_claim_bonus_present": "no_claim_bonus", "child_coverage_present": "child_coverage", "maternity_coverage_present": "maternity_covered",
}
COUNTED = {"disease_sub_limit_count": "disease_sub_limits", "ambiguous_clause_count": "ambiguous_clauses"}
#: Why a flag matters, in the order of scoring.FLAGS.
WHY = [
    "Claims for conditions you already have may not be paid for several years.",
    "You pay this share of every admissible claim from your own pocket.",
    "Choosing a costlier room can reduce the whole claim proportionately, not just the room charge.",
    "Long ICU stays can exceed the cap and the excess is paid by you.",
    "Common surgeries (e.g. cataract, joint replacement) may be paid only up to a fixed amount.",
    "More situations where claims are simply not payable.",
    "Vague wording leaves room for disputes at claim time.",
    "If the sum insured is used up, there is no automatic top-up in the same year.",
    "Unclear timelines/documents increase the chance of claim delays or rejection.",
    "Listed illnesses/surgeries are not covered for the first 2+ years.",
]
#: The extracted field whose page proves a feature.
PROOF = {
    "pre_existing_disease_waiting_period_months": "ped_waiting_period_months", "copayment_percentage": "copayment_percentage", "room_rent_limit_present": "room_rent_limit_present",
    "icu_limit_present": "icu_limit_present", "disease_sub_limit_count": "disease_sub_limits", "restoration_benefit_present": "restoration_benefit", "waiting_period_months": "specific_disease_waiting_period_months",
}
SHOWN = {"High Risk": "High Risk / Needs Advisor Review"}
PREAMBLE = "**This assistant does not make buy / switch / cancel decisions.** Here is "
DECIDE = "Verify: the final decision should be made with the insurer or a licensed advisor."


def said(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x.cast("string")


def say(*parts: str | Column) -> Column:
    return F.concat(*map(said, parts))


def plain(number: Column) -> Column:
    """A number without a fraction that is 0."""
    return F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(number.cast("double").cast("string"))


def listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def features(extracted: DataFrame, overrides: DataFrame | None = None, notes: str | None = None) -> DataFrame:
    """A row of features for each row of clauses.extract, with unclear (names) and flags; overrides(doc_id, sum_insured, annual_premium).

    The extraction stays in x. A value of the user's own stands before the extracted one; 0 counts as none.
    """
    df = extracted.select("doc_id", F.struct(*extracted.columns).alias("x"))
    x = lambda c: F.col(f"x.{c}")
    if overrides is not None:
        df = df.join(apart(overrides.select("doc_id", F.struct("sum_insured", "annual_premium").alias("own"))), "doc_id", "left")
    else:
        df = df.withColumn("own", F.struct(F.lit(None).cast("long").alias("sum_insured"), F.lit(None).cast("long").alias("annual_premium")))
    value = {k: scoring.given(F.col(f"own.{k}"), x(f)) if k in ("sum_insured", "annual_premium") else x(f) for k, f, _ in IMPUTED_FROM}
    unclear = listed(*[F.when(value[k].isNull(), F.lit(name)) for k, _, name in IMPUTED_FROM], *[F.when(x(f).isNull(), F.lit(name)) for f, name in UNCLEAR])
    df = df.withColumns(
        {"policy_type": F.when(x("policy_type").isin(scoring.TYPES), x("policy_type")).otherwise("Individual Health")} | value
        | {k: F.coalesce(x(f).cast("int"), F.lit(0)) for k, f in PRESENT.items()} | {k: F.greatest(F.coalesce(F.size(x(f)), F.lit(0)), F.lit(0)) for k, f in COUNTED.items()}
        | {"claim_process_clarity_score": scoring.claim_clarity([F.coalesce(_true(extracted, f), F.lit(False)) for f in scoring.CLAIM_FIELDS]), "names": unclear}
    )
    return scoring.featured(df).drop("unclear").withColumnRenamed("names", "unclear")


def _true(extracted: DataFrame, field: str) -> Column:
    """Whether a field says something: true, or a text that isn't empty."""
    c = F.col(f"x.{field}")
    return c if extracted.schema[field].dataType.simpleString() == "boolean" else c != ""


def source(field: str | None) -> Column:
    page = F.try_element_at(F.col("x.evidence"), F.lit(field or ""))["page"]
    return F.coalesce(F.concat(F.lit("p."), F.nullif(page, F.lit(0)).cast("string")), F.lit("-"))


def _flag(severity: str, flag: Column, why: Column, at: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), flag.alias("flag"), why.alias("why"), at.alias("source"))


def risk_flags(df: DataFrame, notes: Column | None = None) -> DataFrame:
    """Df of features() with profile(age, has_ped, planning_child, adding_child) gets risks: model flags, the profile's, and what to verify."""
    p, f, x = (lambda c: F.col(f"profile.{c}")), F.col, (lambda c: F.col(f"x.{c}"))
    ped = "pre_existing_disease_waiting_period_months"
    model = [F.when(scoring._holds(k, op, b), _flag("High" if k in scoring.HIGH else "Medium", F.lit(text), F.lit(why), source(PROOF.get(k)))) for (k, op, b, text), why in zip(scoring.FLAGS, WHY)]
    own = [
        F.when((p("age") >= 60) & (f("copayment_percentage") > 0), _flag("High", say("Co-payment applies and policyholder age is ", p("age")), F.lit("Senior-age claims are usually larger, so a % co-pay costs more."), source("copayment_percentage"))),
        F.when(p("has_ped") & (f(ped) > 0), _flag("High", F.lit("You reported a pre-existing condition"), say("It may not be covered for ", plain(f(ped)), " months."), source("ped_waiting_period_months"))),
        F.when(p("planning_child") & ~F.coalesce(x("maternity_covered"), F.lit(False)), _flag("High", F.lit("Maternity cover not found but a child is planned"), F.lit("Delivery and newborn expenses may not be covered."), source("maternity_covered"))),
        F.when(p("adding_child") & ~F.coalesce(x("child_coverage"), F.lit(False)), _flag("Medium", F.lit("Child coverage not clearly found"), F.lit("Confirm whether / at what age a dependent child can be added."), source("child_coverage"))),
    ]
    verify = F.transform("unclear", lambda u: _flag("Verify", F.concat(u, F.lit(" not clearly found in the document")), F.lit("A typical value was assumed for scoring - confirm the real value."), F.lit("-")))
    noted = F.transform(F.slice(notes if notes is not None else F.array().cast("array<string>"), 1, 5), lambda n: _flag("Verify", F.lit("Extraction cross-check"), n, F.lit("-")))
    return df.withColumn("risks", F.concat(listed(*model, *own), verify, noted))


def advisor_questions(x: Field, f: Field, profile: Field, comparing: Column) -> Column:
    """Up to twelve questions to ask, in order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    always = [
        F.when(f("copayment_percentage") > 0, say("The policy mentions ", plain(f("copayment_percentage")), "% co-payment - does it apply to all claims or only certain ages / cities / non-network hospitals?")),
        F.when(yes(x("room_rent_limit_present")), F.lit("What exactly is the room rent limit, and will 'proportionate deduction' reduce other bills if I choose a higher room category?")),
        F.when(yes(x("icu_limit_present")), F.lit("What is the ICU per-day limit and what happens if the ICU bill is above it?")),
        say("Please confirm the pre-existing disease waiting period (", F.coalesce(F.nullif(x("ped_waiting_period_months"), F.lit(0)).cast("string"), F.lit("not found")), " months) and which of my conditions it covers."),
        F.when(has(x("disease_sub_limits")), F.lit("Which treatments have sub-limits (e.g. cataract, joint replacement) and what are the amounts?")),
        F.when(~yes(x("restoration_benefit")), F.lit("Is there any restoration / recharge of the sum insured if it is exhausted during the year?")),
        F.lit("What is the list of non-payable items / consumables, and is there any add-on to cover them?"),
        F.lit("What are the claim intimation timelines and documents needed for cashless and reimbursement?"),
        F.when(yes(profile("planning_child")) | yes(profile("adding_child")), F.lit("From what age can a newborn / child be added, and is maternity covered with what waiting period?")),
        F.when(comparing, F.lit("If I port to the new policy, how much waiting-period credit will I get, and is it in writing?")),
        F.when(comparing, F.lit("Will my accumulated no-claim / cumulative bonus carry over?")),
    ]
    vague = F.transform(F.slice(F.coalesce(x("ambiguous_clauses"), F.array().cast("array<string>")), 1, 2), lambda c: F.concat(F.lit("Please explain this clause in simple terms: "), F.left(c, F.lit(140))))
    return F.slice(F.concat(listed(*always), vague), 1, 12)


def shown(label: Column) -> Column:
    """A label as displayed."""
    return F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in SHOWN.items()], label)


def strengths(f: Field, post_days: Column) -> Column:
    items = [
        (f("copayment_percentage") == 0, F.lit("no general co-payment found")), (f("room_rent_limit_present") == 0, F.lit("no room-rent cap found")), (f("restoration_benefit_present") == 1, F.lit("restoration of sum insured available")),
        (f("no_claim_bonus_present") == 1, F.lit("no-claim / cumulative bonus available")), (f("maternity_coverage_present") == 1, F.lit("maternity cover available")), (post_days >= 90, say("long post-hospitalisation cover (", post_days, " days)")),
    ]
    return listed(*[F.when(c, t) for c, t in items])


def decision_text(f: Field, post_days: Column, score: Column, label: Column, risks: Column, questions: Column) -> Column:
    """Q09: facts and questions in place of a verdict; risks as risk_flags() gives them."""
    good = F.array_join(strengths(f, post_days), ", ")
    cautions = F.slice(F.filter(risks, lambda r: r["severity"].isin("High", "Medium")), 1, 6)
    lines = F.transform(cautions, lambda r: F.concat(F.lit("- "), r["flag"], F.lit(" ("), r["source"], F.lit(") - "), r["why"]))
    asks = F.transform(F.slice(questions, 1, 5), lambda q: F.concat(F.lit("- "), q))
    head = F.array(
        say("Coverage Clarity Score: **", score, "/100 (", shown(label), ")**."), F.lit(""), say("**Appears stronger in:** ", F.when(good == "", "no clear strengths detected").otherwise(good)), F.lit(""), F.lit("**Needs caution in:**"),
    )
    tail = F.concat(F.array(F.lit(""), F.lit("**Ask these before deciding:**")), asks, F.array(F.lit(""), F.lit(DECIDE)))
    return F.array_join(F.concat(head, F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("- none detected"))), tail), "\n")


def yes_no(flag: Column) -> Column:
    """a flag of three states, as shown."""
    return F.when(flag.isNull(), "Not clearly stated (verify)").when(flag, "Yes").otherwise("No")


def short(text: Column, n: int = 110) -> Column:
    """White space as single spaces; longer texts end at a word's end."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.left(t, F.lit(n))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) [^ ]*$", "$1"), F.lit("…")))


def summary(x: Field, f: Field, score: Column, label: Column) -> Column:
    """Q11: fifteen lines about a policy."""
    known = lambda c, none: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit(none))
    named = lambda before, c: F.when(c != "", F.concat(F.lit(before), c)).otherwise("")
    about = lambda c: F.when(c != "", F.concat(F.lit(" ("), short(c), F.lit(")"))).otherwise("")
    money = lambda c: F.format_number(c, 0)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    lines = [
        say("- This is a ", F.coalesce(x("policy_type"), F.lit("health")), " policy", F.coalesce(named(" named ", x("policy_name")), F.lit("")), F.coalesce(named(" from ", x("insurer_name")), F.lit("")), "."),
        say("- Sum insured used for analysis: Rs ", money(f("sum_insured")), "; annual premium: Rs ", money(f("annual_premium")), "."),
        say("- Hospital stay (in-patient) cover: ", yes_no(x("inpatient_hospitalization")), "; day-care procedures: ", yes_no(x("day_care_covered")), "."),
        say("- Expenses before/after hospitalisation: ", known(x("pre_hospitalization_days"), "?"), " days before and ", known(x("post_hospitalization_days"), "?"), " days after."),
        say("- Pre-existing diseases are covered only after ", known(x("ped_waiting_period_months"), "? (verify)"), " months; specified illnesses after ", known(x("specific_disease_waiting_period_months"), "? (verify)"), " months."),
        say("- New illnesses (other than accidents) are not covered for the first ", known(x("initial_waiting_period_days"), "? (verify)"), " days."),
        say("- Co-payment: ", plain(f("copayment_percentage")), "% of each claim is paid by you", F.coalesce(about(x("copayment_conditions")), F.lit("")), "."),
        say("- Room rent limit: ", yes_no(x("room_rent_limit_present")), F.coalesce(about(x("room_rent_limit")), F.lit("")), "."),
        say("- ICU limit: ", yes_no(x("icu_limit_present")), "."),
        say("- Disease-wise sub-limits found: ", f("disease_sub_limit_count"), "; exclusions listed: about ", plain(f("exclusion_count")), "."),
        say("- Restoration of sum insured: ", yes_no(x("restoration_benefit")), "; no-claim bonus: ", yes_no(x("no_claim_bonus")), "."),
        say("- Maternity: ", yes_no(x("maternity_covered")), "; newborn: ", yes_no(x("newborn_covered")), "; dependent child: ", yes_no(x("child_coverage")), "."),
        say("- Claims: cashless ", yes_no(x("cashless_available")), ", reimbursement ", yes_no(x("reimbursement_available")), "; claim process clarity ", f("claim_process_clarity_score"), "/100."),
        say("- Coverage Clarity Score: ", score, "/100 (", shown(label), ")."),
        say("- ", size(x("ambiguous_clauses")), " vague / schedule-dependent clauses need verification."),
    ]
    return F.array(*lines)


def routed(rows: DataFrame) -> DataFrame:
    """Q08: (question_id, answer, grounded, advice) of rows(question_id, question, best, extract, citations, decision).

    best: the best hit's score, null without hits; extract: the answer from the hits; decision: the facts about the policy,
    null where there is no analysis; citations: array of 'citation' texts of the hits in order.
    """
    advice, weak = T.asks_advice(F.col("question")), F.coalesce(F.col("best") < answers.WEAK, F.lit(True))
    refused = F.lit(answers.NOT_FOUND + " Please ask the insurer to point you to the exact clause.")
    facts = F.concat(F.lit(PREAMBLE + "a factual summary to discuss with a licensed advisor:\n\n"), F.col("decision"))
    own = T.sanitize(F.col("extract"))
    own = F.when(advice, F.concat(F.lit(PREAMBLE + "what the document says so you can discuss it with a licensed advisor:\n\n"), own)).otherwise(own)
    tags = F.array_join(F.transform(F.slice("citations", 1, 3), lambda c, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), c)), "; ")
    bare = ~own.rlike(r"\[S\d+\]") & ~F.contains(own, F.lit(answers.NOT_FOUND))
    own = F.when(bare, F.concat(own, F.lit("\n\nSources: "), tags)).otherwise(own)
    decided = advice & F.col("decision").isNotNull()
    grounded = F.when(decided, True).when(weak, False).otherwise(~F.contains(own, F.lit(answers.NOT_FOUND)))
    return rows.select("question_id", F.when(decided, facts).when(weak, refused).otherwise(own).alias("answer"), grounded.alias("grounded"), advice.alias("advice"))


def slim(fields: Column) -> Column:
    """A map of texts without empty values and without what only proves or annotates."""
    return F.map_filter(fields, lambda k, v: ~k.isin("evidence", "validation_notes") & v.isNotNull() & ~v.isin("", "[]"))
