"""Requests to a language model, with a log by content: what has been answered is never asked again.

A client is any callable (system, prompt, json, max_tokens) -> text that raises on failure. It runs in tasks. Requests
of equal content are one; a reply is written to the log, a file named by the hash of its request, before the task goes
on, so a task that is run again, or twice, finds what was answered. A failure is asked again with growing pauses,
then becomes a row with its error, and isn't logged: a later run asks it anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from ..storage import kept
from . import validation

Client = Callable[[str, str, bool, int], str]
JSON_ONLY = "\n\nReturn ONLY valid JSON."

#: Groups of fields that are asked for together, and the questions that find their context.
GROUPS = {
    "overview": ["insurer_name", "policy_name", "uin", "policy_type", "sum_insured", "sum_insured_options", "annual_premium", "policy_term_years", "family_members_covered", "age_band", "coverage_category"],
    "coverage": [
        "inpatient_hospitalization", "pre_hospitalization_days", "post_hospitalization_days", "day_care_covered", "ambulance_cover", "domiciliary_covered", "restoration_benefit", "restoration_details", "no_claim_bonus",
        "no_claim_bonus_details", "maternity_covered", "maternity_details", "newborn_covered", "child_coverage", "child_coverage_details", "ayush_covered", "opd_covered",
    ],
    "restrictions": [
        "initial_waiting_period_days", "ped_waiting_period_months", "specific_disease_waiting_period_months", "copayment_percentage", "copayment_conditions", "room_rent_limit_present", "room_rent_limit", "icu_limit_present", "icu_limit",
        "disease_sub_limits", "permanent_exclusions", "temporary_exclusions", "non_payable_items_mentioned",
    ],
    "claims_renewal": ["cashless_available", "reimbursement_available", "claim_intimation_timeline", "claim_documents_listed", "claim_settlement_timeline", "renewal_conditions", "grace_period_days", "portability_mentioned", "moratorium_mentioned"],
}
SUMMARY_LINES, LEAST_QUESTIONS, MOST_QUESTIONS = (6, 25), 6, 12
JUDGED = ["groundedness", "clause_accuracy", "simplicity", "risk_caution", "citation"]


class RequestError(RuntimeError):
    """A request that stayed without an answer."""


def _answer(client: Client, row: dict, retries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(reply, error, calls)."""
    error = ""
    for attempt in range(retries):
        try:
            return client(row["system"], row["prompt"], row["json"], row["max_tokens"]), None, attempt + 1
        except Exception as e:  # noqa: BLE001  whatever a client raises is a failed call
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < retries:
                time.sleep(wait * 2**attempt)
    return None, error, retries


def asked(requests: DataFrame, client: Client, log: str, model: str = "", retries: int = 3, wait: float = 2.0) -> DataFrame:
    """requests(system, prompt, json, max_tokens and others) with reply, error and calls (0: found in the log). log: a folder of the cluster's."""
    own = F.struct(F.lit(model).alias("model"), "system", "prompt", "json", "max_tokens")
    keyed = requests.withColumn("_key", F.sha2(F.to_json(own), 256))
    once = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("system", "prompt", "json", "max_tokens")])

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(log) if "://" in log else (fs.LocalFileSystem(), log.removeprefix("file:"))
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['_key'][:2]}/{row['_key']}.json"
                if store.get_file_info(path).type == fs.FileType.File:
                    with store.open_input_stream(path) as f:
                        got = json.loads(f.read())["reply"], None, 0
                else:
                    got = _answer(client, row, retries, wait)
                    if got[0] is not None:
                        store.create_dir(f"{root}/{row['_key'][:2]}", recursive=True)
                        part = f"{path}.{time.time_ns()}"
                        with store.open_output_stream(part) as f:
                            f.write(json.dumps({"reply": got[0]}).encode())
                        store.move(part, path)  # whole or not at all
                yield pa.RecordBatch.from_pylist([{"_key": row["_key"], "reply": got[0], "error": got[1], "calls": got[2]}], schema=pa.schema([("_key", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("calls", pa.int32())]))

    answered = kept(once.mapInArrow(run, "_key string, reply string, error string, calls int"))
    return keyed.join(answered, "_key").drop("_key")


def chat(system: str | Column, prompt: Column, as_json: bool = False, max_tokens: int = 2048) -> list[Column]:
    """The columns of a request."""
    system = F.lit(system) if isinstance(system, str) else system
    prompt = F.concat(prompt, F.lit(JSON_ONLY)) if as_json else prompt
    return [system.alias("system"), prompt.alias("prompt"), F.lit(as_json).alias("json"), F.lit(max_tokens).alias("max_tokens")]


# ---------------------------------------------------------------- fields of a policy
def kind(field: str) -> str:
    return next(k for k, fields in (("int", validation.INTS), ("float", validation.FLOATS), ("bool", validation.BOOLS), ("list", validation.LISTS), ("str", validation.TEXTS)) if field in fields)


def field_requests(contexts: DataFrame, template: str, system: str, max_tokens: int = 2500) -> DataFrame:
    """A request for each of contexts(doc_id, part, context), part a name of GROUPS; template has {fields} and {context}."""
    spec = F.create_map(*[F.lit(x) for g, fields in GROUPS.items() for x in (g, "\n".join(f'- "{f}" ({kind(f)})' for f in fields))])
    prompt = R.rendered(F.lit(template), {"fields": spec[F.col("part")], "context": F.col("context")})
    return contexts.select("doc_id", "part", *chat(system, prompt, True, max_tokens))


def field_values(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of asked(field_requests()) the (doc_id, field, value, evidence) that were asked for, the (doc_id, ord, clause)
    that stay open, and the (doc_id, part, error) of groups without a usable reply."""
    own = replies.select("doc_id", "part", "error", R.json_reply(F.col("reply")).alias("j")).withColumn("m", F.from_json("j", "map<string,string>"))
    failed = own.where("m IS NULL").select("doc_id", "part", F.coalesce("error", F.lit("no JSON in the reply")).alias("error"))
    good = kept(own.where("m IS NOT NULL"))
    of = F.create_map(*[F.lit(x) if isinstance(x, str) else x for g, fields in GROUPS.items() for x in (g, F.array(*map(F.lit, fields)))])
    rows = good.select("doc_id", F.explode(F.map_filter("m", lambda k, _: F.array_contains(of[F.col("part")], k))).alias("field", "value"))
    proofs = good.select("doc_id", F.explode(F.from_json(F.col("m")["evidence"], "map<string,struct<page:int,quote:string>>")).alias("field", "evidence")).where("evidence IS NOT NULL")
    proofs = proofs.groupBy("doc_id", "field").agg(F.max("evidence").alias("evidence"))
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("part"))
    said = good.select("doc_id", place.alias("g"), F.posexplode(F.from_json(F.col("m")["ambiguous_clauses"], "array<string>")).alias("i", "clause")).where("clause IS NOT NULL")
    open_ = said.select("doc_id", (F.col("g") * 1000 + F.col("i")).cast("int").alias("ord"), "clause")
    # evidence may be of a field that another group's reply holds, or that none does
    return rows.join(proofs, ["doc_id", "field"], "full"), open_, failed


def read_policies(rules: DataFrame, open_rules: DataFrame, replies: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values with notes and evidence, open clauses, method by document) of the rules' values and, if there is one, the model's."""
    if replies is None:
        method = rules.select("doc_id", F.lit("rules").alias("method")).distinct()
        return validation.checked(rules), validation.merged_open(open_rules, open_rules.limit(0)), method
    values, open_, _ = field_values(replies)
    method = rules.select("doc_id").distinct().join(values.select("doc_id", F.lit("llm+rules").alias("method")).distinct(), "doc_id", "left")
    return validation.merged(rules, values), validation.merged_open(open_rules, open_), method.select("doc_id", F.coalesce("method", F.lit("rules")).alias("method"))


# ---------------------------------------------------------------- texts
def narrative(reply: Column) -> Column:
    """What a model says of a comparison, without advice; null without a reply."""
    return T.sanitize(reply)


def summary_lines(reply: Column, instead: Column) -> Column:
    """Q12: the lines of a reply that are items, if there are 6 to 25, else those given instead."""
    text = F.regexp_replace(reply, r"(?i)\s*[\[【]\s*(extraction\s*)?json\s*[\]】]", "")
    text = T.sanitize(F.translate(text, "【】", "[]"))
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), T.strip), lambda x: x.rlike(r"^[-*•]"))
    lines = F.transform(lines, lambda x: F.concat(F.lit("- "), T.strip(F.regexp_replace(x, r"^[-*• ]+", ""))))
    return F.when(F.size(lines).between(*SUMMARY_LINES), lines).otherwise(instead)


def advisor_questions(reply: Column, instead: Column) -> Column:
    """Up to twelve questions of a reply, if it has six, else those given instead."""
    said = F.from_json(R.json_reply(reply), "struct<questions:array<string>>")["questions"]
    said = F.transform(F.filter(said, lambda x: x.isNotNull()), T.sanitize)
    return F.when(F.size(said) >= LEAST_QUESTIONS, F.slice(said, 1, MOST_QUESTIONS)).otherwise(instead)


def judgement(reply: Column) -> Column:
    """A judge's marks from 1 to 5 and whether it saw an invention; nulls without a usable reply."""
    return F.from_json(R.json_reply(reply), "struct<" + ", ".join(f"{j}:double" for j in JUDGED) + ", hallucination:boolean>")


def judged(rows: DataFrame) -> DataFrame:
    """One row: mean marks and the share of inventions of rows with judge, as judgement() gives it."""
    return rows.agg(*[F.avg(F.col("judge")[j]).alias(j) for j in JUDGED], F.avg(F.col("judge")["hallucination"].cast("double")).alias("hallucination"), F.count_if(F.col("judge").isNull()).alias("unjudged"))
