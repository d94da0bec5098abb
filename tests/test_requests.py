"""The request log, and what is made of a model's replies."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parchment.operators import requests

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this file


class Scripted:
    """Answers by the prompt, writes down each call, and breaks off the run at one prompt until told not to."""

    def __init__(self, folder, breaks=""):
        self.folder, self.breaks = str(folder), breaks

    def __call__(self, system, prompt, as_json, max_tokens):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if prompt == self.breaks:
            raise SystemExit("the executor is lost")
        if "fail" in prompt:
            raise TimeoutError("busy")
        return prompt.upper()

    def calls(self):
        return [json.loads(x) for x in open(f"{self.folder}/calls")] if os.path.exists(f"{self.folder}/calls") else []


def asks(spark, *prompts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").select("i", *requests.chat("s", F.col("p")))


def test_nothing_is_asked_twice(spark, tmp_path):
    client = Scripted(tmp_path)
    got = {r.i: r for r in requests.asked(asks(spark, "a", "b", "a", "fail"), client, str(tmp_path / "log"), wait=0.0).collect()}
    assert [got[i].reply for i in range(4)] == ["A", "B", "A", None] and got[3].error == "TimeoutError: busy" and got[3].calls == 3
    assert sorted(client.calls()) == ["a", "b", "fail", "fail", "fail"]
    again = {r.i: r for r in requests.asked(asks(spark, "b", "c", "fail"), client, "file://" + str(tmp_path / "log"), retries=1).collect()}
    assert [(again[i].reply, again[i].calls) for i in range(3)] == [("B", 0), ("C", 1), (None, 1)]
    assert sorted(client.calls()) == ["a", "b", "c", "fail", "fail", "fail", "fail"]
    assert requests.asked(asks(spark, "a"), client, str(tmp_path / "log"), model="another", wait=0.0).first().calls == 1


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    prompts = [f"p{i}" for i in range(12)]
    client = Scripted(tmp_path, "p5")
    with pytest.raises(Exception):  # noqa: B017
        requests.asked(asks(spark, *prompts).coalesce(1), client, str(tmp_path / "log")).collect()
    answered = [p for p in client.calls() if p != "p5"]
    client.breaks = ""
    got = requests.asked(asks(spark, *prompts), client, str(tmp_path / "log")).collect()
    assert sorted(r.reply for r in got) == sorted(p.upper() for p in prompts)
    assert sorted(p for p in client.calls() if p != "p5") == sorted(p for p in prompts if p != "p5") and len(answered) == len(set(answered))


def model(system, prompt, as_json, max_tokens):
    """One that reads the same of every policy, and fails for one group."""
    if '"cashless_available"' in prompt:
        raise TimeoutError("busy")
    if '"uin"' in prompt:
        return "Sorry, nothing."
    return json.dumps({
        "copayment_percentage": "10%", "ped_waiting_period_months": "4 years", "restoration_benefit": "no", "made_up": 1, "evidence": {"copayment_percentage": {"page": 2, "quote": "co-payment of 10%"}}, "ambiguous_clauses": ["at its sole discretion"],
    })


def test_policies_read_by_rules_and_model(spark, tmp_path):
    rules = spark.createDataFrame([("a", "copayment_percentage", "10.0", (4, "x")), ("a", "restoration_benefit", "true", None), ("b", "uin", "U", None)], "doc_id string, field string, value string, evidence struct<page:int, quote:string>")
    open_rules = spark.createDataFrame([("a", 1, "p.3: from time to time")], "doc_id string, ord int, clause string")
    contexts = spark.createDataFrame([("a", g, f"context of {g} {{fields}}") for g in requests.GROUPS], "doc_id string, part string, context string")
    replies = requests.asked(requests.field_requests(contexts, "Fill:\n{fields}\nfrom\n{context}", "s"), model, str(tmp_path / "log"), wait=0.0)
    values, open_, method = requests.read_policies(rules, open_rules, replies)
    got = {(r.doc_id, r.field): r for r in values.collect()}
    assert got["a", "ped_waiting_period_months"].value == "48" and got["a", "copayment_percentage"].value == "10.0" and got["a", "copayment_percentage"].evidence.page == 2
    assert got["a", "restoration_benefit"].value == "true" and "LLM read 'False', rule extractor found 'True'" in got["a", "restoration_benefit"].notes[0]
    assert ("a", "made_up") not in got and got["b", "uin"].value == "U"
    assert [r.clause for r in open_.orderBy("ord").collect()] == ["p.3: from time to time", "at its sole discretion"]
    assert {r.doc_id: r.method for r in method.collect()} == {"a": "llm+rules", "b": "rules"}
    assert {(r.part, r.error) for r in requests.field_values(replies)[2].collect()} == {("overview", "no JSON in the reply"), ("claims_renewal", "TimeoutError: busy")}
    alone, _, how = requests.read_policies(rules, open_rules, None)
    assert alone.count() == 3 and {r.method for r in how.collect()} == {"rules"}


def test_texts_of_a_model(spark):
    lines = "Here:\n" + "\n".join(f" * line {i} [JSON] 【S1】" for i in range(7)) + "\nYou should buy this policy"
    ask = json.dumps({"questions": ["What of co-payment?", None, *[f"q{i}" for i in range(14)]]})
    judge = '```json\n{"groundedness": 5, "clause_accuracy": 4, "simplicity": 3, "risk_caution": 5, "citation": 1, "hallucination": true, "comment": "c"}```'
    own = F.array(F.lit("own"))
    df = spark.createDataFrame([(lines, ask, judge), ("- too few", '{"questions": ["one"]}', "none"), (None, None, None)], "l string, q string, j string")
    got = df.select(requests.summary_lines(F.col("l"), own).alias("l"), requests.advisor_questions(F.col("q"), own).alias("q"), requests.narrative(F.col("l")).alias("n"), requests.judgement(F.col("j")).alias("judge"))
    a, b, c = got.collect()
    assert a.l == [f"- line {i} [S1]" for i in range(7)] and b.l == c.l == ["own"]
    assert a.q[0] == "What of co-payment?" and len(a.q) == 12 and b.q == c.q == ["own"] and "you should buy" not in a.n.lower() and c.n is None
    one = requests.judged(got).first()
    assert (one.groundedness, one.citation, one.hallucination, one.unjudged) == (5, 1, 1, 2)
