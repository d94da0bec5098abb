"""Registered queries of requests to a model, answered by a scripted client, each with its SQL."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from ..functions import replies as R
from ..operators import requests
from ..storage import shared_dir
from .queries import _t, query


def counting(system: str, prompt: str, as_json: bool, max_tokens: int) -> str:
    """A scripted client: fails for some prompts, chats for others, else counts the characters of the question."""
    n = len(re.search(r"(?s)<q>(.*)</q>", prompt)[1])
    if n % 7 == 0:
        raise TimeoutError("busy")
    return "I can't say." if n % 7 == 1 else f"```json\n{json.dumps({'n': n})}\n```"


@query("""WITH q AS (SELECT conv_id, turn, length(text) AS n, (text IS NULL)::INT AS none FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 7 > 1 THEN n END AS n, CASE WHEN n % 7 = 0 THEN 'TimeoutError: busy' END AS error FROM q WHERE none = 0""")
def logged_requests(spark, d):
    """Texts of all turns to a client through the log; equal ones are asked once, failures are rows."""
    prompt = F.concat(F.lit("Count. <q>"), "text", F.lit("</q>"))
    rows = _t(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", *requests.chat("You count.", prompt, True))
    got = requests.asked(rows, counting, f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}", retries=2, wait=0.0)
    return got.select("conv_id", "turn", F.get_json_object(R.json_reply(F.col("reply")), "$.n").cast("long").alias("n"), "error")
