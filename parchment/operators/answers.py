"""Answers from retrieved text: wider questions, sentences by shared words, refusals, and the flags of an evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import apart

#: Words of questions and what policies say instead; words that are no facts; texts of answers.
SYNONYMS = {
    "copay": "co-payment copayment co-pay cost sharing",
    "co-pay": "co-payment copayment cost sharing",
    "room": "room rent boarding nursing single private room",
    "icu": "intensive care unit iccu",
    "pre-existing": "pre-existing disease ped excl01 waiting period",
    "ped": "pre-existing disease excl01",
    "waiting": "waiting period months continuous coverage excl01 excl02 excl03",
    "child": "dependent child children newborn baby age",
    "newborn": "new born baby maternity",
    "baby": "new born newborn maternity",
    "maternity": "maternity delivery pregnancy childbirth newborn",
    "restoration": "restoration restore restored recharge refill",
    "restore": "restoration restored recharge",
    "exclusion": "exclusions excluded not covered excl",
    "claim": "claim cashless reimbursement intimation documents tpa",
    "switch": "portability migration continuity waiting period credit",
    "ncb": "no claim bonus cumulative bonus",
    "bonus": "no claim bonus cumulative bonus",
    "renew": "renewal grace period lifelong",
}
GENERIC = """applicable apply applies capped cap limited limit limits separately process major main always
better best worse low high much many long period available allowed included include get give need required
take taken treatment treatments insurer company verify risks risk switching before after should buy
current proposed plan exactly know""".split()
NOT_FOUND = "Not clearly found in the uploaded document."
FOUND = "Most relevant wording found in the document (offline mode - add an LLM key for a plain-English answer):\n"
CLOSEST = "Closest wording (may not answer your question):\n"
VERIFY = "\n\nVerify: confirm the exact meaning with the insurer/advisor."
CITED = r"\[S\d+\]|Sources:|\(p\.\d+\)"
UNSAFE = r"(?i)\b(you should|i recommend|we recommend|definitely) (buy|switch|cancel|purchase|port)\b|\b(buy|switch to) this policy\b(?! decisions)"
ALLOWED = "does not make buy / switch / cancel"
WEAK, PICKED = 0.12, 3


def expanded(question: Column) -> Column:
    """The question and what is said instead of its words."""
    more = F.array_compact(F.array(*[F.when(F.lower(question).rlike(rf"\b{re.escape(k)}"), F.lit(v)) for k, v in SYNONYMS.items()]))
    return F.concat(question, F.lit(" "), F.array_join(more, " "))


def sentences(hits: DataFrame) -> DataFrame:
    """(question_id, n, rank, sentence, score): the three best sentences of hits(question_id, question, rank, text).

    Sentences count that share a word of weight with the question and have more than 30 characters; of those with
    the same 50 first characters the best. Ties go to the better hit, then to the earlier sentence.
    """
    q = F.col("question")
    # dealt by question once for all that follows; a question's words are taken below the sentences, a sentence's words where it is made
    rows = hits.repartition("question_id").select("question_id", "rank", "text", T.tokens(q).alias("asked"), T.tokens(expanded(q)).alias("wide"), F.lower(q).rlike(r"\bmean|defin").alias("meaning"))
    said = F.filter(T.sentences(F.regexp_replace("text", "\n", " ")), lambda s: F.length(s) > 30)
    rows = rows.select("question_id", "rank", "asked", "wide", "meaning", F.posexplode(F.transform(said, lambda s: F.struct(s.alias("sentence"), T.tokens(s).alias("words")))).alias("pos", "s")).select("*", "s.*")
    own = F.size(F.array_intersect("asked", "words"))
    score = 2 * own + F.size(F.array_intersect("wide", "words")) - 0.3 * F.col("rank") + F.when(F.col("sentence").rlike(r"\d"), 0.5).otherwise(0.0)
    score = score - F.when(F.contains(F.lower("sentence"), F.lit(" means ")) & ~F.col("meaning"), 2.0).otherwise(0.0)
    rows = rows.where(own > 0).select("question_id", "rank", "pos", "sentence", F.round(score, 6).alias("score"))
    best = [F.col("score").desc(), "rank", "pos"]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("question_id", F.left("sentence", F.lit(50))).orderBy(*best))).where("n = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(*best))).where(F.col("n") <= PICKED)
    return rows.select("question_id", "n", "rank", "sentence", "score")


def missing(hits: DataFrame) -> DataFrame:
    """(question_id, missing): words of the question that neither the hits nor, by a synonym, they hold; sorted."""
    said = hits.groupBy("question_id").agg(F.first("question").alias("question"), F.array_distinct(F.flatten(F.collect_list(T.tokens(F.col("text"))))).alias("said"))
    known = {k: [w for w in re.findall(r"[a-z][a-z\-]+", v) if w not in T.STOP] for k, v in SYNONYMS.items()}
    other = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    gone = F.filter(F.array_except(T.tokens(F.col("question")), F.array(*map(F.lit, GENERIC))), lambda w: (F.length(w) > 2) & ~F.array_contains("said", w) & ~F.coalesce(F.arrays_overlap(F.try_element_at(other, w), "said"), F.lit(False)))
    return said.select("question_id", F.array_sort(gone).alias("missing"))


def answered(hits: DataFrame) -> DataFrame:
    """(question_id, answer, grounded) of hits(question_id, question, rank, text, score)."""
    lines = sentences(hits).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), F.left("sentence", F.lit(350)), F.lit(" [S"), "rank", F.lit("]")).alias("line")))).alias("l"))
    best = hits.groupBy("question_id").agg(F.max("score").alias("best"))
    df = best.join(apart(lines), "question_id", "left").join(apart(missing(hits)), "question_id", "left")
    lack = F.concat(F.lit(NOT_FOUND + " The document does not mention: "), F.array_join("missing", ", "), F.lit(". " + CLOSEST))
    text = F.concat(F.when(F.size("missing") > 0, lack).otherwise(FOUND), F.array_join("l.line", "\n"), F.lit(VERIFY))
    grounded = F.col("best") >= WEAK
    return df.select("question_id", F.when(grounded & F.col("l").isNotNull(), text).otherwise(NOT_FOUND).alias("answer"), grounded.alias("grounded"))


def context(hits: DataFrame) -> DataFrame:
    """(question_id, context, sources) of hits(question_id, rank, citation, text, page_start)."""
    row = F.struct("rank", F.concat(F.lit("[S"), "rank", F.lit("] ("), "citation", F.lit(")\n"), "text").alias("block"), F.struct(F.concat(F.lit("S"), "rank").alias("tag"), "citation", F.col("page_start").alias("page"), F.left("text", F.lit(600)).alias("text")).alias("source"))
    l = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("l"))  # noqa: E741
    return l.select("question_id", F.array_join("l.block", "\n\n").alias("context"), F.col("l.source").alias("sources"))


def flags(answer: Column) -> dict[str, Column]:
    """What an evaluation asks of an answer."""
    return {
        "has_citation": answer.rlike(CITED), "said_not_found": F.contains(F.lower(answer), F.lit(NOT_FOUND.lower())),
        "unsafe_advice": F.replace(answer, F.lit(ALLOWED), F.lit("")).rlike(UNSAFE),
    }


def rates(rows: DataFrame) -> DataFrame:
    """One row: citations and unsafe advice of all; recall, refusals and false refusals by whether an answer is there."""
    share = lambda c, when=None: F.avg(F.when(when, F.col(c).cast("double")) if when is not None else F.col(c).cast("double"))
    yes, no = F.col("answerable") == "yes", F.col("answerable") == "no"
    return rows.agg(share("has_citation").alias("citation_rate"), share("unsafe_advice").alias("unsafe_rate"), share("keyword_recall", yes).alias("recall"), share("said_not_found", no).alias("refused"), share("said_not_found", yes).alias("refused_falsely"))
