"""The corpus pipeline: stages over documents, each by one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each
result to the shared folder as Parquet and reads it for the next. All but the last return docs' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchment.llm import op01_resample, op03_toxicity, op04_packing, op08_minhash, op10_lines
from parchment.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts score alike, repeated rows too; an empty table gives none, without toxic labels all stay."""
    return op03_toxicity.clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resampling towards good text doesn't draw go. Null and empty texts have the logarithm 0 as weight; rows equal to the last drawn key stay; without labels all stay."""
    return op01_resample.resampled(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go, and documents of which nothing is left. Null, empty and blank texts stay; rows equal in doc_id and text are one document; of equal lines the earliest stays."""
    return op10_lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id. Texts without words all stay; of repeated rows one does; one with a null doc_id stays only if its class has no other."""
    return op08_minhash.deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences. A null or empty text is the end token alone; repeated rows are packed as often as they come; an empty table gives no rows."""
    return op04_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express trained models, hashed signatures or tokenizers; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
