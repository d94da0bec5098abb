"""Shards of equal numbers of rows and of one mixture: proportional stratified interleaving.

Rows are shuffled by a seed within each source (the order of their hashes) and ranked there; a row's fractional
rank is (rank - 1/2) / rows of its source. In the order of fractional ranks every stretch holds the sources in their
shares, so cutting it into `shards` pieces whose counts differ by one at most gives each shard the whole's mixture.
The law is `rows`.

Both orders are sorts by ranges over narrow rows; no source, however large, meets in a task, and neither do equal
rows: a number given to each row once, and stored, decides last.

Equal texts are rows like others: they fall where their hashes say, not together.

Defined results: null and empty texts have 0 bytes of text; a null source is a source of its own, apart from an empty
one; rows are shuffled by sha256 of "<seed>:<doc_id>" (a null doc_id: "<seed>:"), then by text, then as they lie; fewer
rows than shards leave shards empty; an empty table gives no rows; other columns pass, but for shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .ranks import ranked, sized

SHARDS, SEED = 40, 2024
OVERHEAD = 16  # bytes of a document besides its text


def shuffle_key(seed: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 16)


def narrow(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, stratum, key, id) of docs(id, doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", (F.length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), stratum.alias("stratum"), shuffle_key(seed).alias("key"), "id")


def interleaved(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows(stratum, key, text_crc32, size, id and others) with shard and slot; rows are read again, so their ids must be stored."""
    tie = [F.col("key"), F.col("text_crc32"), F.col("size"), F.col("id")]
    placed = ranked(rows, tie, "rank", "stratum")
    per = placed.groupBy("stratum").agg(F.count("*").alias("rows_of"))
    share = (F.col("rank") - 0.5) / F.col("rows_of")
    shared = placed.join(sized(per), "stratum").withColumn("share", share).select(*rows.columns, "share")
    out = ranked(shared, [F.col("share"), *tie], "place")
    total = rows.count()
    shard = F.expr(f"((place - 1) * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # a shard's first place: shard * total / shards, rounded up
    out = out.withColumn("shard", shard).withColumn("slot", F.col("place") - 1 - first)
    return out.withColumn("shard", F.col("shard").cast("int")).select(*rows.columns, "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs, every row with its shard and slot."""
    mine = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = stored(docs.select(mine, F.monotonically_increasing_id().alias("id")))
    inner = kept.select("id", *[F.col("row").getField(c).alias(c) for c in ("doc_id", "text", "source")])
    placed = interleaved(stored(narrow(inner, seed)), shards).select("id", "shard", "slot")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return kept.join(placed, "id").select(*own, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """A folder of Parquet files for each shard, rows in the order of their slots in every file."""
    placed = sharded(docs, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.monotonically_increasing_id().alias("id"))
    placed = interleaved(stored(narrow(docs)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
