"""Importance resampling towards a target, with equal texts weighed once.

A document's weight is the sum, over its features, of the gain of the feature's bucket: the logarithm of the
bucket's share in the target texts over its share in all documents (both with one added), times 1,000 and floored.
Features are runs of one to `longest` words joined by one space; a bucket is the crc32 of the feature's bytes,
modulo `buckets`. Noise that the seed and doc_id decide (Gumbel, times 1,000) is added; the highest scores are drawn.

Documents of equal text are one row from the grouping of whole texts on: its features are taken once and counted as
often as the text occurs, its weight is taken once and joined back by the text's sha256, and only the noise is each
document's own. So a text of many copies costs one row of work, and no group of copies meets in one task: counts of
copies are added before the shuffle, and the join back is by a broadcast of small rows or a join that Spark can split.

Memory: a task holds a text and its words; the driver holds `buckets` sums; gains go to tasks as one constant list.

Defined results: null and empty texts have no words, no features and weight 0; documents of fewer than `least_words`
words are never drawn; equal scores go to the smaller doc_id, a null doc_id last, its noise that of "<seed>:"; rows
equal in doc_id get equal noise; an empty table gives no rows, an empty target gains against it; other columns pass.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bundled, stored, table, unbundled
from .ranks import ranked, sized

BUCKETS, LONGEST, LEAST_WORDS, PER_CENT, SEED = 10_000, 1, 20, 10, 2024

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def bucket_list(words: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to longest of words, repeats included."""
    bucket = lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(words, bucket)
        run = lambda w, i: F.when(i + n <= F.size(words), bucket(F.array_join(F.slice(words, i + 1, n), " ")))
        return F.filter(F.transform(words, run), lambda b: b.isNotNull())  # no run of n starts at the last n - 1 words

    return F.concat(*[runs(n) for n in range(1, longest + 1)])


def gains(target: dict[int, int], raw: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """By bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), in doubles."""
    total, all_target = float(sum(raw.values())), float(sum(target.values()))
    ratio = lambda b: (target.get(b, 0) + 1.0) * (total + buckets) / ((raw.get(b, 0) + 1.0) * (all_target + buckets))
    return [floor(1000 * log(ratio(b))) for b in range(buckets)]


def bucket_sums(texts: DataFrame) -> dict[int, int]:
    """Features by bucket, of texts(found, copies): a row for each bucket comes to the driver."""
    each = texts.select(F.explode("found").alias("bucket"), "copies")
    return dict(each.groupBy("bucket").agg(F.sum("copies").alias("n")).collect())


def distinct_texts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(digest, copies, n_words, found): each text once, with the buckets of its features; stored, so taken once."""
    once = docs.groupBy(F.coalesce(F.col("text"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    worded = once.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "copies", word_list(F.col("text")).alias("words"))
    return stored(worded.select("digest", "copies", F.size("words").cast("long").alias("n_words"), bucket_list(F.col("words"), longest, buckets).alias("found")))


def noise(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, target: DataFrame, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text and others) as (row, doc_id, n_words, n_features, weight, score)."""
    texts = distinct_texts(docs.select("text"), longest, buckets)
    aims = target.select(bucket_list(word_list(F.col("text")), longest, buckets).alias("found"), F.lit(1).cast("long").alias("copies"))
    gain = gains(bucket_sums(aims), bucket_sums(texts), buckets)
    listed = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one constant
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + F.get(listed, b))
    by_text = texts.select("digest", "n_words", F.size("found").cast("long").alias("n_features"), weight.alias("weight"))
    own = bundled(docs, doc_id=F.col("doc_id"), digest=F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    back = own.join(sized(by_text), "digest").drop("digest")
    return back.withColumn("score", F.col("weight") + noise(seed))


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """scored with rank: 1, 2, 3... of the drawn rows, null of the others."""
    scored = stored(scored)
    may = F.col("n_words") >= least_words
    many = scored.where(may).count() * per_cent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = ranked(scored.where(may), order, "rank").withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return placed.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs that are drawn, their own columns only."""
    got = drawn(weighed(docs, target, seed, longest, buckets), least_words, per_cent)
    return unbundled(got.where(F.col("rank").isNotNull()), docs.columns)


def op13_collapsed_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # only columns of numbers go on from the texts
    scored = weighed(docs, table(spark, sf_dir, "benchmark")).drop("row")
    return drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")
