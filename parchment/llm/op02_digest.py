"""Document fingerprints: canonical exact digests, grouped by hash and compared byte by byte; DataFrame functions only.

A text's canonical form is its NFKC form, case-folded, in NFKC again, with runs of white space as one space and
none at the ends. Its fingerprint is 128 bits of xxhash of that form. Texts with equal digests are grouped; in
each group the canonical forms themselves are compared, so that even texts whose digests collide by chance get
different classes and fingerprints. Only digests that occur more than once have their texts moved.

Defined results: a null text is an empty one; likeness of fingerprints is 1 for equal, else 0; documents are in
order of doc_id (a null one first), those of one doc_id by a hash of their text; an empty table gives no rows;
other columns are ignored. Rows of one doc_id are sorted in one task: ids are taken to be nearly unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, keep_keys, stored, table

LEAST = -(2**63)
BLOCK_BITS = 8


def canonical(c: Column) -> Column:
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(c), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column, bits: int = 128) -> Column:
    """32 hexadecimal digits; fewer bits only to test what happens when digests collide."""
    halves = [F.xxhash64(F.lit(i), canon) for i in (1, 2)]
    if bits < 128:
        halves = [F.lit(0), F.pmod(halves[1], F.lit(1 << bits))]
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])


def texts(docs: DataFrame) -> DataFrame:
    """(k, text, t): k is doc_id with a null one as the least number, t orders the rows of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"), text.alias("text"), F.xxhash64(text).alias("t"))


def classes(docs: DataFrame, bits: int = 128) -> tuple[DataFrame, DataFrame]:
    """(by digest, by row): (digest, class_id, copies) of digests that occur more than once and never collide, and

    (k, t, variant, class_id, copies) of the rows whose digests do collide; variant numbers the different texts of a digest.
    """
    rows = texts(docs).withColumn("canon", canonical(F.col("text"))).select("k", "t", "canon").withColumn("digest", digest(F.col("canon"), bits))
    many = cut(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    # bytes are compared here: the canonical form itself is a key, and copies meet before they move
    own = keep_keys(rows, many, ["digest"]).groupBy("digest", "canon").agg(F.min("k").alias("class_id"), F.count("*").alias("copies"))
    own = stored(own)
    own = own.select("digest", "canon", "class_id", "copies", F.count("*").over(Window.partitionBy("digest")).alias("texts"))
    once = cut(own.where("texts = 1").select("digest", "class_id", "copies"))
    split = own.where("texts > 1").withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("class_id", "canon")) - 1)
    split = cut(split.select("digest", "canon", "variant", "class_id", "copies"))
    if not split.limit(1).count():
        return once, split.select(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("t"), "variant", "class_id", "copies")
    apart = keep_keys(rows, split.select("digest").distinct(), ["digest"]).join(split, ["digest", "canon"])
    return once, cut(apart.groupBy("k", "t").agg(*[F.first(c).alias(c) for c in ("variant", "class_id", "copies")]))


def after(ids: DataFrame) -> DataFrame:
    """(b, next): of each distinct number b the next larger one, of the largest the smallest; numbers alone are sorted."""
    one = stored(ids.select("b").distinct().repartitionByRange("b").select("b", F.spark_partition_id().alias("part")))
    # a row for each partition of the sort
    tops = one.groupBy("part").agg(F.min("b").alias("first"))
    first = F.first("first").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), first).alias("beyond"))
    within = one.withColumn("within", F.lead("b").over(Window.partitionBy("part").orderBy("b")))
    return within.join(F.broadcast(tops), "part").select("b", F.coalesce("within", "beyond").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """(k, t, text, digest, next_text, next_digest): every row and the one after it, without sorting all in one place."""
    rows = texts(docs).withColumn("b", F.shiftright("k", BLOCK_BITS))
    heads = rows.groupBy("b").agg(F.min("k").alias("k"))
    blocks = cut(heads)
    first = keep_keys(rows, blocks.select("k"), ["k"]).groupBy("b").agg(F.min_by("text", "t").alias("beyond"))
    # the first text of the next block, for the last row of each
    beyond = first.withColumnRenamed("b", "next").join(after(blocks), "next").select("b", "beyond")
    order = Window.partitionBy("b").orderBy("k", "t")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("digest", digest(canonical(F.col("text"))))
    rows = rows.withColumn("next_digest", F.lead("digest").over(order))
    rows = rows.alias("r").join(beyond.alias("s"), (F.col("r.b") == F.col("s.b")) & F.col("r.next_text").isNull(), "left")
    last = F.col("next_text").isNull()
    return rows.select("k", "t", "text", "digest", F.coalesce("next_text", "beyond").alias("next_text"), F.when(last, digest(canonical(F.col("beyond")))).otherwise(F.col("next_digest")).alias("next_digest"))


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprints(docs: DataFrame) -> DataFrame:
    once, apart = classes(docs)
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("k", "t", n.cast("long").alias("n_chars"), "digest", "next_digest", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "edited_fingerprint": digest(canonical(F.col("edited")))}).drop("edited")
    small = once.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = rows.join(F.broadcast(once) if small else once, "digest", "left")
    out = {"class_id": F.coalesce("class_id", "k"), "copies": F.coalesce("copies", F.lit(1)), "fingerprint": F.col("digest")}
    if apart.limit(1).count():
        rows = rows.join(apart.select("k", "t", "variant", F.col("class_id").alias("c2"), F.col("copies").alias("n2")), ["k", "t"], "left")
        name = F.when(F.col("variant") > 0, F.concat_ws("-", "digest", "variant")).otherwise(F.col("digest"))
        out = {"class_id": F.coalesce("c2", "class_id", "k"), "copies": F.coalesce("n2", "copies", F.lit(1)), "fingerprint": name}
    ids = lambda c: F.when(c != LEAST, c)
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return rows.select(
        ids(F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", out["fingerprint"].alias("fingerprint"), "edited_fingerprint",
        like("digest", "edited_fingerprint").alias("near_edited"), like("digest", "next_digest").alias("near_next"), ids(out["class_id"]).alias("class_id"), out["copies"].alias("copies"),
    )
