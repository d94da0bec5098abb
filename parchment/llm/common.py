"""What the operators share: tables, the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many 64-bit keys are broadcast (16 MB); larger sets are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in a local session where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all of the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parchment-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session held to 1,000 rows where nobody has set another size: texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return df


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept in the shared folder: lost executors lose nothing."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def bundled(docs: DataFrame, **more) -> DataFrame:
    """(row, and columns of more): docs' own columns together in row, where no other name can clash with theirs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), *[c.alias(n) for n, c in more.items()])


def unbundled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str], bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df whose key is in keys; keys is broadcast only if a count shows it small."""
    if keys.limit(bound + 1).count() <= bound:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def fold(column: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo parts; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def with_score(docs: DataFrame, score, name: str, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with a double column: score(pyarrow column of texts) gives a numpy array.

    The columns that pass are not touched, whatever they are called.
    """
    import pyarrow as pa

    keep = keep or docs.columns
    names = [f"c{i}" for i in range(len(keep))]
    with_text = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("text").alias("text"))
    fields = [f for f in with_text.schema.fields if f.name != "text"]

    def run(batches):
        for b in batches:
            out = pa.array(score(b.column("text")), pa.float64())
            b = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = small_batches(with_text).mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("score").alias(name))


def by_hash(df: DataFrame, keys: list[str], want: int, rows: int):
    """An Arrow table of want of df's rows (all, if fewer), those of the least hashes of keys; rows: how many df has.

    A threshold on the hash, from the counts, keeps all but about want rows where they are; no partition sends more than its share.
    """
    import pyarrow as pa

    span = 1 << 50
    h = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(span))
    share = 1.0 if rows <= want else (want + 6 * want**0.5 + 20) / rows
    got = df.withColumn("by_hash", h).where(F.col("by_hash") < F.lit(int(min(1.0, share) * span)) + 1).toArrow()
    got = got.sort_by([("by_hash", "ascending"), *[(k, "ascending") for k in keys]]).slice(0, want).drop_columns(["by_hash"])
    return got if isinstance(got, pa.Table) else pa.Table.from_batches([got])


def some_ids(df: DataFrame, bound: int):
    """At most bound distinct ids of df, chosen by hash: the same whatever the partitions. Sorted numpy array."""
    import numpy as np

    ids = df.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    return np.unique(by_hash(ids, ["doc_id"], bound, ids.count()).column("doc_id").to_numpy())


def among(ids, column):
    """Which entries of an Arrow column of ids are in the sorted array ids."""
    import numpy as np

    got = column.cast("int64").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.zeros(len(got), bool)
    at = np.minimum(np.searchsorted(ids, got), len(ids) - 1)
    return ids[at] == got


def kth_largest(df: DataFrame, column: str, k: int, few: int = 5_000) -> float:
    """The k-th largest value of a double column, by ever finer histograms; no more than few values are collected."""
    c = F.col(column)
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    bins = 1_000
    while True:
        if lo == hi:
            return lo
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            return lo
        inside = df.where(c.between(lo, hi))
        at = F.least(F.lit(bins - 1), F.floor((c - lo) / step)).cast("int")
        rows = sorted(inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect(), reverse=True)
        for _, n, lo, hi in rows:  # noqa: B007
            if k <= n:
                break
            k -= n
        if n <= few:
            return sorted((r[0] for r in df.where(c.between(lo, hi)).select(c).collect()), reverse=True)[k - 1]


def stored(df: DataFrame) -> DataFrame:
    """As cut(), for larger results: columns in compressed Parquet files in the shared folder."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
