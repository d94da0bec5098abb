"""Results that are kept in the cluster's shared folder, where lost executors lose nothing, and tables of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many short keys are broadcast; larger tables are joined by a shuffle.
FEW = 200_000
#: A key is frequent if it makes this share of the rows, so at most as many are; longer texts are no keys.
OFTEN, SHORT = 10_000, 1_000
#: Rows of texts that make a task's share.
SHARE = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in a local session where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all of the cluster shares")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="parchment-"))
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed now; what is built on them is planned and run without what made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As kept(), for larger results: columns in compressed Parquet files in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle: it has a row or more for each document, and the planner counts a text or list of any length as a few bytes."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """The rows of df dealt by key, computed now: what groups, orders or joins by key from here on needs no shuffle. The number of parts grows with the rows, by their count."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // share))
    # the name keeps a later call, on files that may have changed, from finding these rows
    return nearby(df.where(F.lit(uuid.uuid4().hex) != "").repartition(parts, key))


def nearby(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept on the disks of the tasks that made them; they stay dealt as they are, which kept() forgets. What a lost executor had is computed again."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def once_each(rows: DataFrame, by: list[str], name: str, look: Callable[[Column], Column]) -> DataFrame:
    """rows with a column name, look(the struct of the columns `by`, texts and flags without nulls), which is costly: made once for each frequent key and broadcast, and where they stand for all others."""
    key = F.struct(*by)
    size = sum((F.length(F.col(c).cast("string")) for c in by), F.lit(0))
    counts = nearby(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(size <= SHORT))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    known = kept(counts.where((F.col("_n") > 1) & (F.col("_n") * OFTEN >= n)).select(*by, once(key, look).alias(name), F.lit(True).alias("_known")))
    counts.unpersist()
    joined = rows.join(F.broadcast(known), by, "left")
    return joined.select(*rows.columns, F.when(F.col("_known"), F.col(name)).otherwise(once(key, look)).alias(name))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once, wherever it stands in use."""
    return F.transform(F.array(value), use)[0]


def sized(df: DataFrame, few: int = FEW) -> DataFrame:
    """df, of short rows, broadcast if a count shows it small."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df
