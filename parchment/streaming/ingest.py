"""Streams of policies and answers: documents kept up to date by doc_id, and the last answers of each session."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

LATEST = 8
BUCKETS = 16


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Documents:
    """A table of documents in versions: `path/v<batch>` for each batch that changed it, the newest with _SUCCESS being the table.

    upsert() puts a batch's rows over those of equal doc_id, the latest by `order`. A batch number that the table has seen
    changes nothing, so a stream that replays it after a failure ends with the same table. The version before is kept for
    readers that hold it; older ones go.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", order: str = "changed"):
        self.spark, self.path, self.key, self.order = spark, path, key, order

    def versions(self) -> list[int]:
        fs, p = _hadoop(self.spark, self.path)
        if not fs.exists(p):
            return []
        done = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("v")]
        join = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getName()[1:]) for x in done if fs.exists(join(x, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        seen = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{seen[-1]}") if seen else None

    def upsert(self, batch: DataFrame, number: int) -> None:
        seen = self.versions()
        if seen and number <= seen[-1]:
            return
        old = self.read()
        rows = batch if old is None else old.unionByName(batch)
        newest = Window.partitionBy(self.key).orderBy(F.col(self.order).desc(), F.xxhash64(*rows.columns))
        rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{self.path}/v{number}")
        fs, _ = _hadoop(self.spark, self.path)
        for v in seen[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


def kept_up(stream: DataFrame, documents: Documents, checkpoint: str) -> StreamingQuery:
    """A query that upserts what a stream brings; it stops when what is there has been read."""
    return stream.writeStream.foreachBatch(documents.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_answers(stream: DataFrame, session: str = "session", at: str = "at", answer: str = "answer", most: int = LATEST) -> DataFrame:
    """(session, answers): after each batch, the last answers of every session that it brought some of, oldest first.

    What is kept of a session is its last `most` (at, answer), in order, whatever order they arrive in.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for f in frames:
            held = sorted(held + [[int(a), str(b)] for a, b in zip(f["at"], f["answer"])])[-most:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"session": [key[0]], "answers": [[b for _, b in held]]})

    rows = stream.select(F.col(session).cast("string").alias("session"), F.col(at).cast("long").alias("at"), F.col(answer).alias("answer"))
    return rows.groupBy("session").applyInPandasWithState(step, "session string, answers array<string>", "held string", "update", GroupStateTimeout.NoTimeout)
