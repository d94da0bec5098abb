"""Packing by minimum bin slack, planned on the histogram of lengths.

Only the count of pieces of each length (at most `capacity` numbers) reaches the driver. There, per bin, a
bitset holds the sums that the lengths at hand can reach; the fullest one is taken apart into lengths, and
that combination is removed as often as the counts allow. Pieces are then dealt to the planned places by
their rank among those of their length; ranks come from counts per block, so pieces of one length are sorted in
many tasks, and only the blocks' counts (4,096 of a length) in one.

Defined results: a null text packs as an empty one (the end token alone); equal texts and repeated doc_ids are
packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

CAPACITY = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each text; only the first piece of a cut text is shorter than capacity."""

    def run(batches):
        from .bpe import ByteLevel

        enc = _encoder(ByteLevel, path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 200):
                for k, ids in enumerate(enc.encode([t or "" for t in texts[at : at + 200]]), at):
                    ids += tail
                    n = len(ids) // 4
                    start, size = 0, n % capacity or capacity
                    piece = 0
                    while start < n:
                        for out, v in zip(rows, (k, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))):
                            out.append(v)
                        piece, start, size = piece + 1, start + size, capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


_held: dict = {}


def _encoder(kind, path: str):
    """One encoder for each worker process and file."""
    if (kind, path) not in _held:
        _held[kind, path] = kind(path)
    return _held[kind, path]


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """[(length, how many)]: with the longest piece in it, a combination whose sum is the largest that fits."""
    lengths = np.flatnonzero(counts)
    top = int(lengths[-1])
    room = capacity - top
    picks = {top: 1}
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, what could be reached before)
    for length in lengths[::-1].tolist():  # longer ones first, so short ones stay for later bins
        if length > room or reach >> room & 1:
            continue
        left, copies = min(int(counts[length]) - (length == top), room // length), 1
        while left > 0 and not reach >> room & 1:
            c = min(copies, left)
            if (more := (reach | reach << c * length) & mask) != reach:
                steps.append((length, c, reach))
                reach = more
            left, copies = left - c, copies * 2
    goal = reach.bit_length() - 1
    for length, c, was in reversed(steps):
        if not was >> goal & 1:
            picks[length] = picks.get(length, 0) + c
            goal -= c * length
    return sorted(picks.items(), reverse=True)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """[(length, first rank, first sequence, copies in each sequence, offset)], in order of length and rank.

    counts[n] is the number of pieces of length n. Each pattern is used until some length runs short, so the
    number of patterns is a small multiple of capacity, whatever the number of pieces.
    """
    counts = counts.astype(np.int64).copy()
    rank, sequence, out = np.zeros(capacity + 1, np.int64), 0, []
    while counts.any():
        picks = fullest(counts, capacity)
        times = min(int(counts[length]) // c for length, c in picks)
        place = 0
        for length, c in picks:
            out.append((length, int(rank[length]), sequence, c, place))
            rank[length] += times * c
            counts[length] -= times * c
            place += c * length
        sequence += times
    return sorted(out)


def ranked(rows: DataFrame) -> DataFrame:
    """rank: from 0 among the pieces of a length, by way of blocks, so that the pieces of one length spread."""
    block = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(4096))
    rows = rows.withColumn("block", block)
    per = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("length", "block", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return rows.withColumn("own", own).join(per, ["length", "block"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("block", "own", "before")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    got = cut(pieces(docs, path or tokenizer_path(), capacity, end))
    counts = np.zeros(capacity + 1, np.int64)
    for r in got.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    places = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(np.array(places, np.int64).reshape(-1, 5))

    def deal(batches):
        t = sent.value
        key = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            _, first, sequence, copies, place = t[at].T if len(at) else np.zeros((5, 0), np.int64)
            j = rank - first
            b = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence + j // copies), pa.array(place + j % copies * length)], names=[*b.schema.names, "sequence_id", "offset"])

    rows = ranked(got).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(deal, f"{PIECES}, sequence_id long, offset long")


def op4_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
