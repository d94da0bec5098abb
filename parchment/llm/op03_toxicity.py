"""Toxicity by non-negative positive-unlabelled learning.

Hashed words and word beginnings that tell confirmed toxic texts from texts without any label in use are chosen
by their counts over all such texts: those of the `MAX_FEATURES` greatest differences of `LEAST_Z` standard errors or
more. A linear model over them is trained on all confirmed toxic and all unlabelled texts: what a text has of the
features is stored, and in each of `ROUNDS` rounds tasks sum gradients over their texts, of which only the sums come
to the driver: those of each partition where these are few, else added up by feature first. The risk is estimated from both: what the unlabelled texts cost as clean ones, less the share of the
toxic among them, whose cost the positives tell; that difference is kept from going below zero. The share (class
prior) comes from the labelled rows.

Labels are learnt only from rows whose crc32 of doc_id, as text, modulo 5 is not 0, and the unlabelled texts
are of those rows too. A score depends on the text alone. Defined results: a null text scores as an empty one;
repeated rows score alike; without toxic labels every score is 0; other columns are ignored or pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bundled, fold, small_batches, stored, table, unbundled, with_score
from .textnp import BYTES, LOWER, MARKS, blocks, mix, words

BUCKETS = 1 << 20
ROUNDS, RATE = 120, 0.1
FEW = 64  # partitions whose sums come straight to the driver
MAX_FEATURES, LEAST_Z = 4096, 4
FOLDS = 5


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, how often), each pair once: words, and the first 4, 5 and 6 bytes of longer ones."""
    w = words(buf, offs, between=MARKS)
    hashes, docs = [mix(w.hash, 21)], [w.doc]
    size = w.end - w.start
    h = np.zeros(len(w.doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(6):
            at = np.minimum(w.start + k, len(buf) - 1)
            h = h * np.uint64(0x9E3779B97F4A7C15) + BYTES[LOWER[buf[at]]]
            if k >= 3:
                longer = size > k
                hashes.append(mix(h[longer], 22 + k))
                docs.append(w.doc[longer])
    key = np.concatenate(docs).astype(np.int64) << 20 | (np.concatenate(hashes) >> np.uint64(44)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key >> 20, (key & (BUCKETS - 1)).astype(np.int32), n


def value(n: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + np.minimum(n, 7))


@dataclass
class Toxicity:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for i, j, buf, offs in blocks(column):
            doc, bucket, n = features(buf, offs)
            out[i:j] += np.bincount(doc, self.weights[bucket] * value(n), j - i)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def marked(docs: DataFrame, toxic: DataFrame) -> DataFrame:
    """(text, p) of docs outside the held-out fold; p: whether it is one of toxic, else null."""
    ids = toxic.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("p", F.lit(True))
    if ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        ids = F.broadcast(ids)
    return docs.where(fold("doc_id", FOLDS) != 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left").select("text", "p")


def counted(texts: DataFrame) -> DataFrame:
    """(bucket, p, u): how many of the toxic and of all texts have it; bucket -1 has the texts."""

    def run(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            is_p = b.column("p").fill_null(False).to_numpy(zero_copy_only=False)
            seen[:, 0] += is_p.sum(), len(is_p)
            for i, j, buf, offs in blocks(b.column("text")):
                doc, bucket, _ = features(buf, offs)
                np.add.at(seen[1], bucket + 1, 1)
                np.add.at(seen[0], bucket[is_p[i:j][doc]] + 1, 1)
        at = np.flatnonzero(seen[1])
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part - 1, pa.int32()), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["bucket", "p", "u"])

    got = small_batches(texts).mapInArrow(run, "bucket int, p long, u long")
    return got.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def telling(texts: DataFrame) -> np.ndarray | None:
    """Buckets, in order, that differ most between the toxic and all texts; None without toxic ones."""
    seen = stored(counted(texts))
    texts = seen.where("bucket = -1").first()
    if not texts or not texts.p:
        return None
    p, u = F.col("p") / texts.p, F.col("u") / texts.u
    mean = (p + u) / 2
    z = F.abs(p - u) / F.sqrt(mean * (1 - mean) * (1 / texts.p + 1 / texts.u) + 1e-12)
    rows = seen.where("bucket >= 0").select("bucket", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "bucket").limit(MAX_FEATURES).collect()
    return np.sort(np.array([r.bucket for r in rows], np.int32))


def sparse(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(p, size, at, n): for a block of texts each, as bytes: whether toxic, how many chosen features, which, and how often."""
    sent = texts.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        place = np.full(BUCKETS, -1, np.int16)
        place[sent.value] = np.arange(len(sent.value))
        for b in batches:
            is_p = b.column("p").fill_null(False).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in blocks(b.column("text")):
                doc, bucket, n = features(buf, offs)
                at = place[bucket]
                use = at >= 0
                cells = is_p[i:j], np.bincount(doc[use], minlength=j - i).astype("<i4"), at[use], np.minimum(n[use], 7).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], names=["p", "size", "at", "n"])

    return small_batches(texts).mapInArrow(run, "p binary, size binary, at binary, n binary")


def block_sums(cells: tuple, w: np.ndarray) -> np.ndarray:
    """2 x (features + 3): over all texts and over toxic ones, the gradient of log(1 + e^f) by weight and bias, its own sum, and the number of texts."""
    is_p, size, at, n = cells
    row, x = np.repeat(np.arange(len(size)), size), value(n.astype(np.int64))
    f = np.bincount(row, w[at] * x, len(size)) + w[-1]
    s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
    out = np.zeros((2, len(w) + 2))
    for k, of in enumerate((np.ones(len(size)), is_p.astype(float))):
        out[k, : len(w) - 1] = np.bincount(at, (s * of)[row] * x, len(w) - 1)
        out[k, len(w) - 1 :] = (s * of).sum(), (np.logaddexp(0, f) * of).sum(), of.sum()
    return out


def summed(rows: DataFrame):
    """A function of weights and bias: block_sums over all rows, and with it the toxic texts' sums of features."""
    spark, parts = rows.sparkSession, rows.rdd.getNumPartitions()

    def spread(batches):
        for b in batches:
            for u, p in zip(*(b.column(c).to_pylist() for c in ("u", "p"))):
                u, p = np.frombuffer(u), np.frombuffer(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u))), pa.array(u), pa.array(p)], names=["i", "u", "p"])

    def sums(w: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(w)

        def run(batches):
            total = np.zeros((2, len(sent.value) + 2))
            for b in batches:
                for cells in zip(*(b.column(c).to_pylist() for c in ("p", "size", "at", "n"))):
                    total += block_sums(tuple(np.frombuffer(c, t) for c, t in zip(cells, (np.bool_, "<i4", np.int16, np.int8))), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=["u", "p"])

        out = np.zeros((2, len(w) + 2))
        if parts <= FEW:
            for u, p in rows.mapInArrow(run, "u binary, p binary").collect():
                out += np.frombuffer(u), np.frombuffer(p)
            return out
        for r in rows.mapInArrow(run, "u binary, p binary").mapInArrow(spread, "i long, u double, p double").groupBy("i").agg(F.sum("u"), F.sum("p")).collect():
            out[:, r[0]] = r[1], r[2]
        return out

    return sums


def train(sums, features: int, prior: float, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias that lessen the non-negative risk; sums as summed() gives them.

    With l(f) = log(1 + e^f) the risk is prior * mean over toxic of l(-f), and the mean over unlabelled of l(f) less
    prior * mean over toxic of l(f), or 0 if that is less; below 0 a step goes the other way.
    """
    w = np.zeros(features + 1)
    # at weights 0, where the gradient of l is half the features
    own = 2 * sums(w)[1, : features + 1]
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        u, p = sums(w)
        gu, gp, g1 = u[:-2] / u[-1], p[:-2] / p[-1], own / p[-1]
        clean = gu - prior * gp
        grad = prior * (gp - g1) + (clean if u[-2] / u[-1] >= prior * p[-2] / p[-1] else -clean)
        grad[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * min(1.0, 2 * (1 - t / (rounds + 1)))
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    learn = labels.where(fold("doc_id", FOLDS) != 0).where(F.col("toxic").isNotNull())
    all_, toxic = learn.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    none = Toxicity(np.zeros(BUCKETS), -745.0)
    if not toxic:
        return none
    texts = marked(docs, learn.where(F.col("toxic") == 1))
    chosen = telling(texts)
    if chosen is None:
        return none
    weights, bias = train(summed(stored(sparse(texts, chosen))), len(chosen), min(0.99, toxic / all_))
    out = np.zeros(BUCKETS)
    out[chosen] = weights
    return Toxicity(out, bias)


def scored(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """Columns keep, and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_score(docs, lambda c: sent.value.scores(c), "score", keep)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their own columns only."""
    rows = scored(bundled(docs, text=F.col("text")), fit(docs, labels), ["row"])
    return unbundled(rows.where(F.col("score") < 0.5), docs.columns)


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
