"""Importance resampling of documents towards a target distribution.

Two generative models over hashed n-grams, one of target texts and one of all texts, give each document an
importance weight, the ratio of its probabilities under both. Adding Gumbel noise to the logarithm of the
weights and keeping the k largest draws k documents without replacement in proportion to their weights.

n-grams: words and pairs of words (a word repeated at once counts as one and the same pair), and word shapes
and their pairs. The target is the labelled good rows, at most `max_labelled` of them; counts of the raw model
cover every document. k is the number of documents whose weight reaches the cut between good and bad labelled
rows that makes the fewest errors by class.

Defined results: null and empty texts have weight 0 (logarithm); rows equal in doc_id get equal noise, and rows
equal to the k-th key are all kept; without labelled good or bad rows every row is kept; other columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, bundled, cut, kth_largest, small_batches, some_ids, table, unbundled, with_score
from .textnp import BASE, blocks, mix, per_text, shape_hash, words

BUCKETS = 1 << 16
MAX_LABELLED = 50_000


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text of each word, buckets of the n-grams that end there)."""
    w = words(buf, offs, lower=False)
    shape = shape_hash(buf, w)
    out = []
    with np.errstate(over="ignore"):
        for k, h in enumerate((w.hash, shape)):
            before = np.zeros_like(h)
            before[1:] = np.where(w.doc[1:] == w.doc[:-1], h[:-1], 0)
            pair = before * np.uint64(BASE) + h
            if k == 0:
                pair = np.where(before == h, np.uint64(1), pair)
            out += [(mix(x, 11 + 2 * k + j) >> np.uint64(48)).astype(np.int32) for j, x in enumerate((h, pair))]
    return w.doc, out


def counts(docs: DataFrame, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket in the documents whose ids are in target, and in all."""
    sent = docs.sparkSession.sparkContext.broadcast(target)

    def run(batches):
        t, r = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            chosen = among(sent.value, b.column("doc_id"))
            for i, j, buf, offs in blocks(b.column("text")):
                doc, grams = features(buf, offs)
                ours = chosen[i:j][doc]
                for g in grams:
                    r += np.bincount(g, minlength=BUCKETS)
                    t += np.bincount(g[ours], minlength=BUCKETS)
        at = np.flatnonzero(r)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t[at]), pa.array(r[at])], names=["bucket", "target", "raw"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket long, target long, raw long")
    got = rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()  # at most BUCKETS rows
    t, r = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x in got:
        t[x[0]], r[x[0]] = x[1], x[2]
    return t, r


@dataclass
class Resampler:
    """logs: log ratio of the target's to the raw probability, by bucket. k rows are kept, those from key cut on."""

    logs: np.ndarray
    seed: int
    k: int = 0
    cut: float = float("-inf")

    def weights(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, buf, offs in blocks(column):
            doc, grams = features(buf, offs)
            for g in grams:
                out[i:j] += per_text(doc, self.logs[g], j - i)
        return out

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """Columns keep, and log_weight."""
        model = docs.sparkSession.sparkContext.broadcast(self)
        return with_score(docs, lambda c: model.value.weights(c), "log_weight", keep)

    def key(self):
        """The sum of log_weight and Gumbel noise that doc_id decides."""
        u = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(self.seed)), F.lit(1 << 50)) + 0.5) / float(1 << 50)
        return F.col("log_weight") - F.log(-F.log(u))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which on rows count as good, with the least sum of both classes' error rates."""
    at = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(np.sort(good), at, "left") / len(good)
    let_in = 1 - np.searchsorted(np.sort(bad), at, "left") / len(bad)
    errors = lost + let_in
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    i = int(best[0])
    return float((at[i] + at[i - 1]) / 2) if i else float(at[0])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17, max_labelled: int = MAX_LABELLED) -> tuple[Resampler, DataFrame]:
    """The model, and (doc_id, log_weight, key) of every row of docs by it."""
    good, bad = (some_ids(labels.where(F.col("quality") == q), max_labelled) for q in (1, 0))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = Resampler(np.zeros(BUCKETS), seed)
    if len(good) and len(bad):
        target, raw = counts(docs, good)
        model.logs = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    scored = cut(model.scored(ids, ["doc_id"]).withColumn("key", model.key()))
    spark = docs.sparkSession
    own = []
    for few in (good, bad):  # bounded: max_labelled ids each
        few = spark.createDataFrame(pa.table({"doc_id": pa.array(few, pa.int64())}))
        own.append(np.array([r[0] for r in scored.join(F.broadcast(few), "doc_id", "left_semi").select("log_weight").collect()]))
    if len(own[0]) and len(own[1]):
        model.k = scored.where(F.col("log_weight") >= best_cut(*own)).count()
        model.cut = kth_largest(scored, "key", model.k) if model.k else float("inf")
    return model, scored


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs that are drawn, with their own columns only."""
    model, _ = fit(docs, labels, seed)
    rows = model.scored(bundled(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")), ["row", "doc_id"])
    return unbundled(rows.where(model.key() >= model.cut), docs.columns)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scored = fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), (F.col("key") >= model.cut).alias("kept"))
