"""Log-probabilities of texts under a log-bilinear neural model trained by noise-contrastive estimation.

Words are scored in two steps: the class of the next word given the one before by the neural model, then the
word within its class by its count. The most frequent words are classes of their own; others share a class
with the words of the same ending. Counts of words and of pairs of classes are gathered from every training
text; the model is trained on all those pairs, as the expectation of the contrastive objective over noise from
the classes' own frequencies, in plain matrix products, and one more product gives the table of normalised
log-probabilities. The probabilities of all words, one unseen word per class, and the end sum to one.

The frequent words (at most FREQUENT) are sent to every task; all others meet their counts in a join.

Defined results: tokens are runs of bytes other than ASCII white space, A-Z lower-cased, then one end; a null
or empty text is the end alone. Training uses rows whose crc32 of doc_id modulo 7 is not 2 (all others where doc_id is null
train too). Without training rows N, V and counts are 0. Repeated rows count and score as often as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, stored, table
from .textnp import Words, blocks, mix, words

TOP, ENDINGS = 382, 256  # words that are classes, and classes of endings
END, START = TOP + ENDINGS, TOP + ENDINGS + 1
CLASSES = TOP + ENDINGS + 2
FREQUENT = 1 << 18
FOLDS, HELD = 7, 2
FLUSH = 1_000_000
PARTS = "row long, doc_id long, held boolean, n_tokens long, known long, classes double, frequent double, within double, rare array<long>"


def ending(buf: np.ndarray, w: Words) -> np.ndarray:
    """The class, from 0, of a word's last two bytes."""
    last = buf[np.maximum(w.end - 1, 0)].astype(np.uint64)
    before = np.where(w.end - w.start > 1, buf[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (mix(last << np.uint64(8) | before, 31) >> np.uint64(56)).astype(np.int64)


def lowered(buf: np.ndarray) -> np.ndarray:
    from .textnp import LOWER

    return LOWER[buf]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, s, c): hash, ending and count of every training word."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            h, s, c = (np.concatenate(x) for x in zip(*held))
            h, at, inv = np.unique(h, return_index=True, return_inverse=True)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s[at].astype(np.int32)), pa.array(np.bincount(inv, c).astype(np.int64))], names=["h", "s", "c"])

        for b in batches:
            for _, _, buf, offs in blocks(b.column("text")):
                buf = lowered(buf)
                w = words(buf, offs, lower=False)
                h, at, c = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((h, ending(buf, w)[at], c))
                size += len(h)
            if size > FLUSH:
                yield flush()
        if held:
            yield flush()

    rows = small_batches(docs).where(fold("doc_id", FOLDS) != HELD).select("text").mapInArrow(run, "h long, s int, c long")
    return rows.groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """What is known of the training words before the model is: sorted hashes of frequent words and their counts."""

    n: int
    v: int
    docs: int
    hashes: np.ndarray
    counts: np.ndarray
    top: np.ndarray  # of each frequent word its class, or -1
    totals: np.ndarray  # of each ending, the sum of c + 1 over its words, and 1


def gathered(spark: SparkSession, counted: DataFrame, docs: int) -> Counts:
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 4).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counted.groupBy(level).count().collect()), reverse=True)
    least, total = None, 0
    for b, k in sizes:
        total += k
        if total > FREQUENT:
            break
        least = b
    few = counted.where(level >= least) if least is not None else counted.limit(0)
    got = few.toArrow()  # at most FREQUENT rows
    h, s, c = (got.column(x).to_numpy() for x in ("h", "s", "c"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, s, c = h[order], s[order], c[order]
    top = np.full(len(h), -1, np.int32)
    best = np.lexsort((h, -c))[:TOP]
    top[best] = np.arange(len(best))
    totals = np.ones(ENDINGS)
    for r in counted.groupBy("s").agg(F.sum(F.col("c") + 1)).collect():
        totals[r[0]] += r[1]
    np.subtract.at(totals, s[best], c[best] + 1.0)
    return Counts(int(n) + docs, int(v) + (docs > 0), docs, h, c, top, totals)


def lookup(counts: Counts, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place among the frequent words or -1, class or -1) of each word."""
    if not len(counts.hashes) or not len(w.hash):
        return np.full(len(w.hash), -1), np.full(len(w.hash), -1)
    at = np.minimum(np.searchsorted(counts.hashes, w.hash), len(counts.hashes) - 1)
    at = np.where(counts.hashes[at] == w.hash, at, -1)
    return at, np.where(at >= 0, counts.top[at], -1)


def sequence(w: Words, cls: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, class before, class) of each token, ends included."""
    per = np.bincount(w.doc, minlength=docs)
    doc = np.repeat(np.arange(docs), per + 1)
    now = np.full(len(doc), END, np.int64)
    now[np.arange(len(cls)) + w.doc] = cls
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(per + 1) - (per + 1)] = START
    return doc, before, now


def pair_counts(docs: DataFrame, counts: Counts) -> np.ndarray:
    """How often each class follows each in all training texts."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        got = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for i, j, buf, offs in blocks(b.column("text")):
                buf = lowered(buf)
                w = words(buf, offs, lower=False)
                _, cls = lookup(sent.value, w)
                _, before, now = sequence(w, np.where(cls >= 0, cls, TOP + ending(buf, w)), j - i)
                got += np.bincount(before * CLASSES + now, minlength=len(got))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["pair", "n"])

    rows = small_batches(docs).where(fold("doc_id", FOLDS) != HELD).select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES^2 rows
    out = np.zeros(CLASSES * CLASSES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


def train(pairs: np.ndarray, size: int = 24, noise: int = 20, rounds: int = 300, prior: float = 50.0, seed: int = 5) -> np.ndarray:
    """log10 P(class | class before), normalised: rows are contexts.

    prior: so many tokens after each context are taken to be drawn from the classes' own frequencies.
    """
    unigram = pairs.sum(0) + 1
    unigram[START] = 1e-12
    unigram /= unigram.sum()
    pairs = pairs + prior * unigram
    total = pairs.sum()
    context = pairs.sum(1) / total
    seen = pairs / total
    r = np.random.default_rng(seed)
    # word vectors, target vectors, the position's weights and biases
    params = [r.normal(0, 0.05, (CLASSES, size)), r.normal(0, 0.05, (CLASSES, size)), np.ones(size), np.log(unigram)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    shift = np.log(noise * unigram)
    fakes = noise * context[:, None] * unigram[None, :]
    for t in range(1, rounds + 1):
        words_, targets, weights, bias = params
        mixed = words_ * weights
        delta = mixed @ targets.T + bias - shift
        p = 1 / (1 + np.exp(-np.clip(delta, -60, 60)))
        g = fakes * p - seen * (1 - p)  # of the negative objective, by score
        d = g @ targets
        grads = [d * weights, g.T @ mixed, (d * words_).sum(0), g.sum(0)]
        rate = 0.05 * min(1, 2 * (1 - t / (rounds + 1)))
        for k, x in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    words_, targets, weights, bias = params
    logits = (words_ * weights) @ targets.T + bias
    logits[:, START] = -np.inf
    top = logits.max(1, keepdims=True)
    return (logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))) / np.log(10)


def parts(docs: DataFrame, counts: Counts, logs: np.ndarray) -> DataFrame:
    """Of each text what can be told without the counts of rarer words, and those words."""
    sent = docs.sparkSession.sparkContext.broadcast((counts, logs.astype(np.float64), np.log10(counts.counts + 1.0), np.log10(counts.totals)))

    def run(batches):
        c, table_, logc, logt = sent.value
        for b in batches:
            for i, j, buf, offs in blocks(b.column("text")):
                n = j - i
                buf = lowered(buf)
                w = words(buf, offs, lower=False)
                at, cls = lookup(c, w)
                end = ending(buf, w)
                doc, before, now = sequence(w, np.where(cls >= 0, cls, TOP + end), n)
                score = np.bincount(doc, table_[before, now], n)
                freq = np.where(at >= 0, logc[at], 0.0) if len(logc) else np.zeros(len(at))
                own = cls < 0
                within = np.bincount(w.doc, own * (freq - logt[end]), n)
                rare = at < 0
                size = np.bincount(w.doc[rare], minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(w.hash[rare].view(np.int64)))
                per = np.bincount(w.doc, minlength=n)
                own_columns = [b.column(x).slice(i, n) for x in ("doc_id", "held")]
                yield pa.RecordBatch.from_arrays(
                    [*own_columns, pa.array(per + 1), pa.array(per - size), *(pa.array(np.asarray(x, float)) for x in (score, np.bincount(w.doc, freq, n), within)), lists],
                    names=["doc_id", "held", "n_tokens", "known", "classes", "frequent", "within", "rare"],
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD).alias("held"), "text")
    return rows.mapInArrow(run, PARTS.removeprefix("row long, "))


def scored(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    counted = stored(word_counts(docs))
    counts = gathered(spark, counted, docs.where(fold("doc_id", FOLDS) != HELD).count())
    logs = train(pair_counts(docs, counts)) if counts.docs else np.full((CLASSES, CLASSES), -np.log10(CLASSES - 1))
    found = stored(parts(docs, counts, logs).withColumn("row", F.monotonically_increasing_id()))  # numbered once: both sides of the join below read it
    # the rarer words, once a text with their number, meet their counts
    rare = found.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    rare = rare.join(counted.select("h", "c"), "h").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("logs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = F.col("known") + zero("more") + F.lit(int(counts.docs > 0))
    base = F.col("frequent") + zero("logs") + F.lit(float(np.log10(counts.docs + 1))) - F.col("n_tokens") * F.lit(float(np.log10(counts.n + counts.v + 1)))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(counts.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("classes") + F.col("within") + zero("logs")).alias("score"),
    )


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
