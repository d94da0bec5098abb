"""Phrases of two to four words, mined from word-id suffix arrays.

Every shard (a run of a partition's texts) gives its words ids and sorts its suffixes by prefix doubling: ranks by
one word, then two, then four. Neighbours in that order share a longest common prefix; an interval of the suffix
array within which n words are shared is one n-gram, its length the n-gram's count in the shard. Counts are added
over shards by key. A phrase of n words occurs at least `least` times only if all its runs of n-1 words do, so:

1. words and pairs are counted by a 64-bit key;
2. runs of three and four words are counted by key where all their pairs are frequent;
3. what is frequent by key is counted once more by its text, which settles keys that two phrases share.

Frequent keys go to the tasks as a bit map, `BITS` at most (32 MB): if it fills, more goes through the shuffle, but no
phrase is lost or gained. A shard's arrays are bounded by SHARD bytes or by its longest text.

Then, on rows of phrases: the parts' counts are joined to every cut, scores are divided exactly (decimals),
phrases inside a longer one are dropped, and each language's first rows are ranked by one sort by ranges.

Defined results: null texts are empty, a null language is `und`; a language without phrases gives no rows; repeated
rows count as often as they come; equal scores and counts go by the phrase's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, stored, table
from .ranks import ranked, sized
from .textnp import BASE, LOWER, buffers, mix, words

LEAST, LONGEST, FIRST = 30, 4, 2_000
SHARD = 1 << 21  # bytes of text in a suffix array; its arrays take some 50 times as much
BITS = 1 << 28

ENDS = np.zeros(256, bool)  # bytes that end a piece
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True


def slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of the bytes from start to end."""
    size = end - start
    offs = np.append(0, np.cumsum(size))
    data = buf[np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data))


def exact_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of words, equal for equal words: by hash, or by the words themselves should two share a hash."""
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size, one = end - start, first[ids]
    same = bool((size == size[one]).all())
    if same:
        at = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        same = bool((buf[step + np.repeat(start - at, size)] == buf[step + np.repeat(start[one] - at, size)]).all())
    return ids if same else np.asarray(slices(buf, start, end).dictionary_encode().indices)


class Shard(NamedTuple):
    """Words of one shard in order. buf: the words' bytes, a space after each; key: hash of word and language."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray  # id of (language, word), from 1
    key: np.ndarray
    lang: np.ndarray  # index among langs
    langs: list[str]
    left: np.ndarray  # words from here to the end of the piece

    def grams(self, at: np.ndarray, n: int) -> pa.Array:
        return slices(self.buf, self.start[at], self.end[at + n - 1])

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(BASE) + self.key[at + k]
        return mix(h, 60 + n)


def shard(texts: pa.Array, langs: pa.Array) -> Shard:
    buf, offs = buffers(texts)
    low = LOWER[buf]
    w = words(low, offs, False, BETWEEN)
    names = langs.fill_null("und").dictionary_encode()
    of = np.asarray(names.indices)[w.doc].astype(np.int64)
    known = names.dictionary.to_pylist()
    n = len(w.doc)
    size = w.end - w.start + 1
    end = np.cumsum(size)
    spaced = np.full(int(end[-1]) if n else 0, 32, np.uint8)
    step = np.arange(len(spaced)) - np.repeat(end - size, size)
    inside = step < np.repeat(size - 1, size)
    spaced[inside] = low[(step + np.repeat(w.start, size))[inside]]
    ids = exact_ids(spaced, end - size, end - 1, w.hash)
    _, rank = np.unique(ids * max(1, len(known)) + of, return_inverse=True)
    language = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in known], np.uint64)
    with np.errstate(over="ignore"):
        key = mix(w.hash + language[of] if n else w.hash, 59)
    piece = np.append(0, np.cumsum(ENDS[buf]))[w.start] if n else np.zeros(0, np.int64)
    last = np.ones(n, bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (w.doc[1:] != w.doc[:-1])
    stop = np.flatnonzero(last)
    left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1
    return Shard(spaced, end - size, end - 1, rank + 1, key, of, known, left)


def suffix_array(rank: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first longest words, how many of these each shares with the one before it).

    Prefix doubling: a rank by d words and the rank by d words d places on give the rank by 2d; what lies beyond a
    piece's end ranks as 0.
    """
    n, d, word = len(rank), 1, rank
    while d < longest:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - d)] = np.where(left[: max(0, n - d)] > d, rank[d:], 0)
        _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        rank, d = rank + 1, 2 * d
    order = np.argsort(rank, kind="stable")
    shared, alike = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    now, ago = order[1:], order[:-1]
    for k in range(longest):
        alike &= (left[now] > k) & (left[ago] > k)
        alike &= word[np.minimum(now + k, n - 1)] == word[np.minimum(ago + k, n - 1)]
        shared[1:] += alike
    return order, shared


def intervals(s: Shard, least: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each n-gram, its count) for n from least to longest: the intervals within which suffixes share n words."""
    if len(s.rank):
        order, shared = suffix_array(s.rank, s.left, longest)
        for n in range(least, longest + 1):
            first = np.flatnonzero(shared < n)
            count = np.diff(np.append(first, len(order)))
            whole = s.left[order[first]] >= n
            yield n, order[first][whole], count[whole]


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[Shard]:
    """Runs of the texts of batches(text, lang) of about size bytes, or of one longer text."""
    held, bytes_held = [], 0
    for batch in batches:
        texts, langs = (batch.column(c).cast(pa.large_string()) for c in ("text", "lang"))
        _, offs = buffers(texts)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + size - bytes_held, "right")) - 1)
            held.append((texts.slice(i, j - i), langs.slice(i, j - i)))
            bytes_held += int(offs[j] - offs[i])
            i = j
            if bytes_held >= size // 2:
                yield shard(*(pa.concat_arrays(x) for x in zip(*held)))
                held, bytes_held = [], 0
    if held:
        yield shard(*(pa.concat_arrays(x) for x in zip(*held)))


class Keys:
    """Keys as a bit map: none is missed; another key is taken for one of them as rarely as bits are set."""

    def __init__(self, keys: DataFrame, most: int = BITS):
        want = 16 * keys.count()
        self.bits = min(most, max(1 << 16, 1 << (want - 1).bit_length() if want else 0))
        bit = F.col("key").bitwiseAND(F.lit(self.bits - 1))
        rows = keys.select(F.shiftrightunsigned(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast(key & {63} as int))").alias("bit"))
        rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows of 16 bytes
        self.map = np.zeros(self.bits >> 6, np.uint64)
        self.map[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.bits - 1)
        return (self.map[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def counted(docs: DataFrame, least: int, longest: int, frequent: Keys | None = None) -> DataFrame:
    """(key, n) of the runs of least to longest words, by shard; only those all of whose pairs are in frequent."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for s in shards(batches):
            for n, at, count in intervals(s, least, longest):
                if sent.value is not None:
                    for k in range(n - 1):
                        ok = sent.value.has(s.keys(at + k, 2))
                        at, count = at[ok], count[ok]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys(at, n).view(np.int64)), pa.array(count)], names=["key", "n"])

    return small_batches(docs).mapInArrow(run, "key long, n long")


def spelled(docs: DataFrame, longest: int, frequent: Keys) -> DataFrame:
    """(lang, phrase, words, n) by shard of what is in frequent; and a row without phrase, words 0, for all words of a language."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(s: Shard, lang: np.ndarray, phrase: pa.Array, n: int, count: np.ndarray) -> pa.RecordBatch:
        named = pa.array(s.langs, pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([named, phrase.cast(pa.string()), pa.array(np.full(len(count), n, np.int32)), pa.array(count)], names=["lang", "phrase", "words", "n"])

    def run(batches):
        for s in shards(batches):
            total = np.bincount(s.lang, minlength=len(s.langs))
            own = np.flatnonzero(total)
            yield rows(s, own, pa.nulls(len(own), pa.string()), 0, total[own])
            for n, at, count in intervals(s, 1, longest):
                ok = sent.value.has(s.keys(at, n))
                yield rows(s, s.lang[at[ok]], s.grams(at[ok], n), n, count[ok])

    return small_batches(docs).mapInArrow(run, "lang string, phrase string, words int, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most_bits: int = BITS) -> DataFrame:
    """(lang, phrase, words, n): each language's runs of up to longest words that occur least times or more, with exact
    counts, and all its words (phrase null, words 0). docs(text, lang)."""
    docs = docs.select("text", "lang")

    def keys(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))

    short = keys(counted(docs, 1, min(2, longest)))
    found = short
    if longest > 2:
        found = short.union(keys(counted(docs, 3, longest, Keys(short, most_bits))))
    rows = spelled(docs, longest, Keys(found, most_bits)).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return stored(rows.where((F.col("n") >= least) | (F.col("words") == 0)))


def part(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, scale: int = 2_000_000, inside: int = 80, most_bits: int = BITS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): candidates that no longer one holds in inside % of their places, by their weakest cut."""
    known = frequent_phrases(docs, least, longest, most_bits)
    own = known.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", F.split("phrase", " ", -1).alias("w"))
    one, k = F.lit(1), F.col("k")
    cuts = own.withColumn("k", F.explode(F.sequence(one, F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.col("w"), one, k).alias("first"), part(F.col("w"), k + 1, F.col("words") - k).alias("rest"))
    parts = known.where(F.col("words").between(1, longest - 1))
    side = lambda name, n: sized(parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n)))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    # decimals: the product may pass 64 bits; the quotient, at most scale / 2, doesn't
    score = F.expr(f"(cast(a as decimal(19, 0)) * cast({scale} as decimal(10, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    # the runs of two words or more inside each longer candidate, with that one's count
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(one, F.col("words") - size + 1), lambda i: part(F.col("w"), i, size))))
    longer = own.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("b"))
    stays = F.col("b").isNull() | (F.col("b").cast("decimal(19, 0)") * 100 < F.col("a").cast("decimal(19, 0)") * inside)
    best = best.join(longer, ["lang", "phrase"], "left").where(stays)
    totals = known.where("words = 0").select("lang", F.col("n").alias("all_words"))
    return best.join(sized(totals), "lang").select("lang", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


def op11_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranked(collocations(table(spark, sf_dir, "documents")), [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "rank", "lang")
    return got.where(F.col("rank") <= FIRST).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
