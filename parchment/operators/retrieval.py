"""Lexical and vector retrieval over chunks: TF-IDF scores, dense scores, blending, top k per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FEW_QUERIES = 10_000  # vectors of at most so many queries are broadcast
SPARSE, DENSE = 0.45, 0.55
WANTED = 1.15
TOGETHER, ASKED = 20_000, 256  # vectors of a block, queries multiplied at once
LETTERS, PIECE = 16_000_000, 8_192  # characters of a block of texts, texts of it multiplied at once


def term_list(text: Column, stop: list[str]) -> Column:
    """Words of two characters or more without stop words, and pairs of these; a term is 64 bits of its hash, which move and group faster."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(stop)) if stop else words

    def both(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.transform(F.concat(w, pairs), lambda t: F.xxhash64(t))

    # the list of words is bound once, as an element, not taken again for each pair
    return F.flatten(F.transform(F.array(words), both))


def counted_terms(text: Column, stop: list[str]) -> Column:
    """A text's terms, each once with how often it occurs, as array of (term, tf): runs of equal ones in the sorted list."""

    def counted(a: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        with_next = F.transform(F.array(at), lambda s: F.transform(s, lambda i, k: F.struct(F.get(a, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).cast("long").alias("tf"))))
        return F.when(F.size(a) > 0, F.get(with_next, F.lit(0)))

    return F.get(F.transform(F.array(F.array_sort(term_list(text, stop))), counted), F.lit(0))


def _hashed_words(text: Column, stop: list[str]) -> Column:
    """64 bits of the hash of each word of two characters or more that is no stop word, in their order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(stop)) if stop else words, lambda w: F.xxhash64(w))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for each pair of words, mixed as splitmix64 does."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(block: pa.Table, key: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, query ids, terms, row, code, tf) of a block: its distinct terms in order, and a cell for each term of each key, then of each query."""
    block = block.combine_chunks()
    asked = block.column("asked").to_numpy()
    coded = lambda c: pc.dictionary_encode(block.column(c), null_encoding="encode").combine_chunks()
    keys, asks = coded(key), coded("query_id")
    unit = np.where(asked, len(keys.dictionary) + asks.indices.to_numpy(), keys.indices.to_numpy()).astype(np.int64)
    words = block.column("words")
    row = np.repeat(unit, pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    text = np.repeat(np.arange(len(unit)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    w = pc.list_flatten(words).to_numpy().view(np.uint64)
    inside = text[1:] == text[:-1]
    terms, code = np.unique(np.concatenate([w, _paired(w[:-1], w[1:])[inside]]), return_inverse=True)
    row = np.concatenate([row, row[:-1][inside]])
    cell, tf = np.unique(row * max(len(terms), 1) + code, return_counts=True)
    row, code = np.divmod(cell, max(len(terms), 1))
    return keys.dictionary, asks.dictionary, terms, row, code, tf


def lexical_heads(docs: DataFrame, queries: DataFrame, key: str, stop: list[str], k: int = 5) -> DataFrame:
    """(query_id, key, score): from each block of docs(key, text) those that can be among the k best of queries(query_id, text) by TF-IDF.

    1 + ln tf, smoothed idf of all documents, rows of unit length, words and pairs of words; unknown terms don't count.
    A block's distinct terms travel once, cut into parts by their hash; a part adds up what all blocks have of its terms
    and sends each block its frequencies back. The block then has the lengths of its own texts and meets all queries,
    a stated set that a task holds. A term moves once for each block, not for each text, and no pair of query and text does.
    """
    found = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n, blocks = found["n"], max((found["chars"] or 0) // LETTERS, docs.sparkSession.sparkContext.defaultParallelism)
    none = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key, none(queries, "query_id"), "text", F.lit(False).alias("asked"))
    rows = rows.union(queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none(docs, key), "query_id", "text", F.lit(True).alias("asked")))
    # texts are dealt, their words are taken where they come to
    rows = rows.repartition("block").select("block", key, "query_id", "asked", _hashed_words(F.col("text"), stop).alias("words"))
    ends = np.array([(i << 32) // blocks << 32 for i in range(1, blocks)], np.uint64)

    def counted(block: pa.Table) -> pa.Table:
        keys, _, terms, row, code, _ = _cells(block, key)
        df = np.bincount(code[row < len(keys)], minlength=len(terms)).astype(np.int64)
        cut = [0, *np.searchsorted(terms, ends).tolist(), len(terms)]
        sent = [(terms[i:j].tobytes(), df[i:j].tobytes()) for i, j in zip(cut, cut[1:])]
        own = pa.array(np.full(blocks, block.column("block")[0].as_py(), np.int32))
        return pa.table({"part": pa.array(np.arange(blocks, dtype=np.int32)), "block": own, "terms": pa.array([t for t, _ in sent], pa.binary()), "df": pa.array([c for _, c in sent], pa.binary())})

    def added(part: pa.Table) -> pa.Table:
        sent = [np.frombuffer(t.as_buffer(), np.uint64) for t in part.column("terms")]
        _, code = np.unique(np.concatenate(sent), return_inverse=True)
        df = np.bincount(code, np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in part.column("df")])).astype(np.int64)[code]
        cut = np.cumsum([0, *map(len, sent)])
        return pa.table({"block": part.column("block"), "part": part.column("part"), "df": pa.array([df[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())})

    def heads(block: pa.Table, sums: pa.Table) -> pa.Table:
        keys, asks, terms, row, code, tf = _cells(block, key)
        df = np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in sums.sort_by("part").column("df")])
        w = (1 + np.log(tf)) * (np.log((n + 1) / (df + 1)) + 1)[code]
        w[df[code] == 0] = 0  # of queries alone
        norm = np.sqrt(np.bincount(row, w * w, len(keys) + len(asks)))
        w /= np.where(norm > 0, norm, 1)[row]
        place = pc.rank(keys, null_placement="at_start").to_numpy()
        start, out = np.searchsorted(row, np.arange(len(keys) + len(asks) + 1)), []
        put = np.empty(len(terms), np.int64)
        for q in range(0, len(asks), ASKED):
            many = min(ASKED, len(asks) - q)
            own = slice(start[len(keys) + q], start[len(keys) + q + many])
            put[:] = -1
            used = np.unique(code[own][w[own] > 0])
            put[used] = np.arange(len(used))
            weights = np.zeros((len(used), many))
            known = w[own] > 0
            weights[put[code[own][known]], row[own][known] - len(keys) - q] = w[own][known]
            at = put[code[: start[len(keys)]]]
            hit = np.flatnonzero(at >= 0)
            at, have, of = at[hit], w[hit], np.searchsorted(hit, start[: len(keys) + 1])
            for d in range(0, len(keys), PIECE):
                near = np.zeros((min(PIECE, len(keys) - d), many))
                for i in range(len(near)):
                    s, e = of[d + i], of[d + i + 1]
                    if e > s:
                        near[i] = have[s:e] @ weights[at[s:e]]
                # equal ones by key, as they are ranked; three times k, as scores near the middle of two steps may be rounded either way
                step = np.where(near > 0, np.round(near, 6), -1.0)
                last = np.partition(step, -3 * k, 0)[-3 * k] if len(near) > 3 * k else np.full(many, -1.0)
                b, a = np.nonzero((step >= last) & (near > 0))
                order = np.lexsort((place[d + b], -step[b, a], a))
                a, b = a[order], b[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < 3 * k
                a, b = a[first], b[first]
                out.append(pa.table({"query_id": asks.take(pa.array(q + a)), key: keys.take(pa.array(d + b)), "score": near[b, a]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": asks.slice(0, 0), key: keys.slice(0, 0), "score": pa.array([], pa.float64())})

    sums = rows.groupBy("block").applyInArrow(counted, "part int, block int, terms binary, df binary").groupBy("part").applyInArrow(added, "block int, part int, df binary")
    kind = lambda of, c: of.schema[c].dataType.simpleString()
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(heads, f"query_id {kind(queries, 'query_id')}, `{key}` {kind(docs, key)}, score double")


def dense_scores(queries: DataFrame, vectors: DataFrame, key: str, few: int = FEW_QUERIES) -> DataFrame:
    """(query_id, key, dense): inner products of queries(query_id, qv), a stated set, with all vectors(key, v).

    Few queries, by count, go to every task; more are dealt to blocks of the vectors, each block meeting all of them.
    """
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    if queries.limit(few + 1).count() <= few:
        return vectors.crossJoin(F.broadcast(queries)).select("query_id", key, dot.alias("dense"))
    blocks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    dealt = vectors.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(asked, "_block").select("query_id", key, dot.alias("dense"))


def dense_heads(queries: DataFrame, vectors: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(query_id, key, dense, same): from each block of vectors(key, v, label) those that can be among the k best of queries(query_id, qv, ql).

    A block meets all queries in one product of matrices. It decides nothing but which vectors come near the k best, by
    inner products above 0 times WANTED where the labels are the same; dense is the sum in the order of the components.
    """
    v, q = vectors.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)"), queries.where("qv IS NOT NULL AND NOT exists(qv, x -> x IS NULL)")
    blocks = max(v.count() // TOGETHER, v.sparkSession.sparkContext.defaultParallelism)
    dealt = v.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.col(key).cast("long").alias(key), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv"), F.col("ql").cast("string").alias("ql"))
    matrix = lambda c: pc.list_flatten(c).to_numpy().reshape(len(c), -1)

    def heads(own: pa.Table, other: pa.Table) -> pa.Table:
        ids, asks, out = own.column(key).to_numpy(), other.column("query_id").to_numpy(), []
        if len(ids) and len(asks):
            m, qm = matrix(own.column("v")), matrix(other.column("qv"))
            # labels as numbers, -1 and -2 where none is: these are never the same
            names = pc.unique(own.column("label"))
            code = lambda c, none: pc.fill_null(pc.index_in(c, names, skip_nulls=True), none).to_numpy()
            label, wanted = code(own.column("label"), -1), code(other.column("ql"), -2)
            for i in range(0, len(asks), ASKED):
                near = qm[i : i + ASKED] @ m.T * np.where(wanted[i : i + ASKED, None] == label, WANTED, 1.0)
                near[np.isnan(near)] = np.inf
                last = np.partition(near, -k, 1)[:, -k] if len(ids) > k else np.full(len(near), -np.inf)
                a, b = np.nonzero((near >= last[:, None] - 1e-5) & (near > -1e-9))
                dense = np.zeros(len(a))
                for j in range(m.shape[1]):
                    dense += qm[i + a, j] * m[b, j]
                same = wanted[i + a] == label[b]
                # equal ones by key, as they are ranked; three times k, as scores near the middle of two steps may be rounded either way
                order = np.lexsort((ids[b], -np.round(DENSE * near[a, b], 6), a))
                a, b, dense, same = a[order], b[order], dense[order], same[order]
                first = np.searchsorted(a, a)
                put = np.arange(len(a)) - first < 3 * k
                out.append(pa.table({"query_id": asks[i + a[put]], key: ids[b[put]], "dense": dense[put], "same": same[put]}))
        none = pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "dense": pa.array([], pa.float64()), "same": pa.array([], pa.bool_())})
        return pa.concat_tables(out) if out else none

    return dealt.groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(heads, f"query_id long, `{key}` long, dense double, same boolean")


def blended(sparse: DataFrame, dense: DataFrame | None, key: str) -> DataFrame:
    if dense is None:
        return sparse.withColumnRenamed("sparse", "score")
    both = sparse.join(dense, ["query_id", key], "full")
    return both.select("query_id", key, (SPARSE * F.coalesce("sparse", F.lit(0.0)) + DENSE * F.greatest(F.coalesce("dense", F.lit(0.0)), F.lit(0.0))).alias("score"))


def adjusted(scores: DataFrame) -> DataFrame:
    """score(category, asks_meaning, wanted): definitions count less unless asked for, wanted categories more."""
    less = F.when((F.col("category") == "definitions") & ~F.col("asks_meaning"), 0.8).otherwise(1.0)
    more = F.when(F.array_contains("wanted", F.col("category")), 1.15).otherwise(1.0)
    return scores.withColumn("score", F.col("score") * less * F.coalesce(more, F.lit(1.0)))


def top_k(scores: DataFrame, key: str, k: int = 5) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), key)
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
