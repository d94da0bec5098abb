"""Approximate nearest neighbours by inner product in balanced posting lists.

Vectors get one more component so that the largest inner product is the smallest distance. Balanced centroids
come from halving a bounded sample again and again; a graph over them, held in memory, is searched best-first
for the centroids near a vector. Every vector is put into the list of its nearest centroid, and vectors near a
boundary into further lists (at most `REPLICAS`) whose distance is within a ratio of the nearest. A query probes
the nearest lists within a wider ratio. Both ratios are fitted on sample vectors that did not make the centroids:
of the pairs of ratios (and numbers of probes) that find the wanted share of true neighbours there, the one that moves the fewest vectors.

Lists and the queries that probe them meet in blocks of bounded size, where exact scores are taken, in two
turns: a query's `FIRST` nearest lists give it a bound, its k-th best score so far, and the other lists then hand
on only what reaches that bound. So what is handed on grows with the number of queries and k, not with the lists.

Equal vectors are one class, searched once; a class keeps its smallest k + 1 ids, more can't be in any result.

Bounds: the sample has at most SAMPLE vectors, so there are at most SAMPLE / PER_LIST / 2 lists; beyond LIST times as many
rows lists grow longer. Every row is indexed.

Defined results: vectors that are null, zero, of another than the commonest length, or hold null or non-finite
components take no part, nor do rows without vec_id; rows equal in id and vector count once; ties go to smaller ids; fewer
candidates than k are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_hash, cut, stored, table

SAMPLE = 1 << 17  # vectors that fit the index
LIST, PER_LIST = 50, 8  # rows for which there is a list, and sample vectors that make its centroid
REST = 1 << 13  # vectors that choose the ratios
ASKED = 600  # of them, and of those that made the centroids, the queries
REPLICAS, FIRST = 4, 4
NEAR = (1.0, 1.02, 1.05, 1.1)
RATIOS = tuple(round(1.01**i, 4) for i in range(1, 60)) + (1e9,)
WANTED = 0.97
BLOCK = 2048


def halved(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Centroids of lists parts of nearly equal size: the largest part is split at the median between two means."""
    import heapq

    r = np.random.default_rng(seed)
    heap = [(-len(x), 0, np.arange(len(x)))]
    n = 0
    while len(heap) < lists and -heap[0][0] >= 2:
        _, _, at = heapq.heappop(heap)
        y = x[at]
        a, b = y[r.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = ((y - (a + b) / 2) @ (a - b)) > 0
            if side.all() or not side.any():
                break
            a, b = y[side].mean(0), y[~side].mean(0)
        order = np.argsort((y @ (a - b)), kind="stable")
        for part in (order[: len(y) // 2], order[len(y) // 2 :]):
            n += 1
            heapq.heappush(heap, (-len(part), n, at[part]))
    return np.stack([x[at].mean(0) for _, _, at in sorted(heap, key=lambda p: p[1])])


@dataclass
class Graph:
    """Centroids and the links of each to near ones, for best-first search of many vectors at once."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of(points: np.ndarray, degree: int = 16, seed: int = 4) -> Graph:
        n, degree = len(points), min(degree, len(points) - 1)
        norms = (points**2).sum(1)
        links = np.zeros((n, degree + 4), np.int32)
        r = np.random.default_rng(seed)
        for i in range(0, n, 512):
            d = norms[None] - 2 * points[i : i + 512] @ points.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links[i : i + 512, :degree] = np.argpartition(d, degree - 1, 1)[:, :degree] if degree else 0
        links[:, degree:] = r.integers(0, n, (n, 4))  # far links, so that no part is out of reach
        links.sort(1)
        links[:, 1:][links[:, 1:] == links[:, :-1]] = -1
        links = np.where(links < 0, np.arange(n)[:, None], links)  # instead of a link twice, one to itself, which is always seen
        return Graph(points, links, r.choice(n, min(n, 24), replace=False).astype(np.int32))

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, centroids) of about the k nearest of each row of x, nearest first."""
        n, m = len(self.points), len(x)
        k = min(k, n)
        width = min(n, max(k + 8, 24))
        norms, own = (self.points**2).sum(1), (x**2).sum(1)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n), bool)
        ids = np.broadcast_to(self.entries[:width], (m, min(width, len(self.entries)))).copy()
        seen[rows, ids] = True
        d = norms[ids] - 2 * np.einsum("mij,mj->mi", self.points[ids], x)
        done = np.zeros(ids.shape, bool)
        while True:
            todo = np.where(done, np.inf, d)
            best = todo.argmin(1)
            live = np.isfinite(todo[np.arange(m), best])
            if not live.any():
                break
            done[np.arange(m), best] = True
            new = self.links[ids[np.arange(m), best]]
            fresh = ~seen[rows, new] & live[:, None]
            seen[rows, new] = seen[rows, new] | live[:, None]
            nd = np.where(fresh, norms[new] - 2 * np.einsum("mij,mj->mi", self.points[new], x), np.inf)
            ids, d, done = np.hstack([ids, new]), np.hstack([d, nd]), np.hstack([done, ~fresh])
            if ids.shape[1] > width:
                top = np.argpartition(d, width - 1, 1)[:, :width]
                ids, d, done = ids[rows, top], d[rows, top], done[rows, top]
        order = np.argsort(d, 1, kind="stable")[:, :k]
        return np.sqrt(np.maximum(d[rows, order] + own[:, None], 0)), ids[rows, order]


@dataclass
class Index:
    graph: Graph
    norm: float  # the largest squared norm
    probes: int
    near: float
    ratio: float

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm - (x**2).sum(1), 0))
        return np.hstack([x, more[:, None]])

    def distances(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """(distance as a multiple of the nearest one, list) of the lists near each row of x, nearest first."""
        x = self.lifted(x, query)
        found = [self.graph.search(x[i : i + 512], self.probes if query else REPLICAS) for i in range(0, max(1, len(x)), 512)]
        d, at = (np.concatenate(p) for p in zip(*found))
        return d / np.maximum(d[:, :1], 1e-12), at

    def lists(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, number of the list among the row's): where rows of x are kept, or what they probe."""
        d, at = self.distances(x, query)
        near = d <= (self.ratio if query else self.near)
        near &= np.isfinite(d)
        near[:, : 2 if query else 1] = True
        row, col = np.nonzero(near)
        return row, at[row, col], col


def fit(sample: np.ndarray, norm: float, rows: int, k: int, asked: float = 0.05) -> Index:
    """The index for rows vectors, from a sample of them in random order; asked: queries for each row."""
    lists = int(np.clip(rows // LIST, 1, max(1, len(sample) // PER_LIST // 2)))
    plain = Index(Graph(sample[:0], sample[:0], sample[:0]), norm, lists, 1.0, 1e9)
    n = min(len(sample), lists * PER_LIST) if lists > 8 else len(sample)
    index = Index(Graph.of(halved(plain.lifted(sample[:n], False), lists)), norm, lists, 1.0, 1e9)
    if lists <= 8:
        return index
    rest = sample[n : n + REST]  # no centroid knows these
    # among all rows there are also those that made the centroids, near which they lie, so that ratios of distances are
    # large for them; as large a share of them here, among the queries too
    made = sample[: min(n, int(len(rest) * n / max(1, rows - n)))]
    pool = np.concatenate([rest, made])
    few = min(len(made), round(ASKED * n / max(1, rows)))
    own_place = np.concatenate([np.arange(min(ASKED - few, len(rest))), len(rest) + np.arange(few)])
    q = pool[own_place]
    scores = q @ pool.T
    scores[np.arange(len(q)), own_place] = -np.inf
    # of the k nearest among all rows, so many are among these
    want = max(1, min(k, len(pool) - 1, -(-k * len(pool) // max(rows, 1))))
    true = np.argpartition(-scores, want - 1, 1)[:, :want]
    own, at = index.distances(pool, False)
    best, cost, most = (lists, NEAR[-1], RATIOS[-1]), np.inf, 64
    while not np.isfinite(cost):
        index.probes = most = min(lists, 2 * most)
        d, order = index.distances(q, True)
        ratio_of, place_of = np.full((len(q), lists), np.inf), np.full((len(q), lists), lists)
        np.put_along_axis(ratio_of, order, d, 1)
        np.put_along_axis(place_of, order, np.arange(order.shape[1])[None], 1)
        rows_ = np.arange(len(q))[:, None, None]
        ratio_of, place_of = ratio_of[rows_, at[true]], place_of[rows_, at[true]]  # of each list that may hold a true neighbour
        for near in NEAR:
            kept = own <= near
            kept[:, 0] = True
            for probes in range(8, most + 1, 8):
                # the ratio at which a query with so many probes reaches some list of each true neighbour
                reach = np.where(kept[true] & (place_of < probes), ratio_of, np.inf).min(2)
                for ratio in RATIOS if np.mean(np.isfinite(reach)) >= WANTED else ():
                    if np.mean(reach <= ratio) >= WANTED:
                        moved = kept.sum() / len(pool) + asked * (d[:, :probes] <= ratio).sum() / len(q)
                        if moved < cost:
                            best, cost = (probes, near, ratio), moved
                        break
        if most == lists:
            break
    return Index(index.graph, norm, *best)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(df: DataFrame, ids: str = "vec_id", vectors: str = "embedding") -> DataFrame:
    """(vec_id, v): those that take part, v as floats where the table has floats, else as doubles."""
    v = F.col("v")
    kind = "array<float>" if df.schema[vectors].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(ids).cast("long").alias("vec_id"), F.col(vectors).cast(kind).alias("v"))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def search(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """The k nearest of vectors(vec_id, v), as valid() gives them, to each of those for which query holds."""
    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.simpleString()
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    groups = stored(few.groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm, rows = groups.agg(F.max(square), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = by_hash(groups.select("c", "v"), ["c"], min(SAMPLE, 2 * PER_LIST * (rows // LIST) + REST), rows)
    sent = spark.sparkContext.broadcast(fit(matrix(sample.column("v")), float(norm), rows, k))
    asked = cut(vectors.where(query).distinct().join(groups.select("v", "c"), "v").select(F.col("vec_id").alias("query_id"), "c"))
    asking = groups.join(asked.select("c").distinct(), "c", "left_semi")

    def dealt(is_query: bool):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    row, lists, number = sent.value.lists(matrix(part.column("v")), is_query)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(number >= FIRST), part.column("c").take(row), part.column("v").take(row)], names=["list", "later", "c", "v"])

        return run

    schema = f"list int, later boolean, c long, v {kind}"
    kept = stored(groups.select("c", "v").mapInArrow(dealt(False), schema).drop("later"))
    asks = stored(asking.select("c", "v").mapInArrow(dealt(True), schema))
    first = stored(_best(_met(kept, asks.where(~F.col("later")).withColumn("bound", F.lit(float("-inf"))), k), k))
    bound = first.groupBy(F.col("q").alias("c")).agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
    later = asks.where("later").join(bound, "c", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    best = _best(first.union(_met(kept, later, k)), k)
    named = best.join(groups.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    found = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1)
    found = named.groupBy(F.col("q").alias("c")).agg(found.alias("found"))  # at most (k + 1)^2 of a query class
    own = asked.join(found, "c").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def _best(met: DataFrame, k: int) -> DataFrame:
    """(q, c, score): of each query class the k + 1 best, each class once."""
    best = met.groupBy("q", "c").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return best.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")


def _met(kept: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(q, c, score): from each block of a list, what of its k + 1 best for a query of asks(list, c, v, bound) reaches the query's bound."""
    # lists beyond a block's size are parted, and so are the queries of one list; every part meets every part
    parts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(parts(kept, "n").join(parts(asks, "m"), "list"))  # a row for each list, of which there are at most SAMPLE / 16
    a = kept.join(sizes, "list").withColumn("i", F.pmod(F.xxhash64("c"), F.col("n"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    b = asks.join(sizes, "list").withColumn("j", F.pmod(F.xxhash64("c"), F.col("m"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = ["list", "i", "j"]
    typed = lambda df, *more: df.select("list", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "c", "v", *more)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q, bound = matrix(left.column("v")), matrix(right.column("v")), right.column("bound").to_numpy()
        ids, names = left.column("c").to_numpy(), right.column("c").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        out = []
        for i in range(0, len(q), 256):
            s = q[i : i + 256] @ x.T
            top = np.argsort(-s, 1, kind="stable")[:, : k + 1]  # ids ascend, so ties go to smaller ones
            best = np.take_along_axis(s, top, 1)
            row, col = np.nonzero(best >= bound[i : i + 256, None])
            out.append((names[i : i + 256][row], ids[top[row, col]], best[row, col]))
        return pa.table(dict(zip(("q", "c", "score"), map(np.concatenate, zip(*out)))))

    return typed(a).groupBy(*key).cogroup(typed(b, "bound").groupBy(*key)).applyInArrow(meet, "q long, c long, score double")


def op6_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(valid(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
