"""Near-duplicate documents by DartMinHash signatures, joined on bands.

Elements of a document are its runs of five words (of all words, if it has fewer); an element's weight is how often
it occurs. Darts fall on an element's weight and rank axes as a unit-rate Poisson process seeded by the element
alone, so equal elements have equal darts. A document keeps the darts below its weight and a rank bound that gives
it some `darts` of them, and for each coordinate of the signature the one of lowest rank; documents agree in a
coordinate with the probability of their weighted Jaccard similarity, the sum of the lesser weights over that of
the greater ones. Bands of coordinates are joined by hash.

Equal texts (by words) are first folded into one representative. In a bucket every text meets the bucket's
most central one, which shares the most buckets with others, so groups give stars, not all pairs; met pairs are verified on the exact
weights (0.8 or more). What the stars leave apart although it shares a bucket is then compared too, the
texts of a bucket's smaller components with all of the others: a pair goes on to the exact verification if the
total weights and the bits in which the texts' parity sketches differ (each stands for an occurrence that only one
of them has) allow the similarity, so no link is lost by that; the bands themselves miss 8 in 100,000 pairs at
exactly 0.8, and far fewer above. Components take labels along links.

A text is named by 64 bits of its words' hash; where two texts of other words share them, which other 64 bits tell,
both get other names.

Defined results: case and white space don't matter; null, empty and blank texts have no elements and are alone
in their class, each row by itself; repeated rows are copies; a class id is the smallest doc_id in the class;
rows with a null doc_id are classed with their texts, and only a class of such rows alone has a null id. Other columns pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, among, cut, small_batches, stored, table
from .textnp import Words, blocks, mix, shingles, words

BANDS, ROWS = 40, 7
SIZE, LEAST = 5, 0.8
DARTS = 10  # a coordinate of the signature
ODD = 4096  # bits of the parity sketch
FOLDED = 16  # words that the sketch is folded to for a first look


def elements(w: Words, docs: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, how often), each pair once."""
    doc, h = shingles(w, docs, size)
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int, darts: int = DARTS) -> np.ndarray:
    """docs x k signatures of weighted sets; rows of texts without elements are 0.

    Strip s of an element spans weights [s, s + 1). Its darts have ranks that are sums of exponential gaps, a
    uniform place in the strip, and a coordinate, all hashed from (element, strip, number of the dart). A dart
    is known by its rank, whose bits (as those of any positive double) are in the order of the ranks.
    """
    total = np.bincount(doc, weight, docs)
    bound = np.where(total > 0, darts * k / np.maximum(total, 1e-300), 0)
    out = np.full((docs, k), np.iinfo(np.int64).max)
    todo = total > 0
    while todo.any():
        out[todo] = np.iinfo(np.int64).max
        use = todo[doc]
        strips = np.ceil(weight[use]).astype(np.int64)
        row = np.repeat(np.flatnonzero(use), strips)
        strip = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
        key = mix(element[row] + strip.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 41)
        d, w = doc[row], weight[row] - strip
        rank, most = np.zeros(len(row)), bound[d]
        whole = bool((w >= 1).all())
        number = 0
        while len(key):
            number += 1
            u = mix(key, 100 + 2 * number)
            rank -= np.log1p((u >> np.uint64(11)).astype(np.float64) * -(2.0**-53))
            ok = np.flatnonzero(rank < most)
            key, rank, d, most = key[ok], rank[ok], d[ok], most[ok]
            other = mix(key, 101 + 2 * number)
            cell = d * k + ((other >> np.uint64(24)) % np.uint64(k)).astype(np.int64)
            dart = np.maximum(rank, 5e-324).view(np.int64)
            if not whole:
                w = w[ok]
                inside = (other & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 < w
                cell, dart = cell[inside], dart[inside]
            np.minimum.at(out.reshape(-1), cell, dart)
        todo &= (out == np.iinfo(np.int64).max).any(1)
        bound = np.where(todo, 2 * bound, bound)
    return np.where((total > 0)[:, None], mix(out.view(np.uint64), 43), np.uint64(0))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """docs x bands hashes; each differs by band."""
    h = np.zeros((len(signatures), bands), np.uint64)
    parts = signatures.reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        for i in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i], 45)
        return mix(h + np.arange(bands, dtype=np.uint64), 46)


def digest(w: Words, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's words in order, and whether it has any."""
    n = np.bincount(w.doc, minlength=docs)
    end = np.cumsum(n)
    place = (np.arange(len(w.doc)) - np.repeat(end - n, n)).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for seed in (51, 52):
            sums = np.append(np.uint64(0), np.cumsum(mix(w.hash + mix(place, seed), seed + 2), dtype=np.uint64))
            out.append(mix(sums[end] - sums[end - n], seed).view(np.int64))
    return out[0], out[1], n > 0


def parity(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int = ODD) -> np.ndarray:
    """docs x size bits, as words: whether an odd number of a text's occurrences of elements falls on the bit."""
    number = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        at = (mix(np.repeat(element, weight) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 47) % np.uint64(size)).astype(np.int64)
    odd = np.zeros(docs * size, np.uint8)
    np.add.at(odd, np.repeat(doc, weight) * size + at, np.uint8(1))  # wraps at 256, which is even
    odd &= 1
    return np.packbits(odd.reshape(docs, size), 1).view(np.int64).reshape(docs, size // 64)


def may_be(x: str, y: str, least: float):
    """Whether rows with (n, fold, odd) named x and y can be as similar as least; as a condition of the join itself.

    odd is a parity sketch, and so is fold, its words folded together by exclusive or: cheaper, but for long texts blunter.
    """
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    allowed = (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - least) / (1 + least)) + 1e-6
    sizes = F.least(f"{x}.n", f"{y}.n") >= least * F.greatest(f"{x}.n", f"{y}.n") - 1e-9
    folded = sum((apart(F.get(f"{x}.fold", F.lit(i)), F.get(f"{y}.fold", F.lit(i))) for i in range(FOLDED)), F.lit(0))
    whole = F.aggregate(F.zip_with(f"{x}.odd", f"{y}.odd", apart), F.lit(0), lambda a, v: a + v)
    return sizes & (folded <= allowed) & (whole <= allowed)


def renamed(a: np.ndarray, b: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """a, but where it is one of clashing, another number from a and b."""
    again = among(clashing, pa.array(a))
    return np.where(again, mix(a.view(np.uint64) ^ mix(b.view(np.uint64), 57), 58).view(np.int64), a) if again.any() else a


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, t, a, b, n, odd, keys): hash of the text, digests of its words, null where it has none, its number of

    shingles, their parity sketch, and the keys of its signature's bands; and those digests that texts of other words share.
    """

    def table_(clashing: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i, j, buf, offs in blocks(batch.column("text")):
                    w = words(buf, offs)
                    a, b, has = digest(w, j - i)
                    a = renamed(a, b, clashing)
                    doc, h, many = elements(w, j - i, size)
                    signs = dart_signatures(doc, h, many.astype(np.float64), j - i, bands * rows)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1))) for x in (parity(doc, h, many, j - i), band_keys(signs, bands, rows).view(np.int64))]
                    total = pa.array(np.bincount(doc, many, j - i).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "t")), pa.array(a, mask=~has), pa.array(b, mask=~has), total, *lists], names=["doc_id", "t", "a", "b", "n", "odd", "keys"])

        named = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
        return stored(named.mapInArrow(run, "doc_id long, t long, a long, b long, n long, odd array<long>, keys array<long>"))

    none = np.zeros(0, np.int64)
    out = table_(none)
    # expected of ten thousand million texts: one or two such digests
    clashing = out.where(F.col("a").isNotNull()).groupBy("a").agg(F.min("b").alias("p"), F.max("b").alias("q")).where("p != q").select("a").toArrow()
    if not clashing.num_rows:
        return out, none
    clashing = np.sort(clashing.column("a").to_numpy())
    return table_(clashing), clashing


def texts_of(docs: DataFrame, ids: DataFrame, clashing: np.ndarray, bound: int = BROADCAST_KEYS) -> DataFrame:
    """(id, text): one row for each of ids (the a of signed()), by the digest of the text itself."""
    few = ids.limit(bound + 1).count() <= bound
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column("id").to_numpy()) if few else None)

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column("text")):
                a, b, has = digest(words(buf, offs), j - i)
                a = renamed(a, b, clashing)
                take = has if sent.value is None else has & among(sent.value, pa.array(a))
                at = pa.array(np.flatnonzero(take))
                yield pa.RecordBatch.from_arrays([pa.array(a).take(at), batch.column("text").slice(i, j - i).take(at)], names=["id", "text"])

    rows = small_batches(docs).select("text").mapInArrow(run, "id long, text string")
    if not few:
        rows = rows.join(ids, "id", "left_semi")
    return rows.groupBy("id").agg(F.first("text").alias("text"))


def similar(pairs: DataFrame, texts: DataFrame, least: float = LEAST, size: int = SIZE) -> DataFrame:
    """Those of pairs(x, y), x and y ids in texts(id, text), whose weighted Jaccard similarity is least or more."""
    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")

    def run(batches):
        for batch in batches:
            n, at = batch.num_rows, 0
            while at < n:  # a few pairs at a time
                part = batch.slice(at, 64)
                at += 64
                m = part.num_rows
                sides = []
                for c in ("tx", "ty"):
                    for i, j, buf, offs in blocks(part.column(c)):
                        d, h, many = elements(words(buf, offs), j - i, size)
                        sides.append((d + i, h, many))
                d, h, many = (np.concatenate(x) for x in zip(*sides))
                order = np.lexsort((h, d))
                d, h, many = d[order], h[order], many[order]
                same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
                common = np.bincount(d[1:][same], np.minimum(many[1:], many[:-1])[same], m)
                union = np.bincount(d, many, m) - common
                ok = (common >= least * union - 1e-9) & (union > 0)
                yield part.select(["x", "y"]).filter(pa.array(ok))

    return both.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): of each id in links(x, y) the smallest id that links lead to; labels spread and jump."""
    edges = cut(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct())
    labels = cut(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = cut(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        labels = step.select("id", F.col("new").alias("label"))
        if not step.where("new < label").limit(1).count():
            return labels


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: float = LEAST, size: int = SIZE) -> DataFrame:
    """(doc_id, t, label, class_id, verified_links): the class of each row; of its text's links those that were verified.

    A text's id in the joins is its digest a; label is the smallest of its component's, null for rows without words.
    """
    signs, clashing = signed(docs, bands, rows, size)
    own = signs.where(F.col("a").isNotNull()).select("doc_id", "t", "a")
    one = signs.where(F.col("a").isNotNull()).groupBy(F.col("a").alias("id")).agg(F.first("keys").alias("keys"))
    buckets = one.select("id", F.explode("keys").alias("key"))
    shared = cut(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    met = shared.groupBy("id").agg(F.sum("n").alias("met"))
    shared = cut(shared.drop("n").join(met, "id"))
    heads = shared.groupBy("key").agg(F.max(F.struct("met", "id"))["id"].alias("head"))
    full = cut(shared.drop("met").join(heads, "key"))
    stars = cut(full.where("id != head").select(F.col("id").alias("x"), F.col("head").alias("y")).distinct())
    ids = cut(stars.select(F.col("x").alias("id")).union(stars.select(F.col("y").alias("id"))).distinct())
    near = stored(texts_of(docs, ids, clashing))
    links = cut(similar(stars, near, least, size))
    labels = components(links)
    # what shares a bucket but not a component, and hasn't met
    placed = full.join(labels, "id", "left").select("key", "id", "head", F.coalesce("label", "id").alias("label"))
    per = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")
    mixed = cut(placed.join(mixed, "key"))  # read three times below
    traits = signs.where(F.col("a").isNotNull()).groupBy(F.col("a").alias("id")).agg(F.first("n").alias("n"), F.first("odd").alias("odd"))
    folds = [reduce(lambda a, b: a.bitwiseXOR(b), [F.get("odd", F.lit(i + j)) for j in range(0, ODD // 64, FOLDED)]) for i in range(FOLDED)]
    traits = traits.withColumn("fold", F.array(*folds))
    mixed = stored(mixed.join(_sized(mixed.select("id").distinct().join(traits, "id")), "id"))
    x, y = mixed.where("label != main").alias("x"), mixed.alias("y")
    # a bucket's head has met all others of it as their star
    unmet = (F.col("x.id") != F.col("x.head")) & (F.col("y.id") != F.col("y.head"))
    apart = (F.col("x.key") == F.col("y.key")) & unmet & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    rest = x.join(y, apart & may_be("x", "y", least)).select(F.greatest("x.id", "y.id").alias("x"), F.least("x.id", "y.id").alias("y"))
    rest = rest.distinct().join(stars, ["x", "y"], "left_anti")
    more = cut(similar(cut(rest.select("x", "y")), near, least, size))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    ends = links.select(F.col("x").alias("id")).union(links.select(F.col("y").alias("id"))).groupBy("id").agg(F.count("*").alias("verified_links"))
    of = own.groupBy(F.col("a").alias("id")).agg(F.min("doc_id").alias("doc_id")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = of.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of = of.join(named, "label").join(ends, "id", "left").select(F.col("id").alias("a"), "label", "class_id", F.coalesce("verified_links", F.lit(0)).alias("verified_links"))
    out = own.join(of, "a").select("doc_id", "t", "label", "class_id", "verified_links")
    alone = signs.where(F.col("a").isNull()).select("doc_id", "t", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("verified_links"))
    return out.unionByName(alone)


def _sized(df: DataFrame, bound: int = BROADCAST_KEYS // 8) -> DataFrame:
    """df, broadcast if a count shows it small."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, of the smallest doc_id, and every row without words; docs' own columns only."""
    got = cut(classes(docs).select("doc_id", "t", "label"))
    own = got.where(F.col("label").isNotNull())
    first = own.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("m")).select("m.doc_id", "m.t")
    many = own.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.t") == F.col(f"{y}.t"))
    repeated = cut(many.where("n > 1").alias("m").join(first.alias("f"), same("m", "f"), "left_semi").select("doc_id", "t"))
    gone = many.alias("m").join(first.alias("f"), same("m", "f"), "left_anti").select("doc_id", "t").union(repeated)
    gone = cut(gone)
    small = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    out = keyed.alias("d").join((F.broadcast(gone) if small else gone).alias("g"), same("d", "g"), "left_anti").select("row")
    if repeated.limit(1).count():
        more = keyed.alias("d").join((F.broadcast(repeated) if small else repeated).alias("r"), same("d", "r"), "left_semi")
        out = out.union(more.groupBy("doc_id", "t").agg(F.first("row").alias("row")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "verified_links")
