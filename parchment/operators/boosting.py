"""Histogram gradient boosting: trees on binned columns, a bin for missing values, squared error or softmax over classes.

Rows of equal values (of a classifier, of one class too) count as one, with their weights and their number, which
changes no sum; so a pass is over distinct rows. These are binned once and kept as blocks of bytes. For each level of
a round's trees one pass sums gradients by node, column and bin in the tasks, and only these sums reach the driver,
which chooses the splits; so what the driver and a task hold depends on columns, bins, classes and depth, not on rows.
What the finished trees say of a row is kept with it and written anew every EVERY rounds.

A value goes left if it is at most the split's edge; missing values go to the side that gains more, left if neither
does. Ties go to the first column and the lowest edge. Nodes of fewer than two times `least` rows stay leaves.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept, sized, stored

BINS = 255  # and one for missing values
EVERY = 10
BLOCK = 1 << 16  # numbers of a histogram that travel together


@dataclass
class Boosted:
    """edges: by column, increasing; start: raw score of each class; trees: by round and class (column, bin, missing_left, values)."""

    edges: list[list[float]]
    start: list[float]
    classes: int  # 0: regression
    depth: int
    trees: list[list[dict]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), BINS, np.searchsorted(np.array(e), x[:, j], "left") if e else 0)
        return out

    def raw(self, bins: np.ndarray, first: int = 0, f: np.ndarray | None = None) -> np.ndarray:
        """Raw scores, rows x classes; with f those after the trees before round first."""
        f = np.tile(np.array(self.start), (len(bins), 1)) if f is None else f.copy()
        for trees in self.trees[first:]:
            for k, t in enumerate(trees):
                f[:, k] += np.array(t["values"])[places(bins, t, self.depth)]
        return f

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or values."""
        f = self.raw(self.binned(x))
        return softmax(f) if self.classes else f


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def places(bins: np.ndarray, tree: dict, depth: int) -> np.ndarray:
    """Each row's node at depth, from 0 on the left; below a leaf rows go left."""
    at = np.zeros(len(bins), np.int64)
    column, cut, left = (np.array(tree[c]) for c in ("column", "bin", "missing_left"))
    for level in range(depth):
        node = (1 << level) - 1 + at
        of = column[node]
        b = bins[np.arange(len(bins)), np.maximum(of, 0)]
        right = (of >= 0) & np.where(b == BINS, ~left[node], b > cut[node])
        at = 2 * at + right
    return at


def gradients(f: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    if not classes:
        return f - y[:, None], np.ones_like(f)
    p = softmax(f)
    return p - (y[:, None] == np.arange(classes)), p * (1 - p)


def histograms(bins: np.ndarray, at: list[np.ndarray], g: np.ndarray, h: np.ndarray, w: np.ndarray, n: np.ndarray, nodes: int) -> np.ndarray:
    """classes x nodes x columns x (BINS + 1) x 3: sums of gradients, of second derivatives, and rows."""
    columns = bins.shape[1]
    out = np.zeros((g.shape[1], nodes, columns, BINS + 1, 3))
    size = nodes * columns * (BINS + 1)
    for k in range(g.shape[1]):
        cell = ((at[k][:, None] * columns + np.arange(columns)) * (BINS + 1) + bins).reshape(-1)
        for i, v in enumerate((g[:, k] * w, h[:, k] * w, n)):
            out[k, ..., i] = np.bincount(cell, np.repeat(v, columns), size).reshape(nodes, columns, BINS + 1)
    return out


def best_split(sums: np.ndarray, least: int, l2: float) -> tuple[int, int, bool, np.ndarray, np.ndarray] | None:
    """(column, bin, missing_left, sums on the left, on the right) of one node's columns x bins x 3, or None."""
    total = sums[0].sum(0)
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2 + 1e-12)
    below = np.cumsum(sums[:, : BINS - 1], 1)
    best, found = 1e-9, None
    gains = []
    for with_missing in (True, False):
        left = below + sums[:, BINS:] if with_missing else below
        right = total - left
        gain = worth(left) + worth(right) - worth(total)
        gains.append((np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -1.0), left, right))
    for with_missing, (gain, left, right) in zip((True, False), gains):
        at = int(np.argmax(gain))
        if gain.flat[at] > best * (1 + 1e-9):
            j, b = divmod(at, gain.shape[1])
            best, found = gain[j, b], (j, b, with_missing, left[j, b], right[j, b])
    return found


def _added(rows: DataFrame, run) -> np.ndarray:
    """Sums of the arrays that run(batches) makes of each partition; added by block over the cluster, collected once."""

    def parts(batches):
        got = run(batches)
        if got is not None:
            flat = got.reshape(-1)
            cut = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut))), pa.array(cut, pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    sent = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(parts, "block long, sums binary")
    got = sent.groupBy("block").applyInArrow(add, "block long, sums binary").collect()
    return np.concatenate([np.frombuffer(x.sums) for x in sorted(got)]) if got else np.zeros(0)


def _cells(batch: pa.RecordBatch, columns: int, width: int):
    for b, y, w, n, f in zip(*(batch.column(c).to_pylist() for c in ("bins", "y", "w", "n", "f"))):
        yield np.frombuffer(b, np.uint8).reshape(-1, columns), np.frombuffer(y), np.frombuffer(w), np.frombuffer(n), np.frombuffer(f).reshape(-1, width)


def fit(df: DataFrame, columns: list[str], target: str, classes: int = 0, rounds: int = 100, depth: int = 3, rate: float = 0.1, least: int = 20, l2: float = 0.0, weight: str | None = None) -> Boosted:
    """The trees of df's columns (numbers; null and NaN are missing) for target: a number, or a class from 0 to classes - 1."""
    number = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.where(F.col(target).isNotNull()).select(*number, F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    cuts = F.array(*[F.lit((i + 1) / (BINS + 1)) for i in range(BINS)])
    stats = rows.agg(*[F.percentile_approx(f"c{i}", cuts, 10_000).alias(f"c{i}") for i in range(len(columns))], F.sum("w").alias("w"), F.sum(F.col("y") * F.col("w")).alias("y"), *[F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)).alias(f"n{k}") for k in range(classes)]).first()
    if not stats["w"]:
        raise ValueError("no rows with a target")
    edges = [sorted(set(stats[f"c{i}"] or []))[: BINS - 1] for i in range(len(columns))]
    start = [float(np.log(max(stats[f"n{k}"], 1e-12) / stats["w"])) for k in range(classes)] if classes else [stats["y"] / stats["w"]]
    model = Boosted(edges, start, classes, depth)
    width = len(start)
    # of equal rows a gradient times the weight adds up to that of their mean target
    sums = F.sum("w").alias("w"), F.count("*").cast("double").alias("n"), F.sum(F.col("y") * F.col("w")).alias("wy")
    mean = F.when(F.col("w") != 0, F.col("wy") / F.col("w")).otherwise(0.0)
    alike = rows.groupBy(*[f"c{i}" for i in range(len(columns))], *(["y"] if classes else [])).agg(*sums)
    alike = alike.drop("wy") if classes else alike.withColumn("y", mean).drop("wy")

    def pack(batches):
        for batch in batches:
            x = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], 1)
            bins = model.binned(x)
            cells = bins.tobytes(), batch.column("y").to_numpy().tobytes(), batch.column("w").to_numpy().tobytes(), batch.column("n").to_numpy().tobytes(), np.tile(np.array(start), (len(bins), 1)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["bins", "y", "w", "n", "f"])

    kinds = "bins binary, y binary, w binary, n binary, f binary"
    blocks, done = kept(alike.mapInArrow(pack, kinds)), 0
    spark = df.sparkSession
    for _ in range(rounds):
        trees = [{"column": [], "bin": [], "missing_left": [], "values": [0.0]} for _ in range(width)]
        sums: list[list] = []  # of the nodes of a level, by class
        for level in range(depth):
            nodes = 1 << level
            sent = spark.sparkContext.broadcast((model, trees, done))

            def run(batches, nodes=nodes, level=level, sent=sent):
                m, growing, first = sent.value
                total = None
                for batch in batches:
                    for bins, y, w, n, f in _cells(batch, len(columns), width):
                        f = m.raw(bins, first, f)
                        g, h = gradients(f, y, classes)
                        got = histograms(bins, [places(bins, t, level) for t in growing], g, h, w, n, nodes)
                        total = got if total is None else total + got
                return total

            got = _added(blocks, run).reshape(width, nodes, len(columns), BINS + 1, 3)
            below = []
            for k, t in enumerate(trees):
                own = []
                for node in range(nodes):
                    here = sums[k][node] if level else got[k, node, 0].sum(0)
                    split = best_split(got[k, node], least, l2) if here is not None and here[2] >= 2 * least else None
                    t["column"].append(split[0] if split else -1)
                    t["bin"].append(split[1] if split else 0)
                    t["missing_left"].append(bool(split[2]) if split else True)
                    own += [split[3], split[4]] if split else [here, None]
                below.append(own)
            sums = below
        # of a classifier's leaf the step is scaled as for K classes
        scale = rate * ((classes - 1) / classes if classes > 1 else 1.0)
        for k, t in enumerate(trees):
            t["values"] = [0.0 if s is None else float(-scale * s[0] / (s[1] + l2 + 1e-12)) for s in sums[k]]
        model.trees.append(trees)
        if len(model.trees) - done >= EVERY and len(model.trees) < rounds:
            sent = spark.sparkContext.broadcast((model, done))

            def onward(batches, sent=sent):
                m, first = sent.value
                for batch in batches:
                    for b, y, w, n, f in zip(*(batch.column(c).to_pylist() for c in ("bins", "y", "w", "n", "f"))):
                        new = m.raw(np.frombuffer(b, np.uint8).reshape(-1, len(columns)), first, np.frombuffer(f).reshape(-1, width))
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (b, y, w, n, new.tobytes())], names=["bins", "y", "w", "n", "f"])

            blocks, done = kept(blocks.mapInArrow(onward, kinds)), len(model.trees)
    return model


def predicted(df: DataFrame, model: Boosted, columns: list[str], name: str = "prediction") -> DataFrame:
    """df with the model's values, or with an array of the classes' probabilities."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    classes = model.classes

    @F.pandas_udf("array<double>" if classes else "double")
    def score(x: pd.DataFrame) -> pd.Series:
        got = sent.value.predicted(x.to_numpy(dtype=float))
        return pd.Series(list(got) if classes else got[:, 0])

    cells = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.withColumn(name, score(F.struct(*cells)))


class SoftmaxBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting over classes as a stage of a pipeline: featuresCol (a vector), labelCol, weightCol to prediction and probability."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features")
    labelCol = Param(Params._dummy(), "labelCol", "label")
    rounds = Param(Params._dummy(), "rounds", "rounds of trees")
    depth = Param(Params._dummy(), "depth", "levels of splits")
    rate = Param(Params._dummy(), "rate", "share of a leaf's step")
    least = Param(Params._dummy(), "least", "rows of a leaf at least")

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=100, depth=3, rate=0.1, least=1):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(featuresCol="features", labelCol="label", rounds=100, depth=3, rate=0.1, least=1)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        from pyspark.ml.functions import vector_to_array

        of = {p: self.getOrDefault(getattr(self, p)) for p in ("featuresCol", "labelCol", "rounds", "depth", "rate", "least")}
        rows = dataset.select(vector_to_array(of["featuresCol"]).alias("x"), F.col(of["labelCol"]).alias("y"))
        many, classes = rows.agg(F.max(F.size("x")), F.max("y")).first()
        names = [f"x{i}" for i in range(many)]
        wide = rows.select("y", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
        model = fit(wide, names, "y", int(classes) + 1, of["rounds"], of["depth"], of["rate"], of["least"])
        out = SoftmaxBoostingModel()
        return out._set(featuresCol=of["featuresCol"], trees=json.dumps(model.__dict__))


class SoftmaxBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "features")
    trees = Param(Params._dummy(), "trees", "the model as JSON")

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        model = Boosted(**json.loads(self.getOrDefault(self.trees)))
        names = [f"x{i}" for i in range(len(model.edges))]
        x = vector_to_array(self.getOrDefault(self.featuresCol))
        cells = dataset.withColumns({f"_boost_{n}": F.get(x, F.lit(i)) for i, n in enumerate(names)})
        got = predicted(cells, model, [f"_boost_{n}" for n in names], "_boost_p").drop(*[f"_boost_{n}" for n in names])
        likeliest = F.array_position("_boost_p", F.array_max("_boost_p")) - 1.0
        return got.withColumn("probability", array_to_vector("_boost_p")).withColumn("prediction", likeliest).drop("_boost_p")


def ordinal(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns replaced by the place of their value among the training part's, in order, from 0; -1 for missing and unseen ones."""
    for c in columns:
        codes = train.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_code", F.row_number().over(Window.orderBy(c)) - 1)  # categories: a row each
        df = df.join(sized(stored(codes)), c, "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_code")
    return df


def rmsle(rows: DataFrame, true: str, predicted_: str) -> DataFrame:
    """One row: the root of the mean squared difference of log1p(true) and a prediction of it."""
    return rows.agg(F.sqrt(F.avg((F.log1p(true) - F.col(predicted_)) ** 2)).alias("rmsle"), F.count("*").alias("n"))
