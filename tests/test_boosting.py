"""Boosted trees against plain loops; codes and errors; the stage in a pipeline, saved and loaded."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from parchment.operators import boosting

R = random.Random(8)
ROWS = [(R.choice([None, float("nan"), *map(float, range(12))]), float(R.randrange(40)), R.choice([None, 1.0, 2.0]), 1.0) for _ in range(300)]


def value(a, b, c):
    return (3.0 if a is None or a != a else a / 4) + (2.0 if b > 20 else 0.0) * (c or 0.5)


def naive(x, y, edges, classes, rounds, depth, rate, least):
    """Raw scores of all rows, trees grown by loops over rows and edges."""
    n, width = len(y), classes or 1
    start = [math.log(sum(t == k for t in y) / n) for k in range(classes)] if classes else [sum(y) / n]
    f = np.tile(np.array(start), (n, 1))
    for _ in range(rounds):
        g, h = np.zeros((n, width)), np.ones((n, width))
        for i in range(n):
            if classes:
                e = [math.exp(v - max(f[i])) for v in f[i]]
                for k in range(classes):
                    p = e[k] / sum(e)
                    g[i, k], h[i, k] = p - (y[i] == k), p * (1 - p)
            else:
                g[i, 0] = f[i, 0] - y[i]
        new = f.copy()
        for k in range(width):

            def grow(rows, level):
                G, H = sum(g[i, k] for i in rows), sum(h[i, k] for i in rows)
                best = None
                if level < depth and len(rows) >= 2 * least:
                    for missing_left in (True, False):
                        for j, cuts in enumerate(edges):
                            for c in cuts:
                                a = [i for i in rows if (missing_left if math.isnan(x[i][j]) else x[i][j] <= c)]
                                b = [i for i in rows if i not in set(a)]
                                if min(len(a), len(b)) < least:
                                    continue
                                gain = sum(sum(g[i, k] for i in s) ** 2 / (sum(h[i, k] for i in s) + 1e-12) for s in (a, b)) - G * G / (H + 1e-12)
                                if gain > (best[0] if best else 1e-9) * (1 + 1e-9):
                                    best = gain, a, b
                if best:
                    grow(best[1], level + 1)
                    grow(best[2], level + 1)
                else:
                    scale = rate * ((classes - 1) / classes if classes else 1)
                    for i in rows:
                        new[i, k] -= scale * G / (H + 1e-12)

            grow(list(range(n)), 0)
        f = new
    return f


@pytest.mark.parametrize("classes", [0, 3])
def test_equals_plain_loops(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "EVERY", 2)
    rows = [(a, b, c, float(round(value(a, b, c)) % 3) if classes else value(a, b, c) + R.random()) for a, b, c, _ in ROWS[:90]]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)
    model = boosting.fit(df, ["a", "b", "c"], "y", classes, rounds=3, depth=2, rate=0.5, least=5)
    x = [[math.nan if v is None else v for v in r[:3]] for r in rows]
    want = naive(x, [r[3] for r in rows], model.edges, classes, 3, 2, 0.5, 5)
    assert np.allclose(model.raw(model.binned(np.array(x))), want)
    got = boosting.predicted(df, model, ["a", "b", "c"]).collect()
    for r in got:
        i = next(i for i, v in enumerate(rows) if v[3] == r.y and (v[0] == r.a or (v[0] is None or v[0] != v[0]) and (r.a is None or r.a != r.a)) and v[1:3] == (r.b, r.c))
        assert np.allclose(r.prediction, boosting.softmax(want[i : i + 1])[0] if classes else want[i, 0])


def test_missing_values_have_a_side_of_their_own(spark):
    df = spark.createDataFrame([(None if i % 2 else float(i % 7), 5.0 if i % 2 else 1.0) for i in range(200)], "a double, y double")
    model = boosting.fit(df, ["a"], "y", rounds=30, depth=2, rate=0.5)
    assert np.allclose(model.predicted(np.array([[np.nan], [3.0]]))[:, 0], [5, 1], atol=0.1)


def test_stage_of_a_pipeline(spark, tmp_path):
    rows = [(float(i % 10), float(i % 3), float(i % 10 > 4) + (i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), boosting.SoftmaxBoosting(rounds=8)]).fit(df)
    fitted.write().overwrite().save(f"{tmp_path}/m")
    got = PipelineModel.load(f"{tmp_path}/m").transform(df)
    assert got.where(F.col("prediction") == F.col("label")).count() == 240 and set(got.columns) == {"a", "b", "label", "features", "prediction", "probability"}


def test_codes_and_errors(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("z", 4.0)], "c string, y double")
    got = boosting.ordinal(df.where("c IN ('a', 'b')"), df, ["c"])
    assert sorted((r.y, r.c) for r in got.collect()) == [(1.0, 1), (2.0, 0), (3.0, -1), (4.0, -1)]
    assert abs(boosting.rmsle(df.withColumn("p", F.lit(1.0)), "y", "p").first().rmsle - math.sqrt(sum((math.log1p(v) - 1) ** 2 for v in (1, 2, 3, 4)) / 4)) < 1e-12


@pytest.mark.parametrize("classes", [0, 3])
def test_equal_rows_are_one_in_every_pass(spark, monkeypatch, classes):
    passed, added = [], boosting._added
    monkeypatch.setattr(boosting, "_added", lambda rows, run: passed.append(sum(len(r.y) // 8 for r in rows.select("y").collect())) or added(rows, run))
    rows = [(None if i % 4 == 0 else float(i % 4), float(i % 3), float(i % (3 if classes else 7)), float(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y double, w double").repartition(3)
    model = boosting.fit(df, ["a", "b"], "y", classes, rounds=3, depth=2, rate=0.5, least=40, weight="w")
    assert passed == [12] * 6
    again = [r for r in rows if r[3]]  # rows without weight count for least only
    plain = boosting.fit(spark.createDataFrame(again, "a double, b double, y double, w double"), ["a", "b"], "y", classes, rounds=3, depth=2, rate=0.5, least=40)
    x = np.array([[math.nan if v is None else v for v in r[:2]] for r in again])
    assert np.allclose(model.predicted(x), plain.predicted(x))
    if not classes:
        want = naive(x.tolist(), [r[2] for r in again], plain.edges, 0, 3, 2, 0.5, 40)
        assert np.allclose(plain.raw(plain.binned(x)), want)
