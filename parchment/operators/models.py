"""Models of risk labels and scores: preprocessing, candidates, validation, choice, saving and serving; by pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation, scoring
from .boosting import SoftmaxBoosting

#: Numeric features in order, and labels.
NUMERIC = [
    "sum_insured", "annual_premium", "premium_to_coverage_ratio", "waiting_period_months", "pre_existing_disease_waiting_period_months", "copayment_percentage", "room_rent_limit_present", "icu_limit_present", "disease_sub_limit_count",
    "exclusion_count", "restoration_benefit_present", "no_claim_bonus_present", "child_coverage_present", "maternity_coverage_present", "claim_process_clarity_score", "ambiguous_clause_count", "risk_flags_count",
]
LABELS = ["Strong Coverage", "Moderate Coverage", "Caution Required", "High Risk"]


def preprocess() -> list:
    """policy_type one-hot over the known types (others are zeros) and the numbers, centred and scaled, as features."""
    index = StringIndexerModel.from_labels(scoring.TYPES, inputCol="policy_type", outputCol="type_index", handleInvalid="keep")
    return [
        index, OneHotEncoder(inputCol="type_index", outputCol="type_hot", dropLast=True), VectorAssembler(inputCols=NUMERIC, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True), VectorAssembler(inputCols=["type_hot", "scaled"], outputCol="features"),
    ]


def candidates(trees: int = 400, rounds: int = 100, seed: int = 42) -> dict[str, Callable]:
    """The classifiers by name."""
    own = {"labelCol": "label", "featuresCol": "features"}
    return {
        "Logistic Regression": lambda: LogisticRegression(maxIter=200, regParam=0.0025, weightCol="weight", **own),
        "Decision Tree": lambda: DecisionTreeClassifier(maxDepth=6, weightCol="weight", seed=seed, **own),
        "Random Forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=12, weightCol="weight", seed=seed, **own),
        "Gradient Boosting": lambda: SoftmaxBoosting(rounds=rounds, depth=3, rate=0.1, least=1, **own),
    }


def labelled(df: DataFrame) -> DataFrame:
    """label: the number of risk_label; weight: rows / (classes x rows of the class)."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("risk_label"))
    df = df.where(at > 0).withColumn("label", (at - 1).cast("double"))
    sizes = df.groupBy("label").agg(F.count("*").alias("n"))
    all_ = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    return df.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(all_)).withColumn("weight", F.col("all") / (F.col("classes") * F.col("n"))).drop("n", "all", "classes")


def macro(df: DataFrame) -> tuple[float, float]:
    """(accuracy, macro F1 over the classes that occur) of predicted against label."""
    accuracy = df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return accuracy, evaluation.class_report(df, "label", "prediction").agg(F.avg("f1")).first()[0]


def cross_validated(df: DataFrame, make: Callable, key: str, folds: int = 5) -> tuple[float, float]:
    """Mean and standard deviation of macro F1 over stratified folds."""
    parts = evaluation.stratified(df, key, "label", folds).cache()
    got = []
    for k in range(folds):
        model = Pipeline(stages=[*preprocess(), make()]).fit(parts.where(F.col("fold") != k))
        got.append(macro(model.transform(parts.where(F.col("fold") == k)))[1])
    parts.unpersist()
    mean = sum(got) / len(got)
    return mean, (sum((g - mean) ** 2 for g in got) / len(got)) ** 0.5


def regression_errors(df: DataFrame, true: str, predicted: str) -> tuple[float, float]:
    """Mean absolute error and the share of variance explained."""
    y, p = F.col(true), F.col(predicted)
    mae, sse, sst = df.agg(F.avg(F.abs(y - p)), F.sum((y - p) ** 2), F.var_pop(y) * F.count("*")).first()
    return mae, 1 - sse / sst if sst else 0.0


def train(df: DataFrame, key: str = "policy_id", makers: dict[str, Callable] | None = None, rounds: int = 100) -> tuple[PipelineModel, PipelineModel, dict]:
    """(classifier, regressor, metrics) of df with features, risk_label and coverage_clarity_score; a fifth is held back to measure."""
    makers = makers or candidates()
    rows = evaluation.stratified(labelled(df), key, "label", 5).withColumnRenamed("fold", "part").cache()
    learn, test = rows.where("part > 0"), rows.where("part = 0")
    compared = {}
    for name, make in makers.items():
        mean, spread = cross_validated(learn, make, key)
        accuracy, f1 = macro(Pipeline(stages=[*preprocess(), make()]).fit(learn).transform(test))
        compared[name] = {"cv_macro_f1_mean": round(mean, 4), "cv_macro_f1_std": round(spread, 4), "test_accuracy": round(accuracy, 4), "test_macro_f1": round(f1, 4)}
    best = max(compared, key=lambda n: compared[n]["cv_macro_f1_mean"])  # M09
    score = lambda: Pipeline(stages=[*preprocess(), GBTRegressor(labelCol="coverage_clarity_score", maxIter=rounds, maxDepth=3, stepSize=0.1, seed=42)])
    mae, r2 = regression_errors(score().fit(learn).transform(test), "coverage_clarity_score", "prediction")
    ruled = scoring.scored(test.drop("label")).withColumn("prediction", F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")) - 1.0)  # M11
    ruled = ruled.withColumn("label", (F.array_position(F.array(*map(F.lit, LABELS)), F.col("risk_label")) - 1).cast("double"))
    accuracy, f1 = macro(ruled)
    rule_mae = ruled.agg(F.avg(F.abs(F.col("score") - F.col("coverage_clarity_score")))).first()[0]
    metrics = {
        "best_model": best, "model_comparison": compared, "score_regressor": {"test_mae": round(mae, 2), "test_r2": round(r2, 4)},
        "rule_baseline": {"test_accuracy": round(accuracy, 4), "test_macro_f1": round(f1, 4), "score_mae": round(rule_mae, 2)}, "n_train": learn.count(), "n_test": test.count(),
    }
    fitted = Pipeline(stages=[*preprocess(), makers[best]()]).fit(rows), score().fit(rows)  # M12: for serving, on all rows
    rows.unpersist()
    return *fitted, metrics


def save(path: str, classifier: PipelineModel, regressor: PipelineModel) -> None:
    """K03."""
    classifier.write().overwrite().save(f"{path}/classifier")
    regressor.write().overwrite().save(f"{path}/regressor")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, PipelineModel] | None:
    """The saved models, or None where there are none that can be read: the rules then stand alone."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return PipelineModel.load(f"{path}/classifier"), PipelineModel.load(f"{path}/regressor")
    except (PySparkException, Py4JJavaError, FileNotFoundError):
        return None


def served(df: DataFrame, models: tuple[PipelineModel, PipelineModel] | None) -> DataFrame:
    """Df of features with rule_score, rule_label, score, label, confidence, agreement and label_display."""
    from .analysis import shown

    ruled = scoring.scored(df).withColumnsRenamed({"score": "rule_score", "label": "rule_label"})
    if models is None:
        out = ruled.withColumns({"score": F.col("rule_score"), "label": F.col("rule_label"), "confidence": F.lit(None).cast("double"), "agreement": F.lit(True)})
    else:
        keep = ruled.columns
        names = F.array(*map(F.lit, LABELS))
        got = models[0].transform(ruled)
        sure = F.array_max(vector_to_array("probability")) if "probability" in got.columns else F.lit(None).cast("double")
        got = got.select(*keep, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("label"), F.round(sure, 3).alias("confidence"))
        got = models[1].transform(got).select(*got.columns, F.bround(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(100.0)), 0).cast("int").alias("score"))
        out = got.withColumn("agreement", F.col("label") == F.col("rule_label"))
    return out.withColumn("label_display", shown(F.col("label")))
