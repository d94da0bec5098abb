"""Evaluation and exploration: comparisons, rates, splits, confusion, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_value(expected: Column, actual: Column) -> Column:
    """Null without an expectation; booleans as such, numbers within 1e-6, else trimmed text in upper case."""
    boolean = F.lower(expected).isin("true", "false")
    a, b = expected.try_cast("double"), actual.try_cast("double")
    return F.when(expected.isNull(), None).when(boolean, F.coalesce(F.lower(expected) == F.lower(actual), F.lit(False))).when(a.isNotNull(), F.coalesce(F.abs(a - b) < 1e-6, F.lit(False))).otherwise(
        F.coalesce(F.upper(F.trim(expected)) == F.upper(F.trim(actual)), F.lit(False))
    )


def keyword_recall(keywords: Column, answer: Column) -> Column:
    """Share of the keywords, parted by |, that the answer contains; null without any."""
    words = F.filter(F.transform(F.split(keywords, r"\|"), lambda k: F.trim(F.lower(k))), lambda k: k != "")
    return F.try_divide(F.size(F.filter(words, lambda k: F.contains(F.lower(answer), k))), F.size(words))


def stratified(df: DataFrame, key: str, label: str, parts: int) -> DataFrame:
    """fold: from 0, dealt in turn within each label in the order of the key's md5."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(parts)))


def confusion(df: DataFrame, true: str, predicted: str, labels: list) -> DataFrame:
    return df.groupBy(true).pivot(predicted, labels).count().na.fill(0)


def class_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support); an undefined ratio is 0."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = pairs.select(F.col("t").alias("label"), F.lit(0).alias("pred"), F.col("n").alias("sup"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    both = both.union(pairs.select("p", "n", F.lit(0), F.lit(0)))
    s = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("pred", "sup", "hit")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("label", ratio(F.col("hit"), F.col("pred")).alias("precision"), ratio(F.col("hit"), F.col("sup")).alias("recall"), ratio(2 * F.col("hit"), F.col("pred") + F.col("sup")).alias("f1"), F.col("sup").alias("support"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls) of every column in one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls")) for c in df.columns])).alias("x")).select("x.column", "rows", "x.nulls")


def null_shares(df: DataFrame, most: int = 8) -> DataFrame:
    """(column, share) of the columns with the largest shares of nulls, to three digits; equal ones by name."""
    return null_profile(df).select("column", F.round(F.try_divide("nulls", "rows"), 3).alias("share")).orderBy(F.col("share").desc(), "column").limit(most)


def checked(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, field, expected, extracted, correct): truth(doc_id, field, expected) beside extracted(doc_id, field, value)."""
    rows = truth.join(extracted.select("doc_id", "field", F.col("value").alias("extracted")), ["doc_id", "field"], "left")
    return rows.withColumn("correct", same_value(F.col("expected"), F.col("extracted")))


def long_form(extracted: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, value): these fields as texts; lists as JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in extracted.schema.fields}
    text = lambda c: F.to_json(c) if kinds[c].startswith("array") else F.col(c).cast("string")
    return extracted.select("doc_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields])))


def field_accuracy(rows: DataFrame) -> DataFrame:
    """(field, n, accuracy) of checked rows; rows without an expectation don't count."""
    return rows.where(F.col("correct").isNotNull()).groupBy("field").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def united(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; what one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def value_counts(df: DataFrame, column: str, order: list) -> DataFrame:
    """(ord, value, n) of these values in this order, 0 where one doesn't occur."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    want = df.sparkSession.createDataFrame(list(enumerate(order)), ["ord", "value"])
    return F.broadcast(want).join(counts, "value", "left").select("ord", "value", F.coalesce("n", F.lit(0)).alias("n"))


def quartiles(df: DataFrame, by: str, column: str) -> DataFrame:
    """Least, quartiles and most of a column, exact, for each value of by."""
    p = F.percentile(column, F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.0)))
    return df.groupBy(by).agg(p.alias("p")).select(by, *[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))])


def ranked_correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, corr) of each column with the target, in one pass; the largest first."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in columns])))
    return rows.orderBy(F.desc("corr"))


def replication(df: DataFrame, made: str, given: str) -> DataFrame:
    """How a count made from rules agrees with the given one: correlation and share of equal ones."""
    return df.agg(F.corr(made, given).alias("corr"), F.avg((F.col(made) == F.col(given)).cast("double")).alias("equal"))
