"""Registered queries of training: ordinal codes, errors of logarithms, and boosted trees over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, evaluation
from .queries import _t, query


def _lines(spark, d):
    """Line items with some missing numbers; every fifth order is held out."""
    held = F.pmod(F.col("l_orderkey"), F.lit(5)) == 0
    few = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", few.alias("l_discount"), "l_tax", F.month("l_shipdate").alias("month"), "l_extendedprice", held.alias("held"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (l_linenumber % 3 = 0) AS few FROM lineitem)
SELECT * FROM (SELECT unnest(['held', 'l_discount', 'l_extendedprice', 'l_linenumber', 'l_linestatus', 'l_orderkey', 'l_quantity', 'l_returnflag', 'l_tax', 'month']) AS "column", round(unnest([0, few / n, 0, 0, 0, 0, 0, 0, 0, 0]), 3)::DOUBLE AS share FROM s) ORDER BY share DESC, "column" LIMIT 8""")
def null_shares(spark, d):
    """Columns with the largest shares of missing values."""
    return evaluation.null_shares(_lines(spark, d))


@query("""WITH t AS (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_returnflag <> 'R'), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM t)
SELECT coalesce(code, -1)::INT AS code, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem LEFT JOIN c ON c.v = l_returnflag GROUP BY ALL""")
def ordinal_codes(spark, d):
    """Places of categories in the order of the training part, -1 for those that it lacks."""
    rows = _lines(spark, d)
    got = boosting.ordinal(rows.where(~F.col("held") & (F.col("l_returnflag") != "R")), rows, ["l_returnflag"])
    return got.groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""WITH m AS (SELECT l_quantity, avg(ln(1 + l_extendedprice)) AS mean FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_quantity)
SELECT round(sqrt(avg((ln(1 + l_extendedprice) - mean) ** 2)), 8) AS rmsle, count(*) AS n FROM lineitem JOIN m USING (l_quantity) WHERE l_orderkey % 5 = 0""")
def log_errors(spark, d):
    """The error of logarithms of held-out prices, where the mean of the training part's is the prediction."""
    rows = _lines(spark, d)
    means = rows.where(~F.col("held")).groupBy("l_quantity").agg(F.avg(F.log1p("l_extendedprice")).alias("mean"))
    return boosting.rmsle(rows.where("held").join(means, "l_quantity"), "l_extendedprice", "mean").select(F.round("rmsle", 8).alias("rmsle"), "n")


@query()
def boosted_prices(spark, d):
    """Boosted trees for the logarithm of a line's price, from quantity, missing discounts, tax, month and coded flags; the held-out error."""
    columns = ["l_quantity", "l_discount", "l_tax", "month", "l_returnflag", "l_linestatus"]
    rows = _lines(spark, d)
    rows = boosting.ordinal(rows.where(~F.col("held")), rows, ["l_returnflag", "l_linestatus"]).withColumn("y", F.log1p("l_extendedprice"))
    model = boosting.fit(rows.where(~F.col("held")), columns, "y", rounds=20, depth=3, rate=0.3)
    got = boosting.rmsle(boosting.predicted(rows.where("held"), model, columns), "l_extendedprice", "prediction")
    return got.select(F.round("rmsle", 6).alias("rmsle"), "n")
