"""Pages to clean lines: running headers and footers, page numbers and personal data go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import apart

EDGE = 3  # lines at either end of a page that may be a running header or footer


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, masked): what stands at the edges of half of a document's three or more pages, digits as #."""
    rows = pages.select("doc_id", "page", F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: x != "").alias("all"))
    edges = F.array_union(F.slice("all", 1, EDGE), F.slice("all", F.greatest(F.size("all") - EDGE + 1, F.lit(1)), EDGE))
    # pages with an empty list of lines still count as pages
    masked = rows.select("doc_id", F.explode_outer(F.transform(edges, T.digits_masked)).alias("masked"))
    counts = masked.groupBy("doc_id", "masked").agg(F.count("masked").alias("n"))
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return counts.join(apart(sizes), "doc_id").where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2)))).select("doc_id", "masked")


def clean_pages(pages: DataFrame, mask: bool = True) -> DataFrame:
    """(doc_id, page, text) with one row for each page: normal lines, words joined over line ends, that are neither blank, page numbers nor running headers; personal data masked.

    A page's lines stay in its row; only the list of a document's running headers comes to it.
    """
    gone = repeated_lines(pages).groupBy("doc_id").agg(F.collect_set("masked").alias("gone"))
    lines = F.transform(T.lines(T.dehyphenate(F.col("text"))), T.normal_line)
    lines = F.filter(lines, lambda x: (x != "") & ~T.page_number(x))
    rows = pages.select("doc_id", "page", lines.alias("l")).join(apart(gone), "doc_id", "left")
    rest = F.when(F.col("gone").isNull(), F.col("l")).otherwise(F.filter("l", lambda x: ~F.array_contains("gone", T.digits_masked(x))))
    body = F.coalesce(F.array_join(rest, "\n"), F.lit(""))
    return rows.select("doc_id", "page", (T.anonymize(body) if mask else body).alias("text"))


def long_enough(pages: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, chars, ok): whether the clean text of a document is long enough to be analysed."""
    return pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).withColumn("ok", F.col("chars") >= least)


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
