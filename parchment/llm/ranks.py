"""Ranks over a whole table, or within groups of any size, without a window over a group: one sort by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, stored

INSIDE = 33  # monotonically_increasing_id's bits for a row's place in its partition


def sized(df: DataFrame, bound: int = BROADCAST_KEYS // 8) -> DataFrame:
    """df, of short rows, broadcast if a count shows it small."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def ranked(df: DataFrame, order: list[Column], name: str, within: str | None = None) -> DataFrame:
    """df with a long column name: 1, 2, 3... in order, of the rows with an equal (also null) column within.

    Rows are sorted by ranges of (within, order) and stored with their partition and place; what goes before a
    partition is added up from a row for each partition and group in it. Of rows equal in order any may be first.
    """
    groups = [F.col(within).asc()] if within else []
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_place", place)
    rows = stored(rows.withColumn("_part", F.shiftright("_place", INSIDE)))
    same = F.col(within) if within else F.lit(0)
    parts = rows.groupBy("_part", same.alias("_group")).agg(F.count("*").alias("_n"), F.min("_place").alias("_from"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = rows.alias("r")
    met = (F.col("r._part") == F.col("p._part")) & (F.col(f"r.{within}").eqNullSafe(F.col("p._group")) if within else F.lit(True))
    rank = F.col("p._before") + F.col("r._place") - F.col("p._from") + 1
    return rows.join(sized(parts).alias("p"), met).select(*[F.col(f"r.`{c}`") for c in df.columns], rank.alias(name))
