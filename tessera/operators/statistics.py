"""ANALYZE: statistics of a column, and functional dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, column: str, bounds: int = 4) -> DataFrame:
    """One row: count, nulls, ndistinct, min, max, and the bounds of an equi-depth histogram."""
    c = F.col(column)
    at = [i / bounds for i in range(bounds + 1)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.countDistinct(c).alias("ndistinct"), F.min(c).alias("low"), F.max(c).alias("high"), F.percentile_approx(c, at, 10000).alias("histogram"))


def distinct_groups(df: DataFrame, *columns: str) -> DataFrame:
    """How many different combinations some columns have, beside the product of each one's: what a planner would guess without statistics of several columns."""
    return df.agg(F.countDistinct(F.struct(*columns)).alias("combinations"), *[F.countDistinct(c).alias(f"of_{c}") for c in columns])


def most_common(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n commonest values with their frequencies."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)
    return top.crossJoin(total).select(column, "n", (F.col("n") / F.col("_all")).alias("frequency"))


def dependency_degree(df: DataFrame, left: str, right: str) -> DataFrame:
    """The share of rows whose left value goes with one right value only: 1 if left determines right."""
    g = df.groupBy(left).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(right).alias("k"))
    return g.agg((F.sum(F.when(F.col("k") <= 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("degree"))
