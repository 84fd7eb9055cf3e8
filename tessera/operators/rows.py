"""Row selection that Spark's SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def fetch_first(df: DataFrame, *order: Column, n: int = 1, offset: int = 0) -> DataFrame:
    """OFFSET, then FETCH FIRST n ROWS ONLY; one row if n is missing."""
    return df.orderBy(*order).offset(offset).limit(n)


def fetch_with_ties(df: DataFrame, n: int, key: str, ascending: bool = True) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the n-th key is found by a bounded sort, then all rows up to it are taken, so that no task has all rows."""
    order = F.col("_k").asc_nulls_last() if ascending else F.col("_k").desc_nulls_first()
    last = df.select(F.col(key).alias("_k")).orderBy(order).limit(n)
    edge = F.broadcast(last.agg(F.max("_k").alias("_edge") if ascending else F.min("_k").alias("_edge"), F.count_if(F.col("_k").isNull()).alias("_nulls"), F.count("_k").alias("_some")))
    near = (F.col(key) <= F.col("_edge")) if ascending else (F.col(key) >= F.col("_edge"))
    # nulls are last going up and first going down
    take = (F.when(F.col("_nulls") > 0, True) if ascending else F.when((F.col("_nulls") > 0) & (F.col("_some") == 0), F.col(key).isNull()).when(F.col(key).isNull(), True)).otherwise(near)
    return df.crossJoin(edge).where(take).select(*df.columns)
