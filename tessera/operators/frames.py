"""Window frames that Spark's SQL lacks: GROUPS, and EXCLUDE.

GROUPS becomes RANGE over dense_rank(). EXCLUDE of rows inside the frame is a subtraction for sum, count and avg: state of fixed size for any frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: Column, start: int, end: int, **aggregates: Column) -> DataFrame:
    """Each aggregate over the peer groups from start to end before or after the row's own (Window.unboundedPreceding and so on for no bound)."""
    numbered = df.withColumn("_peers", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    w = Window.partitionBy(*partition).orderBy("_peers").rangeBetween(start, end)
    return numbered.select(*df.columns, *[a.over(w).alias(n) for n, a in aggregates.items()])


def excluding(df: DataFrame, partition: list[str], key: str, value: str, exclude: str, frame: WindowSpec | None = None) -> DataFrame:
    """n, total and mean of value over a frame without CURRENT ROW, its GROUP of peers (by key), or its TIES; NO OTHERS excludes nothing.

    The frame has to hold the excluded rows; without one it is the partition.
    """
    whole = frame if frame is not None else Window.partitionBy(*partition)
    peers = Window.partitionBy(*partition, key)
    v, one = F.col(value), F.when(F.col(value).isNotNull(), 1).otherwise(0)
    zero = lambda x: F.coalesce(x, F.lit(0))
    own_n, own = one, zero(v)
    all_n, all_ = F.count(v).over(whole), zero(F.sum(v).over(whole))
    group_n, group = F.count(v).over(peers), zero(F.sum(v).over(peers))
    n, total = {"NO OTHERS": (all_n, all_), "CURRENT ROW": (all_n - own_n, all_ - own), "GROUP": (all_n - group_n, all_ - group), "TIES": (all_n - group_n + own_n, all_ - group + own)}[exclude]
    return df.select(*df.columns, n.cast("long").alias("n"), F.when(n > 0, total).alias("total"), F.when(n > 0, total / n).alias("mean"))


def extreme_excluding_current(df: DataFrame, partition: list[str], value: str, largest: bool = True) -> DataFrame:
    """max (or min) of a partition without the current row: the best value, or the second best for the one row that has it alone."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    w = Window.partitionBy(*partition).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value(value, 2).over(whole)
    return df.select(*df.columns, F.when(F.row_number().over(w) == 1, second).otherwise(F.first(value).over(whole)).alias("best"))


def values_excluding(df: DataFrame, partition: list[str], key: str, row: str, value: str, exclude: str, frame: WindowSpec) -> DataFrame:
    """n, total, low, high, first and last of value over any frame ordered by key, without CURRENT ROW, its GROUP of peers, or its TIES; row names rows apart.

    Extremes can't be subtracted, so a row's frame is held as a list: its state is as long as the frame. For whole partitions use excluding().
    """
    items = F.collect_list(F.struct(F.col(key).alias("k"), F.col(row).alias("r"), F.col(value).alias("v"))).over(frame)
    keep = {"NO OTHERS": lambda x: F.lit(True), "CURRENT ROW": lambda x: x["r"] != F.col(row), "GROUP": lambda x: ~x["k"].eqNullSafe(F.col(key)), "TIES": lambda x: ~x["k"].eqNullSafe(F.col(key)) | (x["r"] == F.col(row))}[exclude]
    held = df.withColumn("_frame", items).withColumn("_v", F.transform(F.filter("_frame", keep), lambda x: x["v"]))
    some = F.array_compact("_v")
    total = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("double"), lambda s, x: s + x))
    return held.select(*df.columns, F.size(some).cast("long").alias("n"), total.alias("total"), F.array_min("_v").alias("low"), F.array_max("_v").alias("high"), F.get("_v", F.lit(0)).alias("first"), F.get("_v", F.size("_v") - 1).alias("last"))
