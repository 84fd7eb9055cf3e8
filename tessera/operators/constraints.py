"""Checks on write: each gives the rows that break a rule, so none means that it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """UNIQUE: keys that more than one row has; keys with a NULL never clash."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """FOREIGN KEY: rows whose value the parent lacks; NULL is free."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def failing(df: DataFrame, check: Column) -> DataFrame:
    """CHECK: rows for which it is false; NULL passes."""
    return df.where(~check)


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return df.where(out)
