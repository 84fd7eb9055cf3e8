"""x op ANY (q) and x op ALL (q): the inner column is summed up in one row, by which a condition decides in three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summary(inner: DataFrame, column: str) -> DataFrame:
    v = inner[column]
    return F.broadcast(inner.agg(F.count(F.lit(1)).alias("_n"), F.count_if(v.isNull()).alias("_nulls"), F.min(v).alias("_lo"), F.max(v).alias("_hi")))  # one row


def _decided(x: Column, op: str, every: bool) -> Column:
    """TRUE, FALSE or NULL. For = ANY and <> ALL use IN and NOT IN."""
    lo, hi, n, nulls = (F.col(c) for c in ("_lo", "_hi", "_n", "_nulls"))
    hardest = {">": (hi, lo), ">=": (hi, lo), "<": (lo, hi), "<=": (lo, hi)}
    if op in hardest:
        bound = hardest[op][0 if every else 1]
        test = {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound}[op]
    elif op == "=" and every:
        test = (x == lo) & (x == hi)
    elif op == "<>" and not every:
        test = (x != lo) | (x != hi)
    else:
        raise ValueError(f"{op} {'ALL' if every else 'ANY'} is (NOT) IN")
    if every:
        return F.when(n == 0, True).when(~test, False).when(nulls > 0, F.lit(None)).otherwise(test)
    return F.when(n == 0, False).when(test, True).when(nulls > 0, F.lit(None)).otherwise(test)


def compare_any(outer: DataFrame, column: str, op: str, inner: DataFrame, inner_column: str) -> DataFrame:
    """Rows of outer for which column op ANY (inner_column) is true; FALSE for no rows."""
    return outer.crossJoin(_summary(inner, inner_column)).where(_decided(F.col(column), op, False)).select(*outer.columns)


def compare_all(outer: DataFrame, column: str, op: str, inner: DataFrame, inner_column: str) -> DataFrame:
    """Rows of outer for which column op ALL (inner_column) is true; TRUE for no rows, NULL operand included."""
    return outer.crossJoin(_summary(inner, inner_column)).where(_decided(F.col(column), op, True)).select(*outer.columns)


def not_in(outer: DataFrame, column: str, inner: DataFrame, inner_column: str) -> DataFrame:
    """NOT IN with its NULLs: no rows if inner has one; a NULL of outer stays only if inner has no rows."""
    some = _summary(inner, inner_column)
    keys = inner.select(inner[inner_column].alias("_key")).where("_key IS NOT NULL").distinct()
    left = outer.crossJoin(some).where("_n = 0 OR _nulls = 0").where((F.col("_n") == 0) | F.col(column).isNotNull())
    return left.join(keys, left[column] == keys["_key"], "left_anti").select(*outer.columns)
