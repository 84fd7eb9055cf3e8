"""Ranges as structs (lo, hi, lo_inc, hi_inc, empty); discrete ones are kept as [lo, hi)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discrete(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """Of whole numbers or dates: (a, b] is [a + 1, b + 1); empty if nothing is between."""
    low = lo if bounds[0] == "[" else lo + 1
    high = hi if bounds[1] == ")" else hi + 1
    empty = F.coalesce(low >= high, F.lit(False))
    return F.struct(F.when(~empty, low).alias("lo"), F.when(~empty, high).alias("hi"), (~empty & low.isNotNull()).alias("lo_inc"), F.lit(False).alias("hi_inc"), empty.alias("empty"))


def continuous(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    empty = F.coalesce((lo > hi) | ((lo == hi) & F.lit(bounds != "[]")), F.lit(False))
    return F.struct(F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (~empty & lo.isNotNull() & F.lit(bounds[0] == "[")).alias("lo_inc"), (~empty & hi.isNotNull() & F.lit(bounds[1] == "]")).alias("hi_inc"), empty.alias("empty"))


def lower(r: Column) -> Column:
    return r["lo"]


def upper(r: Column) -> Column:
    return r["hi"]


def isempty(r: Column) -> Column:
    return r["empty"]


def lower_inc(r: Column) -> Column:
    return r["lo_inc"]


def upper_inc(r: Column) -> Column:
    return r["hi_inc"]


def lower_inf(r: Column) -> Column:
    return r["lo"].isNull() & ~r["empty"]


def upper_inf(r: Column) -> Column:
    return r["hi"].isNull() & ~r["empty"]


def text(r: Column) -> Column:
    """[lo,hi), or empty."""
    ends = F.concat(F.when(r["lo_inc"], "[").otherwise("("), F.coalesce(r["lo"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["hi"].cast("string"), F.lit("")), F.when(r["hi_inc"], "]").otherwise(")"))
    return F.when(r["empty"], "empty").otherwise(ends)
