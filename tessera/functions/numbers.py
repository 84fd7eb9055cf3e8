"""Mathematical functions with PostgreSQL's meaning where Spark's differs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero at so many digits: round() reads a double by its shortest decimal, and a step back is taken where it went away from zero."""
    r = F.round(x, digits)
    return F.when(F.abs(r) > F.abs(x), F.round(r - F.signum(x) * F.lit(10.0**-digits), digits)).otherwise(r)


def div(a: Column, b: Column) -> Column:
    """Integer quotient toward zero; NULL for a zero divisor."""
    b = F.nullif(b, F.lit(0))
    return F.call_function("div", a, b)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; NULL for a zero divisor."""
    return F.try_mod(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero divisor."""
    return F.try_divide(a, b)


@F.pandas_udf(T.LongType())
def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def gcd(a: Column, b: Column) -> Column:
    """Of 64-bit numbers, by whole Arrow batches: no built-in says it, and Euclid's steps as an expression are interpreted for each row."""
    zero = F.lit(0).cast("long")
    return F.when(a.isNotNull() & b.isNotNull(), _gcd(F.coalesce(a.cast("long"), zero), F.coalesce(b.cast("long"), zero)))


def lcm(a: Column, b: Column) -> Column:
    """0 if either is 0; whole numbers all through, so one beyond 64 bits is an error."""
    a, b = a.cast("long"), b.cast("long")
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a, F.nullif(gcd(a, b), F.lit(0).cast("long"))) * b))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def log(x: Column, base: float | None = None) -> Column:
    """Base 10, or the base that is given."""
    return F.log10(x) if base is None else F.log(float(base), x)
