"""Array functions counted from 1, with PostgreSQL's NULLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(a: Column, i: int) -> Column:
    """From the end if negative; NULL outside and for 0."""
    return F.try_element_at(a, F.lit(i)) if i else F.lit(None)


def part(a: Column, low: int, high: int) -> Column:
    """Elements low to high, both included."""
    low = max(low, 1)
    return F.slice(a, low, max(high - low + 1, 0))


def array_length(a: Column, dim: int = 1) -> Column:
    return F.nullif(F.size(a) if dim == 1 else F.size(F.try_element_at(a, F.lit(1))), F.lit(0))


def cardinality(a: Column, dims: int = 1) -> Column:
    for _ in range(dims - 1):
        a = F.flatten(a)
    return F.size(a)


def array_ndims(a: Column) -> Column:
    """How many arrays are nested, which the type says; NULL for an empty one."""
    return F.when(F.size(a) > 0, (F.length(F.regexp_extract(F.typeof(a), "^(array<)*", 0)) / 6).cast("int"))


def array_lower(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


array_upper = array_length


def array_cat(a: Column, b: Column) -> Column:
    """The other one, if one is NULL."""
    return F.coalesce(F.concat(a, b), a, b)


def array_position(a: Column, x) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0).cast("long"))


def array_to_string(a: Column, sep: str, null: str | None = None) -> Column:
    text = F.transform(a, lambda x: x.cast("string"))
    return F.array_join(text, sep) if null is None else F.array_join(text, sep, null)


def string_to_array(s: Column, sep: str | None, null: str | None = None) -> Column:
    """Characters, if the separator is NULL; fields that equal null become NULL; '' has no fields."""
    parts = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)) if sep is None else F.array(s) if not sep else F.split(s, re.sub(r"([^\w\s])", r"\\\1", sep), -1)
    parts = parts if null is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)


def contains(a: Column, b: Column) -> Column:
    """a @> b: every element of b is one of a."""
    return F.size(F.array_except(b, a)) == 0


def contained(a: Column, b: Column) -> Column:
    """a <@ b."""
    return contains(b, a)


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)
