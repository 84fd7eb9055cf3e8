"""JSON text: steps, types, and building."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path(*steps: str | int) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def get(j: Column, *steps: str | int) -> Column:
    """-> and #>: the JSON text at a path."""
    return F.call_function("to_json", F.try_variant_get(F.try_parse_json(j), path(*steps), "variant"))


def get_text(j: Column, *steps: str | int) -> Column:
    """->> and #>>: unquoted; JSON null is NULL."""
    return F.get_json_object(j, path(*steps))


def typeof(j: Column) -> Column:
    """object, array, string, number, boolean or null; NULL for what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(j))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def array_length(j: Column) -> Column:
    return F.json_array_length(j)


def build_array(*xs: Column) -> Column:
    return F.to_json(F.array(*xs))


def build_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _within(small, large) -> bool:
    if isinstance(large, dict):
        return isinstance(small, dict) and all(k in large and _within(v, large[k]) for k, v in small.items())
    if isinstance(large, list):
        return isinstance(small, list) and all(any(_within(x, y) for y in large) for x in small)
    return type(small) is type(large) and small == large


@F.pandas_udf(T.BooleanType())
def contains(large: pd.Series, small: pd.Series) -> pd.Series:
    """large @> small: recursive, which no built-in says; NULL for what is no JSON."""

    def one(a, b):
        try:
            return None if a is None or b is None else _within(json.loads(b), json.loads(a))
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(large, small)], dtype=object)


@F.pandas_udf(T.StringType())
def pretty(j: pd.Series) -> pd.Series:
    """Indented by four; NULL for what is no JSON."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), indent=4, ensure_ascii=False)
        except ValueError:
            return None

    return j.map(one)
