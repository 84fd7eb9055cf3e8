"""All registered queries, each beside the SQL that says the same on DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import benchmark, functions, relational, statements

MODULES = [benchmark, relational, functions, statements]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q.oracle for m in MODULES for name, q in m.QUERIES.items() if q.oracle}
