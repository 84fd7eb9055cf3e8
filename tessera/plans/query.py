"""A registered query: Spark SQL over the tables of a folder, or a function of them, and its SQL on DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import TABLES, read_table


class Tables:
    """Tables of a folder by name, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.folder, name)


@dataclass(frozen=True)
class Query:
    plan: str | Callable[[Tables], DataFrame]
    oracle: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        if callable(self.plan):
            return self.plan(Tables(spark, folder))
        # only the named tables are read, and no view is left behind under their plain names
        frames = {n: read_table(spark, folder, n) for n in TABLES if re.search(rf"\b{n}\b", self.plan)}
        text = re.sub(r"\b(" + "|".join(frames) + r")\b(?!\s*\()", r"{\1}", re.sub(r"([{}])", r"\1\1", self.plan)) if frames else self.plan
        return spark.sql(text, **frames) if frames else spark.sql(text)


def same(sql: str) -> Query:
    """A query whose text both engines read alike."""
    return Query(sql, sql)
