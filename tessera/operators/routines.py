"""Routines: SQL expression functions, registered Python functions and aggregates, table functions, prepared statements, cursors, procedures, triggers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> Callable[..., Column]:
    """CREATE FUNCTION name(parameters) RETURNS returns RETURN body, in the session: the planner puts the body in the place of each call."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return lambda *args: F.call_function(name, *args)


def register_function(spark: SparkSession, name: str, fn: Callable[..., pd.Series], returns: str, volatility: str = "immutable") -> Callable[..., Column]:
    """A function of whole Arrow batches under a name that SQL knows; a volatile one is never folded or repeated by the planner."""
    if volatility not in ("immutable", "stable", "volatile"):
        raise ValueError(f"no volatility {volatility}")
    udf = F.pandas_udf(fn, returns)
    return spark.udf.register(name, udf.asNondeterministic() if volatility == "volatile" else udf)


def create_aggregate(spark: SparkSession, name: str, fn: Callable[[pd.Series], object], returns: str) -> Callable[..., Column]:
    """An aggregate of a group's values. A group's values meet in one Python worker: for large groups build on sum() and the like instead."""

    def whole(values: pd.Series) -> object:
        return fn(values)

    whole.__annotations__ = {"values": pd.Series, "return": float}
    return spark.udf.register(name, F.pandas_udf(whole, returns))


def table_function(spark: SparkSession, text: str, parameter: str, **tables: DataFrame) -> Callable[[object], DataFrame]:
    """A query with one named parameter (:name) as a function of it; {table} names tables."""
    return lambda value: spark.sql(text, args={parameter: value}, **tables)


class Prepared:
    """PREPARE: a text with ? or $1, $2 ...; execute() binds values, which are never read as SQL."""

    def __init__(self, spark: SparkSession, text: str, **tables: DataFrame):
        self.spark, self.tables = spark, tables
        self.text = re.sub(r"\$(\d+)", r":p\1", text)
        self.numbered = self.text != text

    def execute(self, *values: object) -> DataFrame:
        args = {f"p{i}": v for i, v in enumerate(values, 1)} if self.numbered else list(values)
        return self.spark.sql(self.text, args=args, **self.tables)


class Cursor:
    """DECLARE, FETCH, MOVE and CLOSE forward: the driver holds one partition at a time."""

    def __init__(self, df: DataFrame):
        self.rows: Iterator[Row] | None = df.toLocalIterator()

    def fetch(self, n: int = 1) -> list[Row]:
        if self.rows is None:
            raise ValueError("the cursor is closed")
        return [r for _, r in zip(range(n), self.rows)]

    def move(self, n: int = 1) -> int:
        """How many rows were passed over."""
        return len(self.fetch(n))

    def close(self) -> None:
        self.rows = None


class Procedures:
    """CREATE PROCEDURE and CALL: named callables of the driver."""

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def create(self, name: str, body: Callable, replace: bool = False) -> None:
        if name in self.known and not replace:
            raise ValueError(f"{name} exists")
        self.known[name] = body

    def call(self, name: str, *args: object) -> object:
        if name not in self.known:
            raise LookupError(name)
        return self.known[name](*args)


class Triggers:
    """Triggers of a table. BEFORE of rows rewrites the changed rows (or leaves some out, by where), INSTEAD OF takes the statement's place, AFTER sees old table and new."""

    def __init__(self):
        self.known: list[tuple[str, str, Callable, Column | None]] = []

    def create(self, when: str, event: str, body: Callable, condition: Column | None = None) -> None:
        if when not in ("before", "after", "instead") or event not in ("insert", "update", "delete", "truncate"):
            raise ValueError(f"no trigger {when} {event}")
        self.known.append((when, event, body, condition))

    def run(self, event: str, target: DataFrame, rows: DataFrame, statement: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The table after statement(target, rows), with the triggers of event in the order in which they were made."""
        mine = lambda w: [(b, c) for when, e, b, c in self.known if when == w and e == event]
        for body, condition in mine("before"):
            if condition is None:
                rows = body(rows)
            else:
                hit = F.coalesce(condition, F.lit(False))
                rows = body(rows.where(hit)).unionByName(rows.where(~hit))
        instead = mine("instead")
        out = statement(target, rows) if not instead else target
        for body, _ in instead:
            out = body(out, rows)
        for body, _ in mine("after"):
            body(target, out)
        return out
