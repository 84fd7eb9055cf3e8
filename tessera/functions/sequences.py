"""Sequences: numbers are allotted on the driver, in blocks for whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Sequences:
    def __init__(self):
        self.all: dict[str, dict] = {}
        self.last: int | None = None

    def create(self, name: str, start: int = 1, increment: int = 1) -> None:
        self.all[name] = {"next": start, "by": increment, "now": None, "start": start}

    def restart(self, name: str) -> None:
        """TRUNCATE ... RESTART IDENTITY: the next value is the first again."""
        self.all[name] |= {"next": self.all[name]["start"]}

    def nextval(self, name: str) -> int:
        s = self.all[name]
        s["now"], s["next"] = s["next"], s["next"] + s["by"]
        self.last = s["now"]
        return s["now"]

    def currval(self, name: str) -> int:
        if self.all[name]["now"] is None:
            raise LookupError(f"{name} has given no value yet")
        return self.all[name]["now"]

    def lastval(self) -> int:
        if self.last is None:
            raise LookupError("no sequence has given a value yet")
        return self.last

    def setval(self, name: str, value: int) -> int:
        self.all[name] |= {"now": value, "next": value + self.all[name]["by"]}
        return value

    def number(self, df: DataFrame, name: str, column: str, key: str, parts: int = 64) -> DataFrame:
        """Each row's value in the order of a numeric key. Bounds of the key cut the table into parts by value; a part's numbers begin after those of the parts before, so that no task has all rows."""
        s = self.all[name]
        bounds = sorted({*(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)])).first()[0] or [])})
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
        cut = df.withColumn("_p", part)
        base, total = {}, 0
        for p, n in sorted(tuple(r) for r in cut.groupBy("_p").count().collect()):
            base[p], total = total, total + n
        before = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else F.create_map(F.lit(0), F.lit(0))
        nth = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1 + before[F.col("_p")]
        first = s["next"]
        s["next"] += total * s["by"]
        if total:
            s["now"] = self.last = s["next"] - s["by"]
        return cut.withColumn(column, (F.lit(first) + nth * s["by"]).cast("long")).drop("_p")
