"""Row-level security: filters that a table is always read and written through."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """using says which rows are seen, check which may be written (using, if it is missing); commands and roles it is for (none named: all)."""

    using: Column
    check: Column | None = None
    commands: tuple[str, ...] = ("select", "insert", "update", "delete")
    roles: tuple[str, ...] = ()
    restrictive: bool = False


@dataclass
class Secured:
    """A table with policies: permissive ones are joined by OR, restrictive ones by AND; none that applies means no rows. The owner sees all, unless it is forced."""

    table: DataFrame
    owner: str
    policies: list[Policy] = field(default_factory=list)
    forced: bool = False

    def _condition(self, role: str, command: str, write: bool) -> Column:
        if role == self.owner and not self.forced:
            return F.lit(True)
        mine = [p for p in self.policies if command in p.commands and (not p.roles or role in p.roles)]
        of = lambda p: F.coalesce(p.check if write and p.check is not None else p.using, F.lit(False))
        out = F.lit(False)
        for p in mine:
            out = out if p.restrictive else out | of(p)
        for p in mine:
            out = out & of(p) if p.restrictive else out
        return out

    def read(self, role: str, command: str = "select") -> DataFrame:
        return self.table.where(self._condition(role, command, False))

    def refused(self, role: str, rows: DataFrame, command: str = "insert") -> DataFrame:
        """New rows that no policy lets the role write."""
        return rows.where(~self._condition(role, command, True))
