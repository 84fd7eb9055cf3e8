"""Row-level statements as functions of tables: each gives the table as it is afterwards; RETURNING is the changed part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A row of one side matches more than one of the other where one is allowed."""


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns that rows lacks get their default, or NULL."""
    d = defaults or {}
    full = rows.select(*[(rows[c] if c in rows.columns else d.get(c, F.lit(None))).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return target.unionByName(full)


def insert_or_nothing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: new keys only, one row of each."""
    new = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], sets: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE; REPLACE INTO without sets. sets and where name target's columns t.c and those of rows excluded.c. A key twice in rows raises an error."""
    if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CardinalityError("a key is given twice")
    t, x = target.alias("t").withColumn("_old", F.lit(True)).alias("t"), rows.withColumn("_new", F.lit(True)).alias("excluded")
    on = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys]
    both = t.join(x, on, "full")
    hit = F.col("_old") & F.col("_new") if where is None else F.col("_old") & F.col("_new") & F.coalesce(where, F.lit(False))
    sets = {c: F.col(f"excluded.{c}") for c in target.columns} if sets is None else sets
    return both.select(*[F.when(F.col("_old").isNull(), F.col(f"excluded.{c}")).when(hit, sets.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns])


def update(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: dict[str, str], sets: dict[str, Column], first: list[Column]) -> DataFrame:
    """UPDATE ... FROM by equal keys (target column -> source column); of several matching rows that which comes first. sets name t.c and s.c."""
    w = Window.partitionBy(*keys.values()).orderBy(*first)
    one = source.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").withColumn("_hit", F.lit(True)).alias("s")
    both = target.alias("t").join(one, [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()], "left")
    return both.select(*[(F.when(F.col("_hit"), sets[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType) if c in sets else F.col(f"t.{c}")).alias(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """Rows stay for which the condition is false or NULL."""
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, keys: dict[str, str]) -> DataFrame:
    return target.alias("t").join(source.alias("s"), [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()], "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: dict[str, str], matched: dict[str, Column] | str | None = None, missing: dict[str, Column] | None = None) -> DataFrame:
    """MERGE: matched is sets, "delete" or nothing; missing says what is inserted. Either side matching two rows of the other raises an error."""
    t, s = target.withColumn("_old", F.lit(True)).alias("t"), source.withColumn("_new", F.lit(True)).alias("s")
    hits = target.select(*[F.col(a).alias(f"_{i}") for i, a in enumerate(keys)]).join(source.select(*[F.col(b).alias(f"_{i}") for i, b in enumerate(keys.values())]), [f"_{i}" for i in range(len(keys))])
    if hits.groupBy(*[f"_{i}" for i in range(len(keys))]).count().where("count > 1").limit(1).count():
        raise CardinalityError("a row matches more than one")
    both = t.join(s, [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()], "full")
    met, new = F.col("_old") & F.col("_new"), F.col("_old").isNull()
    if matched == "delete":
        both, matched = both.where(~F.coalesce(met, F.lit(False))), None
    if missing is None:
        both, missing = both.where("_old"), {}
    sets = matched or {}
    return both.select(*[F.when(new, missing.get(c, F.lit(None))).when(met, sets.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in target.columns])


def replace_into(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """REPLACE INTO: rows of the same keys go, the new ones come; of new rows that repeat their keys one stays."""
    return delete_using(target, rows, {k: k for k in keys}).unionByName(rows.dropDuplicates(keys).select(*target.columns))


def truncate(target: DataFrame) -> DataFrame:
    """Without rows, with its columns; RESTART IDENTITY is Sequences.restart, and CASCADE is truncate of the tables that refer to it."""
    return target.limit(0)


# RETURNING: the rows that a statement changed, as they are afterwards (deleted ones as they were)


def insert_returning(target: DataFrame, rows: DataFrame, *returning: Column, defaults: dict[str, Column] | None = None) -> DataFrame:
    return insert(target.limit(0), rows, defaults).select(*returning)


def update_returning(target: DataFrame, sets: dict[str, Column], where: Column, *returning: Column) -> DataFrame:
    return update(target.where(F.coalesce(where, F.lit(False))), sets).select(*returning)


def update_from_returning(target: DataFrame, source: DataFrame, keys: dict[str, str], sets: dict[str, Column], first: list[Column], *returning: Column) -> DataFrame:
    hit = target.alias("t").join(source.alias("s"), [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()], "left_semi")
    return update_from(hit, source, keys, sets, first).select(*returning)


def delete_returning(target: DataFrame, where: Column, *returning: Column) -> DataFrame:
    return target.where(F.coalesce(where, F.lit(False))).select(*returning)


def delete_using_returning(target: DataFrame, source: DataFrame, keys: dict[str, str], *returning: Column) -> DataFrame:
    return target.alias("t").join(source.alias("s"), [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()], "left_semi").select(*returning)
