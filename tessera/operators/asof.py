"""As-of join: each left row with the last right row of its key that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str) -> DataFrame:
    """left with right's other columns, from right's last row of the same by with at not after left's; NULL if there is none or a side's by or at is NULL.

    Both sides are sorted together by (by, at) once: the work is that of one sort, whatever the number of pairs that a condition on at would meet. Of right rows that
    tie the largest counts. Names of other columns must differ.
    """
    own, more = [c for c in left.columns if c not in (by, at)], [c for c in right.columns if c not in (by, at)]
    a = left.select(by, at, F.lit(1).alias("_side"), F.struct(*own).alias("_left"), F.lit(None).cast(right.select(F.struct(*more)).schema[0].dataType).alias("_right"))
    b = right.where(F.col(at).isNotNull()).select(by, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*more).alias("_right"))
    w = Window.partitionBy(by).orderBy(F.col(at).asc_nulls_last(), "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    return out.select(by, at, "_left.*", *[F.when(known, F.col(f"_found.{c}")).alias(c) for c in more])
