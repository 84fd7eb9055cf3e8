"""What the corpus operators share: reading tables, the shared folder, joins that hot keys don't stall, running sums inside a row."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes that the numbers of a broadcast side may have, before Spark's own overhead.
BROADCAST_BYTES = 24_000_000
#: Bytes of an Arrow batch: what a task's JVM and its Python worker hold of the rows at once, but for a row that is longer.
BATCH_BYTES = 2**22
#: The fewest parts that a table is thought of as dealt to: a key is hot if it has more rows than such a part.
PARTS = 256
#: Rows under which a key is never hot, and the most tasks that the rows of one key are dealt to.
COLD_ROWS = 2000
MOST_SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), with its scheme.

    A folder of this machine is made only where the session names none and driver and executors are one process; a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:  # a bare path lies in the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if found.startswith("file:/") and not found.startswith("file://"):
            found = "file://" + found[5:]
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def byte_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session sends Python workers batches of so many bytes, not only of a number of rows, whose texts may be of any length; a session that has set this bound keeps its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and a lost executor costs only the reading of its files again. Its rows are counted on the way."""
    path, seen = scratch(df.sparkSession, label), Observation()
    byte_batches(df.sparkSession)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.rows_written = seen.get["n"]
    return out


def row_count(df: DataFrame) -> int:
    """Of a written table without a job, of others by one."""
    known = getattr(df, "rows_written", None)
    return df.count() if known is None else known


def hot_buckets(rows: DataFrame, keys: list[str]) -> tuple[int, dict[int, int]]:
    """The number of buckets that keys are hashed to, and the number of salts of each hot one.

    A bucket is hot if it has more rows than an even part of the table. So few are hot, whatever the table's size, and one that is has a hot
    key. Counts are taken over all rows; the driver gets one number a bucket.
    """
    parts = max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 16 * parts
    counts = {r.b: r.n for r in rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return buckets, {b: min(MOST_SALTS, math.ceil(n * parts / total)) for b, n in counts.items() if n > COLD_ROWS and n * parts > total}


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, counted: DataFrame | None = None) -> DataFrame:
    """left joined to right, the left rows of hot keys dealt to several tasks; only right rows of hot buckets are repeated for the salts.

    Keys are counted on left, or on counted where that is a written table with the same keys and left is not.
    """
    counted = left if counted is None else counted
    buckets, hot = (0, {}) if getattr(counted, "rows_written", COLD_ROWS + 1) <= COLD_ROWS else hot_buckets(counted, keys)
    if not hot:
        return left.join(right, keys, how)
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in sorted(hot.items()) for x in item]), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), F.lit(1))
    one = left.withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return one.join(each, [*keys, "_salt"], how).drop("_salt")


def small_or_shuffled(df: DataFrame, row_bytes: Column | int = 96, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """A written table with a broadcast hint if its rows' summed bytes are within the limit, else without: either way no row is dropped."""
    size = row_count(df) * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return (F.broadcast(df) if size <= limit else df), size <= limit


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: what stands in a lambda's body is computed for each element otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, plus: Callable[[Column, Column], Column], kind: str = "bigint", block: int = 256) -> Column:
    """Of an array, for each place the sum (by plus) of all values before it.

    Appending to an array copies it, so sums are appended within blocks, and then over the blocks.
    """
    empty = F.expr(f"CAST(array() AS array<{kind}>)")

    def sums(a: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(zero.cast(kind).alias("at"), empty.alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct(plus(s["at"], of(x)).cast(kind).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))

    def whole(a: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda k: F.slice(a, k * block + 1, F.lit(block)))
        return bound(F.transform(cut, lambda b: sums(b, lambda x: x)), lambda parts: bound(sums(parts, lambda p: p["at"])["out"], lambda base: F.flatten(F.zip_with(parts, base, lambda p, b: F.transform(p["out"], lambda x: plus(b, x).cast(kind))))))

    return bound(values, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(empty))


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of the nodes of links(a, b), component being the smallest node that is reachable.

    Alternating large-star and small-star steps: each is one aggregation by node and one join that deals out hubs, so that neither a hub nor
    a large component is gathered anywhere. Every step is a written table. Ends when a step changes nothing; steps grow with the logarithm of the nodes.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    if not row_count(edges):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    last = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # every larger neighbour of a node is hung on the smallest neighbour
        large = written(salted_join(both.where("v > u"), low, ["u"], "inner", F.col("v"), edges.select("u").union(edges.select(F.col("v").alias("u"))) if row_count(edges) > COLD_ROWS else edges).select(F.col("v").alias("u"), F.col("m").alias("v")), label)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low2, ["u"], "inner", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), label)
