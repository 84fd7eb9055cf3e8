"""CSV in and out, large objects, and tables of the catalog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Times in files, to the microsecond.
TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def load_data(spark: SparkSession, path: str, schema: StructType, delimiter: str = ",", quote: str = '"', escape: str = '"', null: str = "", header: bool = True) -> DataFrame:
    """LOAD DATA INFILE and COPY FROM: the first line names columns. The schema is given, so that the file is read once."""
    return spark.read.options(timestampFormat=TIMES, timestampNTZFormat=TIMES).csv(path, schema=schema, header=header, sep=delimiter, quote=quote, escape=escape, nullValue=null)


def into_outfile(df: DataFrame, path: str, delimiter: str = ",", null: str = "") -> None:
    """SELECT INTO OUTFILE and COPY TO."""
    df.write.options(timestampFormat=TIMES, timestampNTZFormat=TIMES).csv(path, header=True, sep=delimiter, nullValue=null, escape='"', mode="overwrite")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one that driver and executors share; of this machine only where they are one process and the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, delimiter: str = ",", null: str = "\\N") -> DataFrame:
    """A table written by INTO OUTFILE and read back by LOAD DATA with its own schema."""
    path = shared_folder(df.sparkSession, "outfile")
    into_outfile(df, path, delimiter, null)
    return load_data(df.sparkSession, path, df.schema, delimiter, null=null)


def large_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def create_table_as(df: DataFrame, name: str) -> None:
    df.write.saveAsTable(name)


def refresh_materialized_view(df: DataFrame, name: str, data: bool = True) -> None:
    """Computes a materialized view anew; WITH NO DATA leaves it empty."""
    (df if data else df.limit(0)).write.mode("overwrite").saveAsTable(name)


def information_schema_columns(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal_position, data_type) of named frames, from their schemas alone."""
    rows = [(t, f.name, i, f.dataType.simpleString()) for t, df in frames.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string")


def information_schema_tables(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([("public", t, "BASE TABLE") for t in frames], "table_schema string, table_name string, table_type string")


def pg_class(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(oid, relname, relkind, relnatts): tables by number, with their columns counted."""
    return spark.createDataFrame([(i, t, "r", len(df.columns)) for i, (t, df) in enumerate(frames.items(), 16384)], "oid long, relname string, relkind string, relnatts int")


def pg_attribute(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(attrelid, attname, attnum, attnotnull) of the tables of pg_class."""
    rows = [(i, f.name, k, not f.nullable) for i, df in enumerate(frames.values(), 16384) for k, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "attrelid long, attname string, attnum int, attnotnull boolean")


def inherited(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """A parent's scan with its children's rows, in the parent's columns; ONLY is the parent itself."""
    out = parent
    for c in children:
        out = out.unionByName(c.select(*parent.columns))
    return out


def partition_of(df: DataFrame, kind: str, column: str, bounds: list) -> DataFrame:
    """The number of the partition of each row: RANGE by upper bounds, LIST by lists of values, HASH by a count. -1 is DEFAULT."""
    c = F.col(column)
    if kind == "hash":
        return df.withColumn("part", F.pmod(F.hash(c), F.lit(bounds[0])))
    out = F.lit(-1)
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(c.isin(*b) if kind == "list" else c < F.lit(b), F.lit(i)).otherwise(out)
    return df.withColumn("part", out)
