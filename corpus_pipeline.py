"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, ngram_join, packing, secrets, toxicity
from tessera.llm.common import scratch, small_or_shuffled, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a noisy-or score of 0.5 or more go. Weights are fitted to the labels that sf_dir has for docs.

    Null texts count as empty; rows that repeat are scored alike; without labels nothing goes; no rows give no rows.
    """
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go from their documents; a document that has no line left goes.

    Null and empty texts stay as they are; rows that repeat an id and its text have one place in the order and stay alike; no rows give no rows.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return _sized(out.where("n_removed < n_lines OR n_lines = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles are similar by 0.8 or more, the one with the smallest id stays.

    Texts without words and rows without an id stay; rows that repeat an id are one document and stay or go together; no rows give no rows.
    """
    found = ngram_join.near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"))
    # texts are shuffled only where the ids that go are too many to send to every worker
    goers, _ = small_or_shuffled(written(found.where("id <> component_id").select(F.col("id").alias("doc_id")), "pipeline-goers"))
    return docs.select(*COLUMNS).join(goers, "doc_id", "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets become [SECRET]. Null texts stay null; rows that repeat are redacted alike; no rows give no rows."""
    d = secrets.scan(docs.select(F.col("doc_id").alias("id"), "text", "lang", "source", F.col("text").isNull().alias("none")), keep=("lang", "source", "none"))
    text = F.when(F.col("none"), F.lit(None)).when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return _sized(d.select(F.col("id").alias("doc_id"), text.alias("text"), "lang", "source"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, with their tokens. A null text is its end token alone; rows that repeat are documents of their own; no rows give no pieces."""
    return packing.packed(docs.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_duplicates), ("secret_scans", redact_secrets), ("packing", pack)]
#: Learned scores and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each from the Parquet files that the one before wrote in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
