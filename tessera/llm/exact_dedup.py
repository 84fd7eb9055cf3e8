"""Exact deduplication by progressive refinement: length, then the hash of a prefix, then the hash of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, small_or_shuffled, table, written

#: Characters that don't count.
SPACES = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 256


def squeezed(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_col: str | None = None) -> DataFrame:
    """(id_col, keep_id, group_size, kept): texts are equal when they are so without white space.

    Of equal texts, the row with the most code points stays, then that with the smallest id.
    Null and empty texts are one group. A null id sorts last; rows that repeat an id and its text are all counted, and share one
    verdict. Other columns are not read. An empty table gives an empty result. digest_col adds each row's hash of its whole text under that name;
    then every row has one verdict, also where texts of one id agree in length and prefix.
    """
    row = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), squeezed(F.col(text_col)).alias("t"))
    row = row.select("id", "points", "t", F.length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("head"))
    sizes = written(row.withColumn("digest", F.sha2("t", 256)).drop("t") if digest_col else row.drop("t"), "dedup-sizes")
    # 1: lengths that more than one row has; 2: among those, prefixes that more than one row has. Only numbers move.
    lens = sizes.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    same_len = salted_join(sizes, lens, ["len"], "left_semi", F.col("id"))
    heads = same_len.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "head")
    left = written(salted_join(same_len, heads, ["len", "head"], "left_semi", F.col("id")).select("id").distinct(), "dedup-left")
    # 3: whole texts are hashed for the rows that are left. A large rest is joined by a shuffle of ids and hashes, not of texts.
    ids, small = small_or_shuffled(left)
    whole = lambda d: d.select("id", "points", "len", "head", F.sha2("t", 256).alias("hash"))
    on = row["id"].eqNullSafe(ids["id"])
    hashed = whole(row.join(ids, on, "left_semi")) if small else (h := whole(row)).join(ids, h["id"].eqNullSafe(ids["id"]), "left_semi")
    hashed = written(hashed, "dedup-hashes")
    best = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("i"))).alias("best")).where("group_size > 1")
    groups = salted_join(hashed, best.select("hash", "group_size", F.col("best.i").alias("keep_id")), ["hash"], "inner", F.col("id")).select(F.col("id").alias("gid"), F.col("len").alias("glen"), F.col("head").alias("ghead"), *([F.col("hash").alias("ghash")] if digest_col else []), "keep_id", "group_size").distinct()
    # an id that repeats with different texts has a verdict for each
    met = sizes["id"].eqNullSafe(groups["gid"]) & (F.col("len") == F.col("glen")) & (F.col("head") == F.col("ghead"))
    out = sizes.join(groups, met & (F.col("digest") == F.col("ghash")) if digest_col else met, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *([F.col("digest").alias(digest_col)] if digest_col else []),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The verdict on every row of documents, null and repeated doc_ids included, with the hash of its whole text."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest_col="text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
h AS (SELECT doc_id, length(raw) AS points, sha256(s) AS text_sha256 FROM t)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM h
"""
