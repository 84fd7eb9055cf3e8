"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only.

A line goes if an earlier one is equal, or, for lines of MIN_CHARS characters at least, within one edit (insertion, deletion or substitution of a character);
the earliest stays. Order is by document id, then place in the text. On shorter lines one edit makes another word, so there only equal ones go; empty
lines stay, as they set paragraphs apart.

Emitting every deletion variant of every line would cost the square of its length, so variants are emitted where an edit can be:
lines x and y within one edit agree before and after one block of the shorter line. Lines that agree with no other outside either
half (key: place, length of the shorter one, hash of the rest) have no partner; of the rest, those that agree outside a block of
BLOCK characters go on; in such a block all variants are emitted as hashed keys. A variant's key holds what stands around the block and
the place of the deleted character, so that rows with equal keys are within one edit of each other, whatever their number: each is
joined with the earliest of its key only, and verified: equal outside the block, levenshtein() of the blocks.

A line is cut into blocks once, and what stands around a block is a running combination of the blocks' hashes, so work grows with a line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound, running, salted_join, small_or_shuffled, table, written

#: The shortest lines of which near repeats go too.
MIN_CHARS = 20
BLOCK = 32
#: What is cut from both ends of a line before it is compared.
TRIM = " \t\x0b\x0c\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, row, pos, line): a row each line; row tells rows apart that repeat an id."""
    d = docs.select(F.col("id").alias("doc"), F.xxhash64("text").alias("row"), "text").where("text IS NOT NULL")
    return d.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).select("doc", "row", "pos", F.trim("raw", F.lit(TRIM)).alias("line"))


def hashed(line: Column) -> list[Column]:
    """128 bits of a line: two chained hashes with different beginnings."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _half_keys(size: str, line: str) -> Column:
    """For m = size and size - 1, the length of the shorter line of a pair: what is left without either half."""
    each = []
    for m in (F.col(size), F.col(size) - 1):
        each += [F.xxhash64(m, F.lit(0), F.left(F.col(line), F.ceil(m / 2).cast("int"))), F.xxhash64(m, F.lit(1), F.right(F.col(line), F.floor(m / 2).cast("int")))]
    return F.array(*each)


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that more than one line has; only two lines' hashes of each key are kept on the way."""
    return rows.groupBy("key").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a <> b").select("key")


def _around(line: str, block: int) -> Column:
    """For m = the line's length and that less one, the length of the shorter line of a pair: (m, j, key, x) of each block j of the shorter line.

    key is the hash of what stands before and after the block, x what this line has in its place. Blocks of the longer line that come after an
    edit begin one character later, so a second cut begins there.
    """
    pieces = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    coded = lambda a: F.transform(a, lambda x, i: F.xxhash64(i, x))
    xor = lambda a, b: a.bitwiseXOR(b)
    zero = F.lit(0).cast("bigint")
    size = F.length(line)
    both = F.struct(pieces(F.col(line)).alias("p"), coded(pieces(F.col(line))).alias("h"), coded(pieces(F.substring(line, 2, 2**31 - 1))).alias("late"))

    def blocks(v: Column, longer: bool) -> Column:
        m = size - 1 if longer else size
        last = F.floor((m - 1) / block).cast("int")
        after = v["late"] if longer else v["h"]
        whole = F.aggregate(after, zero, xor)
        sums = F.struct(running(v["h"], zero, xor).alias("pre"), running(after, zero, xor).alias("mid"), whole.alias("all"), v["p"].alias("p"), after.alias("after"))
        # what comes after block j: all hashes, less those up to it
        rest = lambda s, j: s["all"].bitwiseXOR(F.get(s["mid"], j)).bitwiseXOR(F.get(s["after"], j))
        x = lambda s, j: F.concat(F.get(s["p"], j), F.left(F.coalesce(F.get(s["p"], j + 1), F.lit("")), F.lit(1))) if longer else F.get(s["p"], j)
        return bound(sums, lambda s: F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(m.alias("m"), j.alias("j"), F.xxhash64(m, j, F.get(s["pre"], j).bitwiseXOR(rest(s, j))).alias("key"), x(s, j).alias("x"))))

    return bound(both, lambda v: F.concat(blocks(v, False), blocks(v, True)))


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """docs(id, text) -> occurrences(doc, row, pos, h1, h2) of lines that are not empty, and lines(h1, h2, first, n, near).

    first is the earliest occurrence of a line, n counts them, near says that an earlier line is within one edit (both of min_chars at least).
    """
    every = lines_of(docs).where("line <> ''")
    least = max(min_chars, 2)
    # the hashes of both halves are taken on the way, so that only numbers are shuffled
    keys = F.when(F.length("line") >= least, _half_keys("size", "line"))
    occ = written(every.select("doc", "row", "pos", *hashed(F.col("line")), F.length("line").alias("size"), "line").select("doc", "row", "pos", "h1", "h2", "size", keys.alias("keys")), "lines")
    at = F.struct(F.col("doc").isNull().alias("z"), "doc", "pos", "row")
    lines = written(occ.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), F.min("keys").alias("keys")), "lines-distinct")
    halves = lines.select("h1", "h2", F.explode("keys").alias("key"))
    left = salted_join(halves, _shared(halves), ["key"], "left_semi", F.struct("h1", "h2")).select("h1", "h2").distinct()
    left = written(lines.select("h1", "h2", "first").join(left, ["h1", "h2"], "left_semi").select("h1", "h2", "first"), "lines-left")
    # the texts of the lines that are left, each from its first occurrence
    wanted, _ = small_or_shuffled(left.select("h1", "h2", F.col("first.doc").alias("d"), F.col("first.pos").alias("p"), F.col("first.row").alias("r")))
    texts = every.join(wanted, every["doc"].eqNullSafe(wanted["d"]) & (every["pos"] == wanted["p"]) & (every["row"] == wanted["r"]))
    texts = written(texts.select("h1", "h2", "line").dropDuplicates(["h1", "h2"]), "lines-texts")
    blocks = texts.select("h1", "h2", F.length("line").alias("size"), F.explode(_around("line", block)).alias("b")).select("h1", "h2", "b.m", "b.j", "size", "b.key", "b.x").where(F.col("m") >= least)
    blocks = written(blocks, "lines-blocks")
    blocks = salted_join(blocks, _shared(blocks), ["key"], "left_semi", F.struct("h1", "h2"))
    without = lambda i: F.concat(F.left("x", i - 1), F.substring("x", i + 1, F.length("x")))
    ends = F.sequence(F.lit(1), F.length("x"))
    same = F.col("m") == F.col("size")
    # kind 0: one character each is deleted at the same place; 1: the shorter line whole, and the longer one without a character
    variants = F.when(same, F.concat(F.transform(ends, lambda i: F.xxhash64("key", F.lit(0), i, without(i))), F.array(F.xxhash64("key", F.lit(1), "x")))).otherwise(F.array_distinct(F.transform(ends, lambda i: F.xxhash64("key", F.lit(1), without(i)))))
    rows = blocks.select("h1", "h2", "m", "j", same.alias("short"), F.explode(variants).alias("key")).join(left, ["h1", "h2"])
    rows = written(rows.select("key", "m", "j", "short", "h1", "h2", "first"), "lines-variants")
    # the earliest of a key, for all; the earliest whole one, for those that were cut: what is cut in two places may differ by two edits
    early = F.min(F.struct("first", "h1", "h2"))
    best = rows.groupBy("key").agg(early.alias("any"), F.min(F.when(F.col("short"), F.struct("first", "h1", "h2"))).alias("whole"), F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a <> b")
    pairs = salted_join(rows, best.select("key", "any", "whole"), ["key"], "inner", F.struct("h1", "h2"))
    pick = F.when(F.col("short"), F.col("any")).otherwise(F.col("whole"))
    pairs = pairs.select("h1", "h2", "m", "j", "first", pick.alias("o")).where("o.first < first").select("h1", "h2", "m", "j", F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2")).distinct()
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    # m is the length of the shorter line: both agree before the block and, counted from the end, after it
    start = F.col("j") * block
    after = F.greatest(F.col("m") - start - block, F.lit(0))
    cut = lambda t: F.substring(t, start + 1, F.length(t) - start - after)
    agree = (F.left("line", start) == F.left("other", start)) & (F.right("line", after) == F.right("other", after)) & (F.levenshtein(cut("line"), cut("other"), 1) >= 0)
    near = pairs.join(texts, ["h1", "h2"]).join(other, ["o1", "o2"]).where(agree).select("h1", "h2", F.lit(True).alias("near")).distinct()
    lines = lines.drop("keys").join(written(near, "lines-near"), ["h1", "h2"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return occ.drop("keys", "size"), lines


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines gone that repeat an earlier line of the corpus, or are within one edit of one; with n_lines and n_removed.

    Of lines shorter than min_chars code points (ends trimmed) only equal ones go; empty lines stay. All columns of docs are returned, text_col with the lines that stay.
    Null text stays null, with no lines; empty text is one empty line. A null id comes last in the order. Rows that repeat an id and its text
    have one place in the order, and what one keeps the other keeps. A clash of docs' columns with n_lines or n_removed is solved by theirs
    being replaced. No rows give no rows. A line's length has no bound; all lines of one text are one row.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    occ, lines = near_lines(plain, min_chars)
    goers = lines.where("near OR n > 1").select("h1", "h2", "first", "near")
    at = F.struct(F.col("doc").isNull().alias("z"), "doc", "pos", "row")
    gone = salted_join(occ, goers, ["h1", "h2"], "inner", F.struct("doc", "pos")).where(F.col("near") | (at != F.col("first")))
    gone = written(gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone")).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone")), "lines-gone")
    gone, _ = small_or_shuffled(gone, 64 + 4 * F.size("_gone"))
    out = docs.select(*[docs[c] for c in own], F.xxhash64(docs[text_col]).alias("_hash"))
    out = out.join(gone, out[id_col].eqNullSafe(gone["_doc"]) & (out["_hash"] == gone["_row"]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    # stretches of lines between those that go
    edges = lambda p: F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(p)))
    stay = lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["e"]) - 2), lambda k: F.slice(s["p"], F.get(s["e"], k) + 2, F.get(s["e"], k + 1) - F.get(s["e"], k) - 1)))
    rest = bound(parts, lambda p: bound(F.struct(p.alias("p"), edges(p).alias("e")), stay))
    kept = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts))
    return out.select(*[kept.alias(c) if c == text_col else F.col(c) for c in own], n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """documents without their repeated lines; the columns and odd rows are those of line_dedup."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos FROM d),
o AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM x),
t AS (SELECT line, length(line) AS m, min((doc_id, pos)) AS first FROM o WHERE line <> '' GROUP BY line),
k AS (SELECT line, m, first, unnest([CAST(m AS VARCHAR) || 'p' || left(line, CAST(ceil(m / 2) AS INT)), CAST(m AS VARCHAR) || 's' || right(line, CAST(floor(m / 2) AS INT)),
             CAST(m - 1 AS VARCHAR) || 'p' || left(line, CAST(ceil((m - 1) / 2) AS INT)), CAST(m - 1 AS VARCHAR) || 's' || right(line, CAST(floor((m - 1) / 2) AS INT))]) AS k FROM t WHERE m >= 20),
near AS (SELECT DISTINCT a.line FROM k a JOIN k b ON a.k = b.k AND b.first < a.first AND abs(a.m - b.m) <= 1
         WHERE EXISTS (SELECT 1 FROM range(0, CAST(a.m AS BIGINT) + 1) r(i)
                       WHERE CASE WHEN a.m = b.m THEN left(a.line, CAST(i AS INT)) = left(b.line, CAST(i AS INT)) AND (i = a.m OR right(a.line, CAST(a.m - i - 1 AS INT)) = right(b.line, CAST(a.m - i - 1 AS INT)))
                                  WHEN a.m > b.m THEN left(a.line, CAST(i AS INT)) = left(b.line, CAST(i AS INT)) AND (i <= b.m AND right(a.line, CAST(b.m - i AS INT)) = right(b.line, CAST(b.m - i AS INT)))
                                  ELSE left(a.line, CAST(i AS INT)) = left(b.line, CAST(i AS INT)) AND (right(a.line, CAST(a.m - i AS INT)) = right(b.line, CAST(a.m - i AS INT))) END)),
g AS (SELECT o.doc_id, o.pos FROM o JOIN t USING (line) LEFT JOIN near n USING (line) WHERE n.line IS NOT NULL OR (o.doc_id, o.pos) <> t.first),
s AS (SELECT x.doc_id, string_agg(x.raw, chr(10) ORDER BY x.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(*) AS n_lines, count(g.pos) AS n_removed
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.kept, '') END AS text, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed
FROM d LEFT JOIN s USING (doc_id)
"""
