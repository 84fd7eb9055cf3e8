"""Jaccard join of word n-gram sets by a grouped prefix join.

A set's n-grams are put in one order for all documents: by how often their bucket of a sketch was met in the corpus, then by hash. Two sets
that are similar enough share an n-gram of their prefixes, at places that leave room for the overlap that they need. Copies of a set are one class;
classes with one prefix and one size are one group, and groups stand in the postings for their members. Group pairs are filtered by size and
place and parity bits, expanded to members, and verified on whole texts.

A posting of m groups is not expanded to m * m pairs. First only neighbours in each posting are verified, then, while that finds links, all rows of
a posting with a few of its rows; connected components of the links so found make most postings one component. What is left are pairs in a posting
whose components still differ: each row that isn't in its posting's largest component meets all the others. So no link that joins two components can be missed, and what is
written is in proportion to postings, and to the pairs of documents that share a prefix n-gram without being linked in any way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_batches, components, row_count, salted_join, small_or_shuffled, table, written

#: Buckets of the sketch that orders n-grams: its size is fixed, 8 bytes a bucket, and it is sent to every worker.
BUCKETS = 2**20
CHUNKS = 64
#: Tasks that add up one chunk of it, before one adds up theirs.
SPREAD = 8
#: 64-bit words of a set's parity bits.
WORDS = 8
#: Rows of a posting's band of sizes that all its rows meet in a round, and the most rounds; what they leave is met in full, so the result doesn't depend on them.
PIVOTS = 4
ROUNDS = 2
#: The longest postings whose pairs are met without parity bits: so many pairs a row at most.
WIDE = 32


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted different hashes (64 bits) of a text's n-word sequences, A-Z in lower case; of all words, if they are fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' sets have an n-gram of each bucket. Counts are added up in parts by two streaming rounds; BUCKETS numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, salt = np.zeros(BUCKETS, dtype=np.int64), TaskContext.get().partitionId() % SPREAD
        for b in batches:
            texts = b.column(0)
            for i in range(0, len(texts), 256):
                total += np.bincount(np.concatenate([bucket(shingles(t, n)) for t in texts.slice(i, 256).to_pylist()]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array([x.tobytes() for x in np.split(total, CHUNKS)], pa.binary())], ["chunk", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for chunk, salt, counts in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(counts, dtype=np.int64)
                sums[chunk, salt] = sums[chunk, salt] + x if (chunk, salt) in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "salt", "counts"])

    schema = "chunk int, salt int, counts binary"
    part = docs.select("text").mapInArrow(count, schema).repartition("chunk", "salt").mapInArrow(add, schema)
    byte_batches(docs.sparkSession)
    rows = part.withColumn("salt", F.lit(0)).repartition("chunk").mapInArrow(add, schema).collect()
    out = np.zeros((CHUNKS, BUCKETS // CHUNKS), dtype=np.int64)
    for r in rows:
        out[r.chunk] = np.frombuffer(r.counts, dtype=np.int64)
    return out.reshape(-1)


def signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """docs(id, text) -> (id, size, set, pre, prefix, bits): hashes of the whole set and of its prefix, the prefix in order (binary, 64 bits each), and parity bits.

    A parity bit says whether an odd number of n-grams fall on it: two sets differ in at least as many n-grams as their bits differ in places.
    """
    order = docs.sparkSession.sparkContext.broadcast(sketch(docs, n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                own, out = b.slice(i, 1024), []
                for t in own.column(1).to_pylist():
                    h = shingles(t, n)
                    s = len(h)
                    first = h[np.lexsort((h, counts[bucket(h)]))[: s - -(-num * s // den) + 1]] if s else h
                    raw = first.tobytes()
                    odd = np.bincount((h % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
                    out.append((s, xxhash.xxh3_128_digest(h.tobytes()), xxhash.xxh3_128_digest(raw), raw, np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))))], ["id", "size", "set", "pre", "prefix", "bits"])

    return written(docs.select("id", "text").mapInArrow(work, "id long, size long, set binary, pre binary, prefix binary, bits array<long>"), "ngram-sets")


def postings(groups: DataFrame, num: int, den: int) -> DataFrame:
    """groups(gid, size, prefix) -> (token, gid, size, pos, prev, edge) of the n-grams in more than one group's prefix; prev is the group before in the posting, by size, if the two pass the filters.

    Rows are dealt out by ranges of (token, size, gid), so a frequent n-gram's posting lies in several tasks. A task can't see the row before its first one: that row is
    marked as edge, and both ends of a task stay whatever their neighbours are.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                own = b.slice(i, 2048)
                n = np.fromiter((len(x) // 8 for x in own.column(2).to_pylist()), np.int64, len(own))
                tokens = np.frombuffer(b"".join(own.column(2).to_pylist()), dtype=np.int64)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *(pa.array(np.repeat(own.column(c).to_numpy(), n)) for c in (0, 1)), pa.array(pos)], ["token", "gid", "size", "pos"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps rows whose token the row before or after has: one row waits for the next batch, and the row before it comes along, as its prev."""

        def out(cols: list[np.ndarray], done: int, first: bool, last: bool) -> tuple[pa.RecordBatch, list[np.ndarray], int]:
            """The rows after the first done ones, which were in the batch before."""
            token, gid, size, pos = cols
            same = np.append(False, token[1:] == token[:-1])
            keep = same | np.append(same[1:], last)
            edge = np.zeros(len(token), dtype=bool)
            keep[0] |= first
            edge[0] = first
            prev = np.append(-1, gid[:-1])
            small, px, py = np.append(0, size[:-1]), np.append(0, pos[:-1]), pos
            room = 1 + np.minimum(small - px - 1, size - py - 1)
            fit = same & (den * small >= num * size) & ((den + num) * room >= num * (small + size))
            end = len(token) if last else len(token) - 1
            k = done + np.flatnonzero(keep[done:end])
            batch = pa.RecordBatch.from_arrays([pa.array(x[k]) for x in cols] + [pa.array(prev[k], mask=~fit[k]), pa.array(edge[k])], ["token", "gid", "size", "pos", "prev", "edge"])
            return batch, [x[max(end - 1, 0) :] for x in cols], min(end, 1)

        held, done, first = None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            batch, held, now = out(cols, done, first, False)
            first, done = first and len(cols[0]) == 1, now
            yield batch
        if held is not None:
            yield out(held, done, first, True)[0]

    rows = groups.mapInArrow(spread, "token long, gid long, size long, pos long").repartitionByRange("token", "size", "gid").sortWithinPartitions("token", "size", "gid")
    return written(rows.mapInArrow(shared, "token long, gid long, size long, pos long, prev long, edge boolean"), "ngram-postings")


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) whose texts in docs(id, text) are similar enough. A text with many partners is dealt out with parts of them."""
    pairs = written(pairs, "ngram-pairs")
    if not row_count(pairs):
        return pairs
    need, _ = small_or_shuffled(written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ngram-need"))
    texts = written(docs.select("id", "text").join(need, "id", "left_semi"), "ngram-texts")
    many = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 128).cast("int").alias("parts")), "ngram-parts")
    left = texts.withColumnRenamed("id", "a").join(small_or_shuffled(many)[0], "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    # a text with many partners is on the side that small tables are sent to, or its pairs are dealt out
    right = pairs.join(many.where("parts > 1"), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("b").alias("id"))
    dealt, small = small_or_shuffled(written(right, "ngram-dealt"))
    right = texts.join(dealt, "id") if small else salted_join(dealt, texts, ["id"], "inner", F.col("a"))
    right = right.select("a", "part", F.col("id").alias("b"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                got = []
                for a, part, b, t in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns)):
                    if (a, part) != now:
                        now, sets = (a, part), []
                    h = shingles(t, n)
                    if b is None:
                        sets.append(h)
                        continue
                    for s in sets:
                        both = len(np.intersect1d(s, h, assume_unique=True))
                        if both and den * both >= num * (len(s) + len(h) - both):
                            got.append((a, b))
                            break
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], ["a", "b"])

    met = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(met.mapInArrow(work, "a long, b long"), "ngram-links")


def near(num: int, den: int) -> str:
    """Whether parity bits bx and by of sets of sx and sy n-grams leave room for a link."""
    differ = " + ".join(f"bit_count(bx[{i}] ^ by[{i}])" for i in range(WORDS))
    return f"{den + num} * ({differ}) <= {den - num} * (sx + sy)"


def by_bits(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b), a written table, that parity bits leave room for."""
    one = lambda v, w: bits.select(F.col("rep").alias(v), F.col("size").alias(f"s{w}"), F.col("bits").alias(f"b{w}"))
    met = salted_join(salted_join(pairs, one("a", "x"), ["a"], "inner", F.col("b")), one("b", "y"), ["b"], "inner", F.col("a"), pairs)
    return met.where(near(num, den)).select("a", "b")


def fits(num: int, den: int) -> str:
    """Whether x and y, of different components, pass the filters of size and place."""
    return f"cx <> cy AND {den} * least(sx, sy) >= {num} * greatest(sx, sy) AND {den + num} * (1 + least(sx - px - 1, sy - py - 1)) >= {num} * (sx + sy)"


def side(v: str) -> list[Column]:
    """A posting's row as one side of a pair."""
    return [F.col("rep").alias(v), *(F.col(c).alias(c[0] + v) for c in ("size", "pos", "comp"))]


def in_mixed_postings(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Those of rows(token, rep, size, pos), a written table, that are in postings with more than one component, with their own component, the posting's largest and its rows (comp, top, of)."""
    if not row_count(rows):
        return rows.withColumns({"comp": F.col("rep"), "top": F.col("rep"), "of": F.lit(0).cast("long")})
    placed = written(salted_join(rows, found, ["rep"], "left", F.col("token")).withColumn("comp", F.coalesce("comp", "rep")), "ngram-placed")
    tops = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("of"))
    tops = written(tops.where("comps > 1").select("token", F.col("top.comp").alias("top"), "of"), "ngram-tops")
    return written(salted_join(placed, tops, ["token"], "inner", F.col("rep")), "ngram-mixed")


def with_pivots(rows: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Each row of a posting beside PIVOTS rows that its band of sizes has drawn this turn: as many pairs as rows, times PIVOTS.

    Any two sizes of a band are close enough for a link; every other turn moves the bands by half their width.
    """
    rows = written(rows.withColumn("band", F.floor(F.log("size") / F.log(F.lit(den / num)) + F.lit(turn % 2 / 2))), "ngram-bands")
    drawn = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(i), "rep").alias("draw"), *side("y"))) for i in range(PIVOTS)]
    drawn = written(rows.groupBy("token", "band").agg(F.array_distinct(F.array(*drawn)).alias("drawn")), "ngram-drawn")
    met = salted_join(rows.select("token", "band", *side("x")), drawn, ["token", "band"], "inner", F.col("x"))
    return met.select("x", "sx", "px", "cx", F.inline("drawn"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found(rep, comp), components so far, with those joined that links(a, b) connect: components are taken of links between components only."""
    if not row_count(links):
        return found
    of = lambda v: found.select(F.col("rep").alias(v), F.col("comp").alias(f"c{v}"))
    ends = written(salted_join(links, of("a"), ["a"], "left", F.col("b")), "ngram-ends")
    ends = salted_join(ends, of("b"), ["b"], "left", F.col("a")).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(ends, "ngram-cc").select(F.col("node").alias("comp"), F.col("component").alias("to"))
    old = salted_join(found, moved, ["comp"], "left", F.col("rep")).select("rep", F.coalesce("to", "comp").alias("comp"))
    new = moved.select(F.col("comp").alias("rep"), F.col("to").alias("comp")).join(found.select("rep"), "rep", "left_anti")
    return written(old.union(new), "ngram-found")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs(id, text) -> (id, n_shingles, component_id): components of links between texts with Jaccard similarity num / den at least.

    component_id is the smallest id that links reach. Null and empty texts have no n-grams and are linked with nothing; nor are rows without an
    id, whose component_id is null. Rows that repeat an id are one node with the links of all of them. Other columns are not read. Copies are collapsed by
    128-bit hashes of their sets; n-grams are compared by 64-bit hashes. No rows give no rows.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    every = signed(docs, n, num, den)
    live = every.where("size > 0 AND id IS NOT NULL")
    classes = written(live.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("pre").alias("pre"), F.min("bits").alias("bits")), "ngram-classes")
    groups = written(classes.groupBy("size", "pre").agg(F.min(F.struct("rep", "set")).alias("lead"), F.count(F.lit(1)).alias("members")), "ngram-groups")
    leads = groups.select(F.col("lead.rep").alias("id"), F.col("lead.set").alias("own"))
    # rows that repeat an id may have other sets
    prefixes = salted_join(every.where("size > 0").select("id", "set", "size", "prefix"), leads, ["id"], "inner", F.col("set"), every)
    prefixes = prefixes.groupBy("id").agg(F.min(F.when(F.col("set") == F.col("own"), F.struct("size", "prefix"))).alias("p")).select(F.col("id").alias("gid"), "p.size", "p.prefix")
    posts = postings(prefixes, num, den)
    members = salted_join(classes, groups.where("members > 1").select("size", "pre", F.col("lead.rep").alias("gid")), ["size", "pre"], "inner", F.col("rep")).select("gid", "rep", "size")
    members = written(members, "ngram-members")
    bits = classes.select("rep", "size", "bits")
    # neighbours in postings, and each member of a group with the group's first
    chain = posts.where("prev IS NOT NULL").select(F.least("prev", "gid").alias("a"), F.greatest("prev", "gid").alias("b")).union(members.select(F.col("gid").alias("a"), F.col("rep").alias("b"))).where("a <> b").distinct()
    tried = written(by_bits(written(chain, "ngram-near"), bits, num, den), "ngram-chain")
    links = verified(tried, docs, n, num, den)
    found = components(links, "ngram-cc").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # postings of groups as postings of members; a group of several is a posting of its own
    solo = posts.select("token", F.col("gid").alias("rep"), "size", "pos", "edge")
    more = members.where("rep <> gid").select(F.col("gid").alias("rep"), F.col("rep").alias("other"))
    whole = solo.union(salted_join(more, solo, ["rep"], "inner", F.col("other"), more).select("token", F.col("other").alias("rep"), "size", "pos", "edge"))
    whole = written(whole.union(members.select(F.xxhash64(F.lit("group"), "gid").alias("token"), "rep", "size", F.lit(0).cast("long").alias("pos"), F.lit(False).alias("edge"))), "ngram-whole")
    # a posting of two has had its only pair tried, unless it lay at the edge of a task
    open_ = written(whole.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("edge").alias("edge")).where("n > 2 OR n = 2 AND edge").select("token"), "ngram-open")
    rows = written(salted_join(whole.drop("edge"), open_, ["token"], "left_semi", F.col("rep")), "ngram-rows")
    rows = in_mixed_postings(rows, found)
    untried = lambda met: written(met.where(fits(num, den)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "ngram-met")
    for turn in range(ROUNDS):
        # a posting of few rows has no more pairs than rows times pivots
        large = rows.where(F.col("of") > 2 * PIVOTS)
        met = written(by_bits(untried(with_pivots(large, turn, num, den)), bits, num, den), "ngram-drawn-pairs")
        more_links = verified(met, docs, n, num, den)
        if not row_count(more_links):
            break
        tried, found = tried.union(met), merged(found, more_links)
        # postings of one component stay so
        rows = in_mixed_postings(rows.drop("comp", "top", "of"), found)
    # a long posting's pairs are met with their parity bits, a short one's get them afterwards
    long_ = written(salted_join(rows.where(F.col("of") > WIDE), bits.select("rep", "bits"), ["rep"], "inner", F.col("token"), rows), "ngram-long")
    wide = lambda v: [*side(v), F.col("bits").alias(f"b{v}")]
    met = salted_join(long_.select("token", *wide("y")), long_.where("comp <> top").select("token", *wide("x")), ["token"], "inner", F.col("y"), long_).where(f"{fits(num, den)} AND {near(num, den)}").select("x", "sx", "px", "cx", "y", "sy", "py", "cy")
    short = written(rows.where(F.col("of") <= WIDE), "ngram-short")
    met = met.union(salted_join(short.select("token", *side("y")), short.where("comp <> top").select("token", *side("x")), ["token"], "inner", F.col("y"), short).select(*met.columns))
    final = merged(found, verified(by_bits(untried(met), bits, num, den), docs, n, num, den))
    # copies have the component of their class
    copies = classes.where("n > 1").select("set", "rep")
    own = written(salted_join(every.select("id", "size", "set"), copies, ["set"], "left", F.col("id")).select("id", "size", F.coalesce("rep", "id").alias("rep")), "ngram-own")
    out = salted_join(own, final, ["rep"], "left", F.col("id"))
    return out.select("id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("comp", "rep")).otherwise(F.col("id")).alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents by three-word shingles at 0.9; a row each row, null and repeated doc_ids as near_duplicates has them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_duplicates(docs, 3, 9, 10).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = n.doc_id
"""
