"""Nearest neighbours by an inverted multi-index: two halves of each vector are quantised apart, and a pair of centroids is a cell.

A query goes through cells in the order of the sum of both halves' scores, kept by a heap over the two sorted lists, until it has met enough
entries; these are ranked by their exact inner products. Centroids are fitted to a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, written

#: Vectors that centroids are fitted to, at most: those whose hashed ids are least.
FIT_VECTORS = 20_000
#: Most centroids of a half, which bounds the table of cells that is sent to workers (their square, 8 bytes each): beyond that cells grow, and are still met whole.
MOST_CENTROIDS = 1024
#: Entries that a cell is meant to have; the fewest and the most of a group of cells, which one task ranks: as many as give each partition a group.
CELL = 32
LEAST_GROUP = 1024
GROUP = 8192
#: Recall that the number of entries a query meets is set for, on queries of the sample; how many of those; neighbours of each.
RECALL = 0.96
TRIALS = 200


def usable(v: Column) -> Column:
    """Neither null nor empty, no component null or not finite, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's steps from rows spread over the sample; an empty cluster keeps its place."""
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Two codebooks and the number of entries of each cell: a table whose size the numbers of centroids bound."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.books, self.half = (left, right), left.shape[1]
        self.counts = np.zeros((len(left), len(right)), dtype=np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (np.argmin((c * c).sum(1) - 2 * h @ c.T, axis=1) for c, h in zip(self.books, (x[:, : self.half], x[:, self.half :])))
        return a * len(self.books[1]) + b

    def walk(self, query: np.ndarray, enough: float = math.inf) -> list[int]:
        """Cells with entries by falling summed inner product, until those of enough entries have been met or none is left."""
        scores = [h @ c.T for c, h in zip(self.books, (query[: self.half], query[self.half :]))]
        order = [np.argsort(-s, kind="stable") for s in scores]
        a, b = (s[o].tolist() for s, o in zip(scores, order))
        counts = self.counts[np.ix_(*order)].tolist()
        first, second, wide = order[0].tolist(), order[1].tolist(), len(b)
        heap, met, out = [(-(a[0] + b[0]), 0, 0)], 0, []
        while heap and met < enough:
            _, i, j = heapq.heappop(heap)
            if n := counts[i][j]:
                out.append(first[i] * wide + second[j])
                met += n
            # (i, j + 1) comes after (i, j); (i + 1, 0) after (i, 0): each pair is pushed once, after a pair no worse than it
            if j + 1 < wide:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return out

    def share(self, x: np.ndarray, top: int) -> float:
        """The share of entries that queries from a sample have to meet to find RECALL of their top nearest in it."""
        cells = self.cells(x)
        self.counts[...] = np.bincount(cells, minlength=self.counts.size).reshape(self.counts.shape)
        flat, need = self.counts.reshape(-1), []
        for i in np.unique(np.linspace(0, len(x) - 1, TRIALS).astype(int)):
            score = x @ x[i]
            score[i] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(top, len(x) - 1)]
            way = np.asarray(self.walk(x[i]))
            met = np.zeros(len(flat))
            met[way] = np.cumsum(flat[way])
            need += met[cells[near]].tolist()
        return float(np.quantile(need, RECALL)) / len(x) if need else 1.0


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def built(vectors: DataFrame, top: int) -> tuple[MultiIndex | None, DataFrame | None, float]:
    """vectors(id, v), usable and of one dimension -> the index, its entries (cell, id, v) as a written table, and the share of them that a query has to meet."""
    n = vectors.count()
    if not n:
        return None, None, 1.0
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_VECTORS).select("v").toArrow()["v"].combine_chunks()
    x = matrix(sample)
    k = int(min(MOST_CENTROIDS, max(1, math.isqrt(n // CELL)), len(x)))
    half = max(1, x.shape[1] // 2)
    index = MultiIndex(k_means(x[:, :half], k), k_means(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0)))
    share = index.share(x, top)
    shipped = vectors.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shipped.value.cells(matrix(b.column(1))), pa.int64()), b.column(0), b.column(1)], ["cell", "id", "v"])

    placed = written(vectors.select("id", "v").mapInArrow(place, "cell long, id long, v array<double>"), "ann-cells")
    counts = placed.groupBy("cell").count().toArrow()  # of a bounded number of cells
    index.counts[...] = 0
    index.counts.reshape(-1)[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    return index, placed, share


def groups_of(counts: np.ndarray, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, its first group and in how many it lies: cells in order fill groups of some most entries, and a hot cell has groups of its own."""
    first, spans = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    group = held = 0
    for c, n in enumerate(counts.tolist()):
        if n > most:
            group += held > 0
            spans[c] = -(-n // most)
            first[c], group, held = group, group + spans[c], 0
            continue
        if held + n > most:
            group, held = group + 1, 0
        first[c], held = group, held + n
    return first, spans


def nearest(vectors: DataFrame, queries: Column, top: int = 20) -> DataFrame:
    """vectors(id, v) -> (query_id, rank, vec_id, score): for each row that queries says, its top nearest among all others by inner product, ties to the smaller id.

    Vectors that are null, empty, zero, or have null or infinite components, or another length than the commonest, take no part, nor do rows without
    an id. Rows that repeat an id are entries of their own, but none is a neighbour of a query of that id. A query meets a share of all entries
    that is fitted to the sample, and at least 50 * top. Other columns are not read. Without vectors there are no rows.
    """
    spark = vectors.sparkSession
    v = written(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), queries.alias("asks")).where("id IS NOT NULL").where(usable(F.col("v"))), "ann-vectors")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if sizes:
        v = v.where(F.size("v") == sizes[0].n)
    index, entries, share = built(v.select("id", "v"), top)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    enough = max(50 * top, math.ceil(share * int(index.counts.sum()))) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, spans = groups_of(index.counts.reshape(-1), max(LEAST_GROUP, min(GROUP, -(-int(index.counts.sum()) // parts))))
    shipped = spark.sparkContext.broadcast((index, first, spans))
    schema = "grp long, asks boolean, cell long, id long, v array<double>, cells array<long>"
    names = ["grp", "asks", "cell", "id", "v", "cells"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, spans = shipped.value
        for b in batches:
            cell, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            # the rows of a hot cell are dealt out by a mix of their ids
            mixed = ((row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + mixed % spans[cell]), pa.array(np.zeros(len(cell), dtype=bool)), b.column(0), b.column(1), b.column(2), pa.nulls(len(cell), pa.list_(pa.int64()))], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, spans = shipped.value
        for b in batches:
            for i in range(0, b.num_rows, 64):
                own, out = b.slice(i, 64), []
                for n, q in enumerate(matrix(own.column(1))):
                    by: dict[int, list[int]] = {}
                    for c in index.walk(q, enough):
                        for g in range(first[c], first[c] + spans[c]):
                            by.setdefault(g, []).append(c)
                    out += [(g, n, sorted(cs)) for g, cs in by.items()]
                if out:
                    group, row, cells = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array([True] * len(row)), pa.nulls(len(row), pa.int64()), own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(cells, pa.list_(pa.int64()))], names)

    # a group's entries and the queries that reach it meet in one task; a query is sent once to each group
    asked = v.where("asks").select("id", "v").repartition(parts).mapInArrow(ask, schema)
    met = entries.mapInArrow(deal, schema).union(asked).repartition("grp").sortWithinPartitions("grp", "asks", "cell", "id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, parts = None, None, []
        for b in batches:
            group, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = (np.flatnonzero((group[1:] != group[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist()
            found: list = []
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                if a == z:
                    continue
                own = b.slice(a, z - a)
                if group[a] != now:
                    now, held, parts = group[a], None, []
                if not asks[a]:
                    parts.append((own.column(2).to_numpy(), own.column(3).to_numpy(), matrix(own.column(4))))
                elif parts:
                    held = held or tuple(np.concatenate(z) for z in zip(*parts))
                    for who, q, cells in zip(own.column(3).to_pylist(), matrix(own.column(4)), own.column(5)):
                        found.append(best(who, q, cells.values.to_numpy(), *held, top))
            if found:
                w, e, s = (np.concatenate(z) for z in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(e, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    hits = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    w = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
    return hits.selectExpr("query_id", f"{w} AS rank", "vec_id", "score").where(F.col("rank") <= top)


def best(who: int, q: np.ndarray, wanted: np.ndarray, cells: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A query's top entries among the wanted cells of a group (sorted by cell). The last ones are decided by exactly rounded sums, so that equal vectors tie."""
    at = np.concatenate([np.arange(a, z) for a, z in zip(np.searchsorted(cells, wanted, "left"), np.searchsorted(cells, wanted, "right"))])
    at = at[ids[at] != who]
    rough = x[at] @ q
    if len(at) > top:
        edge = np.partition(rough, len(at) - top)[len(at) - top]
        at = at[rough >= edge - 1e-9 * max(1.0, abs(edge))]
    score = np.asarray([math.fsum(p) for p in (x[at] * q).tolist()])
    order = np.lexsort((ids[at], -score))[:top]
    return np.full(len(order), who), ids[at][order], score[order]


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector of embeddings; odd vectors and rows are those of nearest."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), F.col("id") % 20 == 0)
