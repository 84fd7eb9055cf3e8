"""Concatenate and cut: all documents' tokens as one stream, cut into sequences of a fixed length.

Pass 1 writes each document's tokens with the sum of those before it in its partition. The totals of the partitions and their prefix sums
(the driver holds one number a partition) then give every document its place in the stream. Pass 2 cuts each document where windows end: one that crosses a
boundary gives a record to both sides. Neither pass shuffles.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import table, written
from tessera.llm.ragged import gather, slices, uncertain, words

LENGTH = 1024
END = 0
#: Fixed value: White_Space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class ByteBpe:
    """Byte-level BPE of a public vocabulary, as the tokenizers library has it with add_special_tokens=False; tokens are unsigned numbers of self.kind, 16 bits where they suffice.

    The pattern that splits a text before merges ends a piece before each single space between two other characters. So the different stretches
    between such spaces in many texts are encoded once, in one run, and told apart by their bytes. Texts with white space beside a space,
    or with a special token, are encoded whole.
    """

    def __init__(self, ranks: str, library: str, special: dict[str, int] | None = None):
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}  # noqa: SIM115
        self.special = {"<|endoftext|>": 50256} if special is None else special
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=self.special)
        top = max([*vocabulary.values(), *self.special.values()])
        self.kind = np.dtype("<u2" if top < 2**16 else "<u4")
        self.library = Tokenizer.from_file(library)
        self.sizes = np.zeros(top + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = [len(k) for k in vocabulary]

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.bpe.encode(text, allowed_special="all"), dtype=self.kind)

    def _run(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of stretches that each begin with their only space, and where each stretch's tokens end."""
        ids = np.asarray(self.bpe.encode_ordinary(joined), dtype=self.kind)
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The tokens of each text (no nulls). Texts with characters that Unicode versions class otherwise are left to the library."""
        texts = texts.cast(pa.string())
        late = {*uncertain(texts)}
        unique, codes, begin = words(texts)
        odd = pc.not_equal(pc.binary_length(pc.utf8_trim(unique, WHITE)), pc.binary_length(unique))
        odd = pc.or_(odd, pc.equal(pc.binary_length(unique), 0))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(unique, s))
        fine = unique.filter(pc.invert(odd))
        odd = odd.to_numpy(zero_copy_only=False)
        starts = sizes = np.zeros(len(unique), dtype=np.int64)
        ids = np.empty(0, dtype=self.kind)
        if len(fine):
            ids, ends = self._run(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(fine)], fine), " ")[0].as_py())
            starts, sizes = starts.copy(), sizes.copy()
            starts[~odd] = np.append(0, ends[:-1])
            sizes[~odd] = ends - starts[~odd]
        out = []
        bad = np.append(0, np.cumsum(odd[codes])) if len(codes) else np.zeros(1, dtype=np.int64)
        flat, at = gather(ids, starts, sizes, codes)
        for i in range(len(texts)):
            a, b = begin[i], begin[i + 1]
            if i in late:
                out.append(np.asarray(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=self.kind))
            elif bad[b] > bad[a]:
                out.append(self.whole(texts[i].as_py()))
            else:
                first = np.asarray(self.bpe.encode_ordinary(unique[int(codes[a])].as_py()), dtype=self.kind)  # has no space before it
                out.append(np.concatenate([first, flat[at[a + 1] : at[b]]]))
        return out


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(name: str) -> ByteBpe:
    """One a worker process."""
    if name not in _loaded:
        _loaded[name] = ByteBpe(public_tokenizers.path(name), public_tokenizers.path(name.replace(".tiktoken", ".json")))
    return _loaded[name]


def counted(docs: DataFrame, tokenizer: str, end_id: int = END) -> DataFrame:
    """docs(id, text) -> (part, before, n, id, ids): each document's tokens and end_id, and how many its partition has before it. Null text is empty: its only token is end_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, bpe = TaskContext.get().partitionId(), 0, byte_bpe(tokenizer)
        width = bpe.kind.itemsize
        for b in batches:
            for first, texts in slices(pc.fill_null(b.column(1), "")):
                ids = [np.append(x, bpe.kind.type(end_id)) for x in bpe.encode_all(texts)]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(before), pa.array(n), b.column(0).slice(first, len(ids)), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.full(len(ids), width, dtype=np.int32))], ["part", "before", "n", "id", "ids", "width"])

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(work, "part int, before long, n long, id long, ids binary, width int")


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", length: int = LENGTH, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """docs(id, text) -> a row a piece: (id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids).

    Every token lies in one piece; sequences are full but for the last. The order in the stream is that of the partitions and rows as first read, fixed
    by a written table. Ids may be null or repeat; other columns are not read. No documents give no pieces.
    """
    ids = written(counted(docs, tokenizer, end_id), "pack-ids")
    bases, at = {}, 0
    for r in ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        bases[r.part], at = at, at + r.n
    shipped = docs.sparkSession.sparkContext.broadcast(bases)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shipped.value
        for b in batches:
            out = []
            for part, before, n, doc, data, width in zip(*(c.to_pylist() for c in b.columns)):
                at, start = base[part] + before, 0
                data = np.frombuffer(data, dtype=f"<u{width}").astype("<u4").tobytes()
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(length - off, n - start)
                    piece = data[4 * start : 4 * (start + size)]
                    out.append((doc, start, size, n, seq, off, zlib.crc32(piece), piece if with_ids else None))
                    start += size
            kinds = [pa.int64()] * 7 + [pa.binary()]
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[i : i + 10_000]), kinds)], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"])

    return ids.mapInArrow(work, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all rows of documents; null texts have one token, rows that repeat or lack a doc_id are documents of their own."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return packed(docs, with_ids=False).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
