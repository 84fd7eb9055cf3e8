"""BPE by speculation: a greedy longest match proposes a word's tokens, and adjacent pairs are tested; a word is merged exactly only if a pair fails.

A sequence of tokens is what the merges give for its text just when that holds of each two adjacent ones. So the proposals of many words are tested
at once: their pairs, as numbers, are looked up in sorted arrays of pairs known to hold; a pair that is new is merged once and remembered.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm.common import byte_batches, table
from tessera.llm.memory import Memory
from tessera.llm.ragged import gather, is_uncertain, slices, words

#: What \\s stands for in the vocabulary's normaliser: White_Space of Unicode.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Fixed value: the pattern that splits words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Pairs a worker remembers before it starts anew.
PAIRS = 2_000_000
#: Bytes of stretches and their tokens that a worker remembers, twice.
REMEMBER = 100_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if it is one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A BPE vocabulary with word ends (a tokenizers file): NFC, white space dropped, lower case, byte-level words."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)
        self.end = model["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.spelling = pa.array([self.names.get(i, "") for i in range(max(self.names) + 1)], pa.string())
        self.raw = {i: i.to_bytes(4, "little") for i in self.names}
        #: The longest token that begins with such two letters.
        self.reach: dict[str, int] = {}
        for t in self.ids:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        self.library = Tokenizer.from_file(path)
        self.merger = self.library.model
        model["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(model)).model
        self.good = self.bad = np.empty(0, dtype=np.uint64)
        self.either = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.seen = Memory(REMEMBER)

    # exact merging

    def merged(self, letters: str) -> list[int]:
        """What the vocabulary's merges give for a word's letters, without its end: the library adds that."""
        return [t.id for t in self.merger.tokenize(letters)]

    # speculation

    def proposal(self, word: str) -> list[int] | None:
        """Longest tokens from the left of a word with its end. None if nothing begins so."""
        out, i, n, get, reach = [], 0, len(word), self.ids.get, self.reach.get
        stop = n - len(self.end)  # no token ends inside the mark of the word's end
        while i < n:
            far = reach(word[i : i + 2], 1)
            if n - i <= far and (token := get(word[i:])) is not None:
                out.append(token)
                return out
            for j in range(min(stop, i + far), i, -1):
                if (token := get(word[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
            else:
                return None
        return out

    def holds(self, a: int, b: int | None) -> bool:
        """Whether the merges leave two adjacent tokens, or one alone, as they are. Tokens inside a word are merged without its end."""
        names = self.names[a] + ("" if b is None else self.names[b])
        if names.endswith(self.end):
            got = self.merger.tokenize(names[: -len(self.end)])
        else:
            got = self.inner.tokenize(names)
        return [t.id for t in got] == ([a] if b is None else [a, b])

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first << 32 | second; second all ones: a token alone) holds."""
        unique, back = np.unique(pairs, return_inverse=True)
        if len(self.good) + len(self.bad) > PAIRS:
            self.good = self.bad = unique[:0]
        ok = np.isin(unique, self.good, assume_unique=True)
        new = unique[~ok & ~np.isin(unique, self.bad, assume_unique=True)]
        if len(new):
            none = 2**32 - 1
            fine = np.fromiter((self.holds(p >> 32, None if p & none == none else p & none) for p in new.tolist()), bool, len(new))
            self.good, self.bad = np.union1d(self.good, new[fine]), np.union1d(self.bad, new[~fine])
            ok = np.isin(unique, self.good, assume_unique=True)
        return ok[back]

    def words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word (letters with the word's end)."""
        got = [self.proposal(w) for w in words]
        flat, owner = [], []
        for n, ids in enumerate(got):
            if ids:
                flat += [a << 32 | b for a, b in zip(ids, ids[1:])] or [ids[0] << 32 | (2**32 - 1)]
                owner += [n] * max(1, len(ids) - 1)
        wrong = {n for n, ids in enumerate(got) if not ids}
        if flat:
            ok = self.compatible(np.asarray(flat, dtype=np.uint64))
            wrong.update(np.asarray(owner)[~ok].tolist())
        cut = len(self.end)
        for n in wrong:
            got[n] = self.merged(words[n][:-cut])
        return got

    # texts

    def classed(self, stretch: str) -> list[str]:
        """The words of a stretch with characters that Unicode versions class otherwise: normalised and split by the tables of the vocabulary's own library."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]

    def chunks(self, stretch: str) -> list[str]:
        """What white space leaves of a stretch without special tokens, normalised. Nothing in the normaliser reaches over a space."""
        if not stretch.isascii():
            stretch = unicodedata.normalize("NFC", stretch).replace("\u03a3", "\u03c3")  # lower case is by character: no final sigma
        if not stretch.isprintable() and any(c in stretch for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in SPACE.split(stretch.lower()) if x]
        return stretch.lower().split()

    def learn(self, stretches: list[str]) -> list[bytes]:
        """Tokens of each stretch between single spaces, as little-endian unsigned 32-bit numbers. New ones are encoded all at once and remembered."""
        got = [self.seen.recalled(x) for x in stretches]
        new = [i for i, x in enumerate(got) if x is None]
        parts = []
        for i in new:
            own: list = []
            for p in self.either.split(stretches[i]) if self.either else [stretches[i]]:
                low = p.lower()
                if low.isascii() and low.isalpha():
                    own.append(low)
                elif p not in self.special and is_uncertain(p):
                    own += self.classed(p)
                else:
                    own += [self.special[p]] if p in self.special else [w for c in self.chunks(p) for w in ([c] if c.isalpha() else SPLIT.findall(c))]
            parts.append(own)
        names = list({w for p in parts for w in p if isinstance(w, str)})
        spelt = [(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters)) + self.end for w in names]
        raw = self.raw
        known = {w: b"".join([raw[i] for i in ids]) for w, ids in zip(names, self.words(spelt))}
        for i, p in zip(new, parts):
            got[i] = b"".join([known[w] if isinstance(w, str) else raw[w] for w in p]) if len(p) != 1 or isinstance(p[0], int) else known[p[0]]
            self.seen.put(stretches[i], got[i])
        return got

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts (no nulls) one after the other, and where each text's begin (and the last ends)."""
        texts = texts.cast(pa.string())
        unique, codes, begin = words(texts)
        data = self.learn(unique.to_pylist())
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        flat, at = gather(np.frombuffer(b"".join(data), dtype="<u4"), np.cumsum(sizes) - sizes, sizes, codes)
        return flat, at[begin]

    def spoken(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """Texts of tokens: their names with spaces between, as the vocabulary's file names no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), self.spelling.take(pa.array(ids))), " ")

    def decode(self, ids: bytes) -> str:
        """Tokens' names with spaces between: the vocabulary's file names no decoder. Ids without a name are left out."""
        return " ".join(self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in self.names)


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One a worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text_col: str = "text") -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit, binary) and decoded. Null counts as empty text, which has no tokens. No rows give no rows. Own columns of those names are replaced."""
    byte_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("ids", "decoded")]
    plain = docs.select(*[docs[c] for c in own], F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(public_tokenizers.path(tokenizer))
        for b in batches:
            for first, texts in slices(b.column(b.num_columns - 1)):
                ids, begin = bpe.encode_all(texts)
                raw = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((begin * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                columns = [b.column(i).slice(first, len(texts)) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, raw, bpe.spoken(ids, begin).cast(pa.string())], [*own, "ids", "decoded"])

    return plain.mapInArrow(work, schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens and decoded text of every row of documents; null texts have none, rows that repeat stay."""
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
