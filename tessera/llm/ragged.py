"""Words and tokens of many texts as flat arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is taken alone.
BYTES = 6_000_000


def slices(column: pa.Array, most: int = BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of texts with up to so many bytes, each with the place of its first row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, column.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(column) > start:
        yield start, column.slice(start)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What single spaces leave of each text: the different ones, the number of each in turn, and where each text's begin (and the last ends)."""
    parts = pc.split_pattern(texts.cast(pa.string()), " ")
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    coded = parts.flatten().dictionary_encode()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values that picks name, one after the other, and where each begins (and the last ends)."""
    n = sizes[picks]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[picks] - (ends - n), n)
    return values[at], np.concatenate([[0], ends])


@cache
def _moved() -> re.Pattern:
    """Letters, digits and marks that came after Unicode 3.2, and what is not assigned: libraries of other Unicode versions may class them otherwise."""
    old, spans = unicodedata.ucd_3_2_0.category, []
    for i in range(0x200, 0x110000):
        c = chr(i)
        now = unicodedata.category(c)
        if now == "Cn" or now[0] in "LNM" and old(c) == "Cn":
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def is_uncertain(text: str) -> bool:
    """Whether a text has characters that Unicode versions may class otherwise."""
    return not text.isascii() and _moved().search(text) is not None


def uncertain(texts: pa.Array) -> list[int]:
    """Rows with such characters."""
    flat = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
    if not (flat[ends[0] : ends[-1]] >= 0xC8).any():  # the first byte of U+0200
        return []
    return [i for i, t in enumerate(texts.to_pylist()) if is_uncertain(t)]
