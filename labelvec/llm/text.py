"""Words of Arrow text columns as numpy arrays.

A word is a run of bytes other than space and tab to carriage return. UTF-8 keeps
those bytes out of longer characters, so words are found on the bytes themselves.
Everything works on slices of about a megabyte of whole texts, so a task's memory
follows the longest text, not the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
# Arrow batches of texts, in the JVM and in Python workers; Spark's own default counts 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
SLICE_DOCS = 1024
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    out = np.full(size, _STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(size: int) -> np.ndarray:
    """1, s, s*s, ... modulo 2**64 for an odd s."""
    return _powers(max(1024, 1 << int(size).bit_length()))[:size]


class Texts(NamedTuple):
    """Bytes of whole texts; text i is ``data[ends[i] : ends[i + 1]]``. ``first`` is its row in the batch."""

    data: np.ndarray
    ends: np.ndarray
    first: int

    @property
    def count(self) -> int:
        return len(self.ends) - 1


class Words(NamedTuple):
    """Parallel arrays, in text order: text number, byte range and hash of every word."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def per_doc(self, n_docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n_docs)


def map_texts(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches that suit long texts; this is set for the session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Texts]:
    """Cut a text column into ``Texts`` of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), len(column), lo + SLICE_DOCS)
        yield Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def doc_of(ends: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Number of the text that holds each byte position."""
    return np.searchsorted(ends[1:], positions, "right")


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which lie one after the other and aren't empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    at = np.cumsum(lengths) - lengths
    place = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
    codes = BYTE_CODES[data[place + np.repeat(start, lengths)]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(codes, at) + lengths.astype(np.uint64) * _MUL2)


def find_words(texts: Texts, lower: bool = False) -> Words:
    """All words; ``lower`` maps A-Z to a-z before hashing."""
    data, ends = texts.data, texts.ends
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    inside = ~WHITE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = ends[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = inside[inner]
    start = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(closes) + 1
    return Words(doc_of(ends, start), start, end, run_hashes(LOWER[data] if lower else data, start, end))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all runs of ``n`` words within one text."""
    count = len(words.doc) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = words.hash[:count].copy()
    for k in range(1, n):
        total = total * _STEP + words.hash[k : k + count]
    at = np.flatnonzero(words.doc[:count] == words.doc[n - 1 :])
    return at, mix(total[at])
