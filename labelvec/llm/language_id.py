"""Language of texts by hyperdimensional profiles of letter trigrams.

Every letter has a random vector of +1 and -1, drawn by its code point. A trigram is the product of its
letters' vectors, turned by two, one and no places; the sum over a text is its profile, and
the sum over all texts of a language its prototype. The nearest prototype by cosine wins.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.text import SLICE_DOCS, map_texts, mix, slices

SIZE = 1024
# Trigrams whose vectors a task holds at once, one byte a place.
TRIGRAMS = 32_768
_BITS = 21  # a code point


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)])


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Signs drawn for each code point by its own seed; 0 is the parting sign."""
    seeds = points.astype(np.uint64)[:, None] * np.uint64(SIZE) + np.arange(SIZE, dtype=np.uint64) + np.uint64(1 << 32)
    return (mix(seeds) >> np.uint64(63)).astype(np.int8) * 2 - 1


def bind(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: the product of their letters' vectors, turned by two, one and no places."""
    points = np.stack([codes >> 2 * _BITS, codes >> _BITS, codes]) & ((1 << _BITS) - 1)
    used, number = np.unique(points, return_inverse=True)
    letters = letter_vectors(used)
    first, second, third = number.reshape(points.shape)
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


class Trigrams:
    """Vectors of the trigrams met last, ``TRIGRAMS`` of them at most."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.codes, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)  # in order, and where their vectors are
        self.vectors = np.zeros((0, SIZE), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows in ``vectors`` of distinct codes in order, ``TRIGRAMS`` of them at most."""
        at = np.searchsorted(self.codes, codes)
        known = np.append(self.codes, -1)[at] == codes
        if known.all():
            return self.row[at]
        if len(self.codes) + np.count_nonzero(~known) > TRIGRAMS:
            self.clear()
            return self.rows(codes)
        new = codes[~known]
        if (end := len(self.codes) + len(new)) > len(self.vectors):
            grown = np.empty((min(TRIGRAMS, max(2 * len(self.vectors), end)), SIZE), np.int8)
            grown[: len(self.vectors)] = self.vectors
            self.vectors = grown
        rows = np.arange(len(self.codes), end)
        for k in range(0, len(new), 4096):
            self.vectors[rows[k : k + 4096]] = bind(new[k : k + 4096])
        self.codes, self.row = np.insert(self.codes, at[~known], new), np.insert(self.row, at[~known], rows)
        return self.row[np.searchsorted(self.codes, codes)]


@functools.cache
def _trigrams() -> Trigrams:
    return Trigrams()


def trigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of every letter with its neighbours, letters or parting signs; a code is three code points."""
    texts = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    points = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    letters = np.where(_letters()[points], points, 0).astype(np.int64)
    around = np.concatenate([[0], letters, [0]])
    at = np.flatnonzero(letters)
    codes = (around[at] << 2 * _BITS) | (around[at + 1] << _BITS) | around[at + 2]
    return np.searchsorted(ends, at, "right"), codes


def profiles(trigrams: Trigrams, n_texts: int, doc: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sum of its trigrams' vectors) for texts with a letter; vectors are taken in portions of ``TRIGRAMS``."""
    used, number = np.unique(codes, return_inverse=True)
    edges = np.searchsorted(doc, np.arange(n_texts + 1))
    rows = trigrams.rows(used) if len(used) <= TRIGRAMS else None
    for i in np.flatnonzero(np.diff(edges)):
        own = number[edges[i] : edges[i + 1]]
        kinds, counts = np.unique(own, return_counts=True)
        total = np.zeros(SIZE, np.float64)
        for k in range(0, len(kinds), TRIGRAMS // 8):
            part = kinds[k : k + TRIGRAMS // 8]
            at = trigrams.rows(used[part]) if rows is None else rows[part]
            total += counts[k : k + TRIGRAMS // 8].astype(np.float32) @ trigrams.vectors[at].astype(np.float32)
        yield int(i), total


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    for part in slices(batch.column("text")):
        for lo in range(part.first, part.first + part.count, SLICE_DOCS):
            size = min(SLICE_DOCS, part.first + part.count - lo)
            yield lo, [t or "" for t in batch.column("text").slice(lo, size).to_pylist()]


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the trigram vectors of each language over the rows of a task."""
    total: dict[str, np.ndarray] = {}
    counts: dict[str, np.ndarray] = {}  # of each known trigram, for each language of the task
    known = np.zeros(0, np.int64)

    def add_up() -> None:
        for name in counts:
            total.setdefault(name, np.zeros(SIZE, np.int64))
        for k in range(0, len(known), 1024):
            vectors = bind(known[k : k + 1024]).astype(np.int64)
            for name, c in counts.items():
                total[name] += c[k : k + 1024] @ vectors
        counts.clear()

    for batch in batches:
        for lo, texts in _texts_of(batch):
            doc, codes = trigram_codes(texts)
            names = batch.column("lang").slice(lo, len(texts)).to_pylist()
            if not len(codes):
                continue
            merged = np.union1d(known, codes)
            place = np.searchsorted(merged, known)
            for name, c in counts.items():
                counts[name] = np.zeros(len(merged), np.int64)
                counts[name][place] = c
            known = merged
            at = np.searchsorted(known, codes)
            for name in set(names):
                mine = np.array([x == name for x in names])[doc]
                old = counts.get(name, 0)
                counts[name] = old + np.bincount(at[mine], minlength=len(known))
            if len(known) > TRIGRAMS:
                add_up()
                known = np.zeros(0, np.int64)
    add_up()
    names = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.int64()))], names=["lang", "vector"]
    )


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes of length one, over all rows of ``train`` (text, lang, ...).

    Each task sums its own rows; the sums are added up by language and place. What
    comes to the driver is one vector for each language.
    """
    rows = train.where("lang is not null and text is not null").select("text", "lang")
    sums = map_texts(rows, _bundle, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("place", "value"))
    sums = sums.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))
    found = sorted((r["lang"], r["vector"]) for r in vectors.collect())
    matrix = np.array([v for _, v in found], np.float64).reshape(len(found), SIZE)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [name for name, _ in found], matrix / np.where(lengths > 0, lengths, 1)


def _nearest(names: list[str], matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = _trigrams()
        for batch in batches:
            for lo, texts in _texts_of(batch):
                doc, codes = trigram_codes(texts)
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                for i, profile in profiles(trigrams, len(texts), doc, codes) if names else ():
                    cosine = matrix @ profile / max(float(np.linalg.norm(profile)), 1e-9)
                    best = int(cosine.argmax())
                    langs[i], scores[i] = names[best], min(max(float(cosine[best]), 0.0), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(texts)), pa.array(langs, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def languages(docs: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text, ...), in one pass without a shuffle.

    The score is the cosine with the winner, 0 if negative; of equal ones the first name
    wins. Null texts, texts without a letter, and all texts if no language was learned, are
    ``und`` with score 0. Texts of any length are read whole; repeated rows get equal
    results. Other columns are ignored; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(docs, _nearest(names, matrix), "doc_id long, lang_pred string, score double")
