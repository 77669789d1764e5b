"""Exact top-k inner products by a three-phase uniform threshold over blocks of components.

A score is the sum of partial scores, one for each of ``NODES`` blocks of components.
First, every node names its best candidates for each query; their whole scores give a
cutoff that the final answers reach or exceed. Second, a candidate can only reach the cutoff if
some node gives it an equal share of it or more; only those are collected. Third, their
scores are resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W, functions as F

from labelvec.session import stage

NODES = 2
# Queries that travel to the executors at a time.
QUERY_BLOCK = 8192
# Rows and queries that meet in one matrix product.
ROWS, QUERIES = 2048, 512
SCALE = 256
_EXACT = float(1 << 53)


class Queries(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray  # whole numbers, as float64


def scaled_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole-number vectors) for each length; null vectors and null or non-finite components are left out."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        values = np.floor(SCALE * values.reshape(-1, size))
        good = np.isfinite(values).all(axis=1)
        yield rows[good], values[good]


def _dot(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products (queries, vectors): in doubles where no sum can pass 2**53, else in integers."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if top < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest of each row, in no order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(scores, -k, axis=1)[:, -k:]


def _parts(size: int) -> list[slice]:
    edges = np.linspace(0, size, min(NODES, size) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _meetings(
    batches: Iterator[pa.RecordBatch], queries: dict[int, Queries]
) -> Iterator[tuple[np.ndarray, np.ndarray, Queries]]:
    """Chunks of rows with chunks of the queries of their length."""
    for ids, vectors in _chunks(batches):
        q = queries.get(vectors.shape[1])
        for lo in range(0, len(q.ids) if q else 0, QUERIES):
            yield ids, vectors, Queries(q.ids[lo : lo + QUERIES], q.vectors[lo : lo + QUERIES])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, vectors in scaled_vectors(part.column("embedding")):
                yield ids[rows], vectors


class _List(NamedTuple):
    """For each query the best of a node so far: partial scores, vec_ids, whole scores; the least number marks a free place."""

    partial: np.ndarray
    ids: np.ndarray
    whole: np.ndarray

    def merged(self, other: _List, k: int) -> _List:
        partial = np.concatenate([self.partial, other.partial], axis=1)
        best = _best(partial, k)
        joined = [np.concatenate([a, b], axis=1) for a, b in zip(self[1:], other[1:])]
        return _List(np.take_along_axis(partial, best, 1), *(np.take_along_axis(x, best, 1) for x in joined))


def _local_lists(queries: dict[int, Queries], k: int):
    """Whole scores of the ``k`` best of each node and query among a task's rows: (query_id, vec_id, score)."""
    none = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[np.ndarray, _List]] = {}
        for ids, vectors, q in _meetings(batches, queries):
            own = q.ids[:, None] == ids
            for node, part in enumerate(_parts(vectors.shape[1])):
                partial = _dot(q.vectors[:, part], vectors[:, part])
                partial[own] = none
                best = _best(partial, k)
                row, col = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
                whole = _pairs(q.vectors[row], vectors[col]).reshape(best.shape)
                found = _List(np.take_along_axis(partial, best, 1), ids[best], whole)
                key = vectors.shape[1], int(q.ids[0]), node
                held[key] = q.ids, held[key][1].merged(found, k) if key in held else found
        for names, lists in held.values():
            real = lists.partial > none
            yield _rows(np.repeat(names, real.sum(axis=1)), lists.ids[real], lists.whole[real])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)


def _rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
        names=["query_id", "vec_id", "score"],
    )


def _resolve(queries: dict[int, Queries], cutoff: dict[int, int], k: int):
    """Of the rows that some node gives its share of the cutoff, those whose whole score reaches it.

    Of one chunk no query needs more than its ``k`` best, ties to the smaller vec_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, q in _meetings(batches, queries):
            least = np.array([cutoff.get(i, np.iinfo(np.int64).min) for i in q.ids.tolist()], np.int64)
            parts = _parts(vectors.shape[1])
            share = least // len(parts)  # rounded down: never above an equal share
            enough = np.zeros((len(q.ids), len(ids)), bool)
            for part in parts:
                enough |= _dot(q.vectors[:, part], vectors[:, part]) >= share[:, None]
            row, col = np.nonzero(enough & (q.ids[:, None] != ids))
            score = np.concatenate(
                [np.zeros(0, np.int64)]
                + [_pairs(q.vectors[row[a : a + 8192]], vectors[col[a : a + 8192]]) for a in range(0, len(row), 8192)]
            )
            good = score >= least[row]
            row, col, score = row[good], col[good], score[good]
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            yield _rows(q.ids[row[place < k]], ids[col[place < k]], score[place < k])

    return run


def _query_blocks(queries: DataFrame) -> Iterator[dict[int, Queries]]:
    """Queries in order of vec_id, ``QUERY_BLOCK`` at a time; a repeated vec_id counts once."""
    after = None
    while True:
        rest = queries if after is None else queries.where(F.col("vec_id") > after)
        rows = rest.orderBy("vec_id").limit(QUERY_BLOCK).collect()
        if not rows:
            return
        after = rows[-1]["vec_id"]
        column = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        yield {v.shape[1]: Queries(ids[rows_], v) for rows_, v in scaled_vectors(column) if len(rows_)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each of ``queries``, both (vec_id, embedding, ...).

    Scores are inner products of ``floor(256 * x)``; ties go to the smaller vec_id. Rows with
    the query's own vec_id are no candidates. Null vectors, those with a null or non-finite component and rows without
    a vec_id take no part; only vectors of equal length are compared. A repeated
    row is a candidate each time it stands; a repeated query id counts once, with its least vector. No rows give none.

    Queries travel in blocks of ``QUERY_BLOCK``; candidates are read twice for each
    block and never shuffled. What is shuffled is a few rows of each task and query.
    """
    vectors = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = stage(queries.where(F.col("vec_id").isNotNull() & valid).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    fields = "query_id long, vec_id long, score long"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = None
    for block in _query_blocks(queries):
        lists = vectors.mapInArrow(_local_lists(block, k), fields).distinct().withColumn("rank", rank)
        # one number for each query of the block: its k-th best so far, or none
        found = lists.where(F.col("rank") == k).select("query_id", "score").collect()
        cutoff = {r["query_id"]: r["score"] for r in found}
        exact = vectors.mapInArrow(_resolve(block, cutoff, k), fields).withColumn("rank", rank)
        part = exact.where(F.col("rank") <= k)
        out = stage(part, "best") if out is None else out.union(stage(part, "best"))
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"{fields}, rank int")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
