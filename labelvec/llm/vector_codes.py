"""Compact codes of vectors: a codebook for each part of the components, learned by Lloyd's rounds over cover trees.

Every block of rows holds one cover tree for each part (a simplified one, after Izbicki and Shelton, 2015): the children of a
node cover its points within half of its radius, and their centres are further apart than that. Points lie
in tree order beside their cumulative counts and sums, so a subtree is a range. A round sends the codebooks to the trees. An entry
that is further from a node's centre than the nearest one by more than twice the node's radius is nearest to none of
its points. Where one entry is left, the whole subtree is assigned by its sums; nodes with more descend, and the points of
ambiguous leaves are compared one by one, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelvec.llm.topk import SCALE, scaled_vectors
from labelvec.session import broadcast_if_small, stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Rows of a block, of which a task holds one at a time, and of the nodes compared with a codebook at a time.
BLOCK_ROWS, FRONTIER = 1 << 14, 1 << 11
# Points below which a node has no children.
LEAF = 16


class Tree(NamedTuple):
    """Distinct points in tree order; a node is the range ``lo:hi`` of them, and its centre the first."""

    points: np.ndarray
    rows: np.ndarray  # rows before each point, and in all
    sums: np.ndarray  # sums of these rows
    which: np.ndarray  # the point of each row
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # children are the nodes first:last
    last: np.ndarray
    radius: np.ndarray


def _limit(width: int) -> int:
    """Components up to which squared distances of ``width`` components are exact."""
    return int(np.sqrt(2.0**60 / width)) // 2


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def grow(values: np.ndarray) -> Tree:
    """The cover tree of the rows of a matrix of whole numbers, level by level."""
    points, which, counts = np.unique(values, axis=0, return_inverse=True, return_counts=True)
    n = len(points)
    order = np.arange(n)
    lo, hi = np.array([0]), np.array([n])
    square = np.array([_squares(points, points[0]).max()])
    levels, nodes = [], 0
    while True:
        splits = hi - lo > LEAF
        open_ = np.flatnonzero(splits)
        nodes += len(lo)
        first, last = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        levels.append((lo, hi, first, last, square))
        if not len(open_):
            break
        place = np.concatenate([np.arange(lo[k], hi[k]) for k in open_])
        own = np.repeat(np.arange(len(open_)), (hi - lo)[open_])
        here, reach = points[order[place]], square[open_] // 4
        turn, apart = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        rest, at = np.arange(len(place)), 0
        while len(rest):
            # The first uncovered point of each node becomes a centre and covers what lies within reach.
            begins = np.concatenate([[True], own[rest[1:]] != own[rest[:-1]]])
            centre = rest[begins][np.cumsum(begins) - 1]
            d = _squares(here[rest], here[centre])
            covered = d <= reach[own[rest]]
            turn[rest[covered]], apart[rest[covered]] = at, d[covered]
            rest, at = rest[~covered], at + 1
        by = np.lexsort((turn, own))
        order[place] = order[place[by]]
        own, turn, apart = own[by], turn[by], apart[by]
        begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (turn[1:] != turn[:-1])]))
        children = np.bincount(own[begins], minlength=len(open_))
        last[open_] = nodes + np.cumsum(children)
        first[open_] = last[open_] - children
        lo, hi = place[begins], place[np.append(begins[1:], len(place)) - 1] + 1
        square = np.maximum.reduceat(apart, begins)
    lo, hi, first, last, square = (np.concatenate(x) for x in zip(*levels))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return _tree(points[order], counts[order], back[which.ravel()], lo, hi, first, last, np.sqrt(square.astype(np.float64)))


def _tree(points, counts, which, lo, hi, first, last, radius) -> Tree:
    zero = np.zeros((1, points.shape[1]), np.int64)
    sums = np.concatenate([zero, np.cumsum(points * counts[:, None], axis=0)])
    return Tree(points, np.concatenate([[0], np.cumsum(counts)]), sums, which, lo, hi, first, last, radius)


def _packed(tree: Tree) -> bytes:
    head = [tree.points.shape[1], len(tree.points), len(tree.lo), len(tree.which)]
    numbers = [head, tree.points.ravel(), np.diff(tree.rows), tree.which, tree.lo, tree.hi, tree.first, tree.last]
    return np.concatenate(numbers).astype(np.int32).tobytes() + tree.radius.tobytes()


def _unpacked(data: bytes) -> Tree:
    width, n, nodes, rows = np.frombuffer(data, np.int32, 4).tolist()
    sizes = [n * width, n, rows, nodes, nodes, nodes, nodes]
    values = np.frombuffer(data, np.int32, sum(sizes), 16).astype(np.int64)
    points, counts, which, lo, hi, first, last = np.split(values, np.cumsum(sizes)[:-1])
    radius = np.frombuffer(data, np.float64, nodes, 16 + 4 * sum(sizes))
    return _tree(points.reshape(n, width), counts, which, lo, hi, first, last, radius)


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, entry): ranges of points and the nearest entry of their points, ties to the lower one."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = [(np.array([0]), np.ones((1, len(book)), bool))]

    def exact(points: np.ndarray, mask: np.ndarray) -> None:
        """Each point against the entries that are left for its leaf."""
        if not len(points):
            return
        row, entry = np.nonzero(mask)
        d = _squares(tree.points[points[row]], book[entry])
        begins = np.searchsorted(row, np.arange(len(points)))
        least = np.flatnonzero(d == np.minimum.reduceat(d, begins)[row])
        done.append((points, points + 1, entry[least[np.searchsorted(least, begins)]]))

    while waiting:
        nodes, mask = waiting.pop()
        if len(nodes) > FRONTIER:
            waiting += [(nodes[a : a + FRONTIER], mask[a : a + FRONTIER]) for a in range(0, len(nodes), FRONTIER)]
            continue
        lo, hi, radius = tree.lo[nodes], tree.hi[nodes], tree.radius[nodes][:, None]
        d = np.sqrt(_squares(tree.points[lo][:, None], book[None]).astype(np.float64))
        d = np.where(mask, d, np.inf)
        nearest = d.min(axis=1, keepdims=True)
        # Doubles are off by far less than the slack, which only keeps an entry too many.
        mask = d - radius <= (nearest + radius) * (1 + 1e-9) + 1e-6
        whole = mask.sum(axis=1) == 1
        done.append((lo[whole], hi[whole], mask[whole].argmax(axis=1)))
        leaf = ~whole & (tree.first[nodes] == tree.last[nodes])
        sizes = (hi - lo)[leaf]
        ends = np.cumsum(sizes)
        exact(np.repeat(lo[leaf] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), np.repeat(mask[leaf], sizes, axis=0))
        inner = np.flatnonzero(~whole & ~leaf)
        if len(inner):
            first, last = tree.first[nodes[inner]], tree.last[nodes[inner]]
            sizes = last - first
            ends = np.cumsum(sizes)
            children = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
            waiting.append((children, np.repeat(mask[inner], sizes, axis=0)))
    lo, hi, entry = (np.concatenate(x) for x in zip(*done))
    by = np.argsort(lo)
    return lo[by], hi[by], entry[by]


def _usable(column: str, parts: int) -> Column:
    """Vectors that can be cut into ``parts`` and hold finite numbers only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & (F.size(column) % parts == 0) & finite, F.lit(False))


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, values in scaled_vectors(batch.column("embedding")):
        if len(rows):
            if np.abs(values).max() > _limit(values.shape[1]):
                raise ValueError(f"components beyond {_limit(values.shape[1]) / SCALE:.0f} have no exact squared distances")
            yield rows, values.astype(np.int64)


def _least_ids(entries: int):
    """The vectors of a task's least ids; of a repeated id the least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, list[int]] = {}
        for batch in batches:
            for rows, values in _whole(batch):
                for name, vector in zip(batch.column("vec_id").take(pa.array(rows)).to_pylist(), values):
                    if name not in best or vector.tolist() < best[name]:
                        best[name] = vector.tolist()
                    if len(best) > 4 * entries:
                        best = {k: best[k] for k in _ordered(best)[:entries]}
        names = _ordered(best)[:entries]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([best[k] for k in names], pa.list_(pa.int64()))], names=["vec_id", "vector"]
        )

    return run


def _ordered(names) -> list:
    return sorted(names, key=lambda k: (k is None, k))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(part, entry, place): the parts of the vectors of the ``entries`` least vec_ids; a missing id counts as the last."""
    least = vectors.select("vec_id", "embedding").mapInArrow(_least_ids(entries), "vec_id long, vector array<long>")
    least = least.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    start = np.array([r["vector"] for r in least.collect()], np.int64)
    return start.reshape(len(start), parts, -1).transpose(1, 0, 2)


def _plant(parts: int, schema: pa.Schema):
    """A row for each block: its ids and labels, and its trees."""

    def block(held: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        values = np.concatenate([h[2] for h in held])
        trees = [_packed(grow(part)) for part in np.split(values, parts, axis=1)]
        edges = pa.array([0, len(ids)], pa.int32())
        lists = [pa.ListArray.from_arrays(edges, x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"]).cast(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows, values in _whole(batch):
                for a in range(0, len(rows), BLOCK_ROWS):
                    part = pa.array(rows[a : a + BLOCK_ROWS])
                    if n + len(part) > BLOCK_ROWS:
                        yield block(held)
                        held, n = [], 0
                    held.append((batch.column("vec_id").take(part), batch.column("label").take(part), values[a : a + BLOCK_ROWS]))
                    n += len(part)
        if held:
            yield block(held)

    return run


def cover_trees(vectors: DataFrame, parts: int) -> DataFrame:
    """(ids, labels, trees) of blocks of at most ``BLOCK_ROWS`` rows, staged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    label = vectors.schema["label"].dataType.simpleString()
    fields = f"ids array<bigint>, labels array<{label}>, trees array<binary>"
    spark = vectors.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], fields).schema)
    return stage(vectors.mapInArrow(_plant(parts, schema), fields), "trees")


def _sums(books: np.ndarray):
    """Numbers and sums of the parts that a task assigns to each entry; ``place`` -1 is the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for trees in batch.column("trees"):
                for p in range(parts):
                    tree = _unpacked(trees[p].as_py())
                    lo, hi, entry = assigned(tree, books[p])
                    np.add.at(total[p, :, 0], entry, tree.rows[hi] - tree.rows[lo])
                    np.add.at(total[p, :, 1:], entry, tree.sums[hi] - tree.sums[lo])
        used = np.nonzero(np.repeat(total[:, :, :1] > 0, width + 1, axis=2))
        part, entry, place = (x.astype(np.int32) for x in used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(place - 1, pa.int32()), pa.array(total[used])], names=["part", "entry", "place", "total"]
        )

    return run


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after all parts were assigned and every used entry became the floor of their mean."""
    sums = trees.select("trees").mapInArrow(_sums(books), "part int, entry int, place int, total long")
    # A row for each entry and place, however many tasks there are.
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    found = {(r.part, r.entry, r.place): int(r.total) for r in sums.groupBy("part", "entry", "place").agg(total).collect()}
    new = books.copy()
    for part, entry, place in found:
        if place >= 0:
            new[part, entry, place] = found[part, entry, place] // found[part, entry, -1]
    return new


def _codes(books: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
                codes, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for p, packed in enumerate(batch.column("trees")[i]):
                    tree = _unpacked(packed.as_py())
                    lo, hi, entry = assigned(tree, books[p])
                    entry = np.repeat(entry, hi - lo)
                    codes[:, p] = entry[tree.which]
                    error += _squares(tree.points, books[p][entry])[tree.which]
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, labels, packed, pa.array(error)], names=["vec_id", "label", "code", "error"]).cast(schema)

    return run


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of ``vectors`` (vec_id, embedding, label, ...), and the codebooks (part, entry, place).

    A component x is ``floor(256 x)``; a vector is cut into ``parts`` equal parts. A codebook starts with the parts of the
    vectors of the ``entries`` (256 at most) least vec_ids, of a repeated id with its least vector; a missing id counts as one id
    after all others. ``code`` holds a byte for each part, ties to the lower entry; ``error`` is the sum of squared distances.
    Vectors that are null or empty, hold null or non-finite components, don't cut into equal parts or are of another length
    than that of the least vec_id take no part. Repeated rows count and are returned as often as they stand. Components so large
    that squared distances pass 64 bits are an error. No rows give none, and empty codebooks.

    The table is read twice, for the first entries and for the trees; rounds read the trees. Each task sends sums for each entry,
    and the driver holds the codebooks only.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = rows.where(_usable("embedding", parts))
    one = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    rows = rows.where(F.size("embedding") == (one[0] if one else 0))
    books = first_codebooks(rows, parts, entries) if one else np.zeros((parts, 0, 0), np.int64)
    trees = cover_trees(rows, parts)
    for _ in range(rounds if one else 0):
        books = lloyd_round(trees, books)
    label = rows.schema["label"].dataType.simpleString()
    fields = f"vec_id long, label {label}, code binary, error long"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], fields).schema)
    return stage(trees.mapInArrow(_codes(books, schema), fields), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of a label, missing ones together; null beyond 64 bits."""
    sums = codes.groupBy(F.col("label").alias("_of")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("_of"))).drop("_of")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _sql() -> str:
    square = "list_sum(list_transform(list_zip(s, c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"

    def best(books: str) -> str:
        return f"SELECT i, part, any_value(s) AS s, min({square} * 64 + k) AS best FROM p JOIN {books} USING (part) GROUP BY i, part"

    def moved(books: str, near: str) -> str:
        return f"""
  SELECT part, k, coalesce(n.c, o.c) AS c FROM {books} o LEFT JOIN (
    SELECT part, k, list(m ORDER BY j) AS c FROM (
      SELECT part, best % 64 AS k, j, CAST(floor(sum(s[j]) / count(*)) AS BIGINT) AS m FROM {near}, range(1, len(s) + 1) r(j)
      GROUP BY 1, 2, 3) GROUP BY part, k) n USING (part, k)"""

    return f"""
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT i, vec_id, CAST(part AS BIGINT) AS part, e[part * (len(e) // 16) + 1:(part + 1) * (len(e) // 16)] AS s FROM v, range(16) r(part)),
b0 AS (SELECT part, k, s AS c FROM p JOIN (SELECT i, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64) USING (i)),
n1 AS MATERIALIZED ({best('b0')}), b1 AS MATERIALIZED ({moved('b0', 'n1')}),
n2 AS MATERIALIZED ({best('b1')}), b2 AS MATERIALIZED ({moved('b1', 'n2')}),
n3 AS MATERIALIZED ({best('b2')}),
d AS (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, k, j) AS t FROM (SELECT part, k, unnest(c) AS x, unnest(range(len(c))) AS j FROM b2)),
r AS (
  SELECT i, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM n3 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(d.t) AS codebooks_sha256
FROM v JOIN r USING (i), d
"""


SQL = _sql()
