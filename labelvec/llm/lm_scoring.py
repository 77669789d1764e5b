"""Stupid-backoff scores of documents from n-gram counts of all other documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.text import Texts, Words, find_words, map_texts, mix, ngrams, slices

# Text of a block, whose distinct n-grams are asked for together, and of the share of a count partition.
BLOCK_BYTES = 12 << 20
PARTITION_BYTES = 48 << 20
ALPHA = 0.4


def order_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the last word, hash) of all runs of ``n`` words; hashes differ between orders."""
    at, hashes = ngrams(words, n)
    return at + n - 1, mix(hashes + np.uint64(n))


def _block_grams(column: pa.Array, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct hashes, counts) of each order in a block of texts."""
    out = []
    parts = [find_words(t, lower=True) for t in slices(column)]
    for n in range(1, orders + 1):
        hashes = [order_grams(w, n)[1] for w in parts]
        out.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True))
    return out


def _asked(orders: int, partitions: int):
    """Distinct n-grams of a block with their counts in it, one row for each count partition."""
    edges = np.array([(k << 64) // partitions for k in range(partitions)], np.uint64)
    schema = pa.schema(
        [("partition", pa.int32()), ("block", pa.int64()), ("order", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())]
    )

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows = []
        for n, (hashes, counts) in enumerate(_block_grams(table.column("text").combine_chunks(), orders), 1):
            cuts = np.append(np.searchsorted(hashes, edges), len(hashes)).tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    rows.append((k, block, n, hashes[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The count table of one partition, joined to what each block asks: its n-grams' counts in all blocks, in its order."""
    columns = {c: table.column(c).to_pylist() for c in ("block", "order", "grams", "counts")}
    grams = [np.frombuffer(g, np.uint64) for g in columns["grams"]]
    counts = [np.frombuffer(c, np.uint32) for c in columns["counts"]]
    distinct, which = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).tolist()
    answers = [total[which[a:b]].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64) for a, b in zip(edges, edges[1:])]
    wide = pa.array([a.dtype.itemsize for a in answers], pa.int32())
    return pa.Table.from_arrays(
        [
            table.column("partition").combine_chunks().cast(pa.int32()),
            pa.array(columns["block"], pa.int64()),
            pa.array(columns["order"], pa.int32()),
            wide,
            pa.array([a.tobytes() for a in answers], pa.binary()),
        ],
        names=["partition", "block", "order", "width", "totals"],
    )


def _own(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own text."""
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    run = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(run)[run] if len(run) else 0
    return out


def score_texts(
    texts: Texts, words: Words, known: list[tuple[np.ndarray, np.ndarray]], all_words: int, alpha: float
) -> dict[str, np.ndarray]:
    """Scores of texts from (sorted hashes, counts in all documents) of each order, less the text's own occurrences."""
    n_words = words.per_doc(texts.count)
    others = (all_words - n_words)[words.doc].astype(np.float64)
    left = []
    for n, (hashes, total) in enumerate(known, 1):
        at, grams = order_grams(words, n)
        count = np.zeros(len(words.doc), np.int64)
        count[at] = total[np.searchsorted(hashes, grams)] - _own(words.doc[at], grams)
        left.append(count)
    # the shortest history first; a longer n-gram that others have replaces it
    logs = np.where(left[0] > 0, np.log(np.maximum(left[0], 1)), math.log(alpha)) - np.log(np.maximum(others, 1))
    used = (left[0] > 0).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]]) if texts.count else np.zeros(0, np.int64)
    place = np.arange(len(words.doc)) - first[words.doc]
    for n in range(2, len(known) + 1):
        possible = place >= n - 1  # earlier words have no history of this length
        seen = possible & (left[n - 1] > 0)
        logs = np.where(possible, math.log(alpha) + logs, logs)
        history = np.concatenate([[1], left[n - 2][:-1]])
        logs = np.where(seen, np.log(np.maximum(left[n - 1], 1)) - np.log(np.maximum(history, 1)), logs)
        used = np.where(seen, n, used)
    return {
        "n_words": n_words,
        "log_score": np.bincount(words.doc, logs, texts.count),
        "n_full": np.bincount(words.doc, used == len(known), texts.count).astype(np.int64),
        "n_unseen": np.bincount(words.doc, used == 0, texts.count).astype(np.int64),
    }


def _scored(orders: int, all_words: int, alpha: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "n_full", "n_unseen"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        column = docs.column("text").combine_chunks()
        order, part = (answers.column(c).to_numpy() for c in ("order", "partition"))
        by = np.lexsort((part, order)).tolist()
        width, totals = answers.column("width").to_pylist(), answers.column("totals").to_pylist()
        known = []
        for n, (hashes, _) in enumerate(_block_grams(column, orders), 1):
            parts = [np.frombuffer(totals[i], f"u{width[i]}").astype(np.int64) for i in by if order[i] == n]
            known.append((hashes, np.concatenate([np.zeros(0, np.int64), *parts])))
        out = []
        for texts in slices(column):
            found = score_texts(texts, find_words(texts, lower=True), known, all_words, alpha)
            ids = docs.column("doc_id").slice(texts.first, texts.count).combine_chunks()
            out.append(pa.table([ids, *(pa.array(found[c], t) for c, t in zip(names[1:], types[1:]))], names=names))
        return pa.concat_tables(out)

    return run


def _word_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(len(find_words(t).doc) for t in slices(batch.column("text")))
        size = pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["words", "bytes"])


def score_documents(docs: DataFrame, orders: int = 2, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, n_full, n_unseen) for every row of ``docs`` (doc_id, text, ...).

    ``log_score`` sums the logarithms of stupid-backoff scores of the words (A-Z in lower
    case): count(history, word) / count(history) with the longest history of up to ``orders`` - 1
    words for which the count isn't 0, times ``alpha`` for each word that the history had to be
    cut by, and at last ``alpha`` / all words for an unseen word. Words near the beginning only have the history
    there is. Counts are over all documents less the text's own occurrences, so a text
    doesn't vouch for itself. ``n_full`` words used the longest history, ``n_unseen`` no count at all.

    Texts are dealt into blocks by a hash of doc_id. A block asks for each of its distinct
    n-grams once, so a frequent n-gram is one entry of each block, however many texts hold it. Count
    partitions are ranges of the n-gram hash; each adds up what all blocks hold and joins it to
    what they ask. The answers go back to the block, where they are summed for each text.
    Null and blank texts score 0 with no words; repeated rows are documents of their own. Other columns
    are ignored; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = map_texts(docs, _word_count, "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    all_words, size = (x or 0 for x in sums)
    blocks = max(4, -(-size // BLOCK_BYTES))
    partitions = max(4, -(-size // PARTITION_BYTES))
    # The salt spreads rows without a doc_id and rows that repeat one.
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).alias("block")
    dealt = docs.select(block, "doc_id", "text").repartition(int(blocks), "block")
    asked = dealt.groupBy("block").applyInArrow(
        _asked(orders, partitions), "partition int, block long, order int, grams binary, counts binary"
    )
    answers = asked.groupBy("partition").applyInArrow(_answered, "partition int, block long, order int, width int, totals binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(orders, all_words, alpha), "doc_id long, n_words long, log_score double, n_full long, n_unseen long"
    )


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
t AS (SELECT rid, i, ws[i] AS w, ws[i - 1] AS h, len(ws) AS n FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM t WHERE i > 1 GROUP BY h, w),
du AS (SELECT rid, w, count(*) AS c FROM t GROUP BY rid, w),
db AS (SELECT rid, h, w, count(*) AS c FROM t WHERE i > 1 GROUP BY rid, h, w),
a AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.rid, t.i, u.c - du.c AS cw, uh.c - dh.c AS ch, b.c - db.c AS cb, greatest(a.n - t.n, 1) AS others
  FROM t JOIN u ON u.w = t.w JOIN du ON du.rid = t.rid AND du.w = t.w
    LEFT JOIN u uh ON uh.w = t.h AND t.i > 1 LEFT JOIN du dh ON dh.rid = t.rid AND dh.w = t.h AND t.i > 1
    LEFT JOIN b ON b.h = t.h AND b.w = t.w AND t.i > 1
    LEFT JOIN db ON db.rid = t.rid AND db.h = t.h AND db.w = t.w AND t.i > 1
    CROSS JOIN a),
f AS (
  SELECT rid, count(*) AS n_words,
    sum(CASE WHEN cb > 0 THEN ln(cb) - ln(greatest(ch, 1))
      ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + CASE WHEN cw > 0 THEN ln(cw) ELSE ln(0.4) END - ln(others) END) AS log_score,
    count(*) FILTER (cb > 0) AS n_full, count(*) FILTER (NOT coalesce(cb > 0, false) AND cw = 0) AS n_unseen
  FROM s GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score,
  CAST(coalesce(n_full, 0) AS BIGINT) AS n_full, CAST(coalesce(n_unseen, 0) AS BIGINT) AS n_unseen
FROM d LEFT JOIN f USING (rid)
"""
