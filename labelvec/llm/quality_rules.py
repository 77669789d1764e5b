"""Rules of single texts, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.text import WHITE, Texts, doc_of, find_words, map_texts, mix, ngrams, powers, run_hashes, slices
from labelvec.session import stage

MAX_DOCS = 20
LEAST_LEFT_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of byte values of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def _sequences(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words that start at ``first``."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(first, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(first, size)
    return mix(np.add.reduceat(hashes * powers(int(size.max()))[place], first) + size.astype(np.uint64))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measured(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of each text; for its lines with a word, hash and number of words after normalisation."""
    data, ends, n = texts.data, texts.ends, texts.count
    words = find_words(texts)
    lower = find_words(texts, lower=True)
    out = {"n_words": words.per_doc(n)}
    out["word_chars"] = _sums(~WHITE[data] & ((data & 0xC0) != 0x80), ends)
    out["n_symbols"] = _sums(_SYMBOL[data], ends)
    start = np.union1d(np.flatnonzero(data == 10) + 1, ends[:-1])
    stop = np.append(start[1:], len(data))
    stop = np.where((stop > start) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(data) else stop
    line = np.searchsorted(start, words.start, "right") - 1
    used, first = np.unique(line, return_index=True)
    doc = words.doc[first]
    raw = run_hashes(data, start[used], stop[used])
    distinct = np.unique(np.stack([doc.astype(np.uint64), raw]), axis=1)[0].astype(np.int64)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(distinct, minlength=n)
    at, grams = ngrams(words, 3)
    again = at[_repeated(mix(grams + mix(words.doc[at].astype(np.uint64) + np.uint64(1))))]
    inside = np.zeros(len(words.doc), bool)
    for k in range(3):
        inside[again + k] = True
    out["n_repeat_words"] = np.bincount(words.doc[inside], minlength=n)
    out["line_doc"], out["line"] = doc, _sequences(first, lower.hash)
    out["line_words"] = np.diff(np.append(first, len(line)))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            found = measured(texts)
            edges = pa.array(np.searchsorted(found["line_doc"], np.arange(texts.count + 1)), pa.int32())
            rows = batch.slice(texts.first, texts.count)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in ("row", "doc_id", "source")),
                    *(pa.array(found[c], pa.int64()) for c in _COUNTS),
                    pa.ListArray.from_arrays(edges, pa.array(found["line"].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(found["line_words"], pa.int32())),
                ],
                names=["row", "doc_id", "source", *_COUNTS, "line", "line_words"],
            )


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT_PERCENT) -> DataFrame:
    """(doc_id, counts, base_failed, removed_words, kept) for every row of ``docs`` (doc_id, text, source, ...).

    A line is normalised to its words, A-Z in lower case. Lines that more than
    ``max_docs`` distinct documents of a host hold are removed. A document is a doc_id, so rows
    that repeat one count once; a row without a doc_id is a document of its own. Copies under
    other ids are other documents. The host is ``source``; null is one host. A document is kept
    if the base rules pass and ``least_left`` percent of its words remain.

    Frequent lines are found by two combined counts over (host, line), and joined back
    on that key; a line that a third of all documents share is split by adaptive
    execution. Null and blank texts have counts 0 and fail. Texts of any length are read
    whole. Repeated rows are rows of their own with equal results. Other columns are ignored; an
    empty table gives no rows.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    fields = f"row long, doc_id long, source string, {counts}, line array<long>, line_words array<int>"
    rows = stage(map_texts(docs, _measure, fields), "measured")
    lines = rows.select("row", "doc_id", "source", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select(
        "row", "doc_id", "x.line_words", F.xxhash64(F.col("source").isNull(), "source", "x.line").alias("line")
    )
    held = lines.select("line", "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("own")).distinct()
    common = held.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("line")
    removed = lines.join(common, "line").groupBy("row").agg(F.sum("line_words").alias("removed_words"))
    rows = rows.drop("line", "line_words").join(removed, "row", "left")
    lost = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = 100 * (F.col("n_words") - lost) >= least_left * F.col("n_words")
    return rows.select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), lost.alias("removed_words"), (~failed & left).alias("kept")
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT rid, t FROM tri GROUP BY ALL HAVING count(*) > 1),
pos AS (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM tri JOIN rep USING (rid, t)),
repeated AS (SELECT rid, count(*) AS n FROM pos GROUP BY rid),
lines AS (
  SELECT rid, doc_id, source, l, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS lw
  FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d)),
used AS (
  SELECT rid, doc_id, source, l, len(lw) AS n,
    translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lines WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM used GROUP BY rid),
common AS (
  SELECT source, norm FROM used GROUP BY source, norm
  HAVING count(DISTINCT doc_id) + count(DISTINCT rid) FILTER (doc_id IS NULL) > {MAX_DOCS}),
lost AS (
  SELECT rid, sum(n) AS n FROM used u JOIN common c ON u.norm = c.norm AND u.source IS NOT DISTINCT FROM c.source GROUP BY rid),
f AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * (n_words - removed_words) >= {LEAST_LEFT_PERCENT} * n_words AS kept
FROM f
"""
