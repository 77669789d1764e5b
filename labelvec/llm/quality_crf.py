"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score uses features of the line and of the lines
before and after it; the chain adds a score for each change of state. Marginals of the
states, weighted by length, make the quality of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from labelvec.llm.text import WHITE, Texts, doc_of, find_words, map_texts, slices
from labelvec.session import stage

# Bounds of the training sample: rows and lines of each label.
SAMPLE_DOCS = 2048
SAMPLE_LINES = 65_536
# In the fit a chain of states ends after so many lines; features look across the cut.
CHAIN_LINES = 64
STEPS = 150
LEVELS = (0.02, 0.1, 0.3)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[np.frombuffer(chars.encode(), np.uint8)] = 1
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = [_table("#*$%&<>^~_\\{}[]"), _table("|"), _table("!?"), _UPPER, _table("0123456789"), _table(".,;:")]
_NEWLINE = np.uint8(10)
BASE = (len(_CLASSES) + 2) * (1 + len(LEVELS)) + 4
SIZE = 3 * BASE + 1


class Lines(NamedTuple):
    """Lines that have a word, in text order: text number, length in bytes, own features."""

    doc: np.ndarray
    length: np.ndarray
    own: np.ndarray


def lines_of(texts: Texts) -> Lines:
    data, ends = texts.data, texts.ends
    words = find_words(texts)
    if not len(words.doc):
        return Lines(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, BASE), np.float32))
    start = np.union1d(np.flatnonzero(data == _NEWLINE) + 1, ends[:-1])
    start = start[start < len(data)]
    line = np.searchsorted(start, words.start, "right") - 1  # of each word
    used, first = np.unique(line, return_index=True)
    n_words = np.diff(np.append(first, len(line))).astype(np.float32)
    stop = np.append(start[1:], len(data))[used]
    start = start[used]
    bounds = np.stack([start, stop], axis=1).ravel()

    def total(values: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each line."""
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return (sums[bounds[1::2]] - sums[bounds[::2]]).astype(np.float32)

    length = total(~WHITE[data])
    shares = [total(table[data]) / length for table in _CLASSES]
    same = np.zeros(len(line), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((words.hash, line))
    again = np.zeros(len(line), bool)
    again[order[1:]] = (words.hash[order[1:]] == words.hash[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    shares += [np.add.reduceat(x.astype(np.float32), first) / n_words for x in (same, again)]
    columns = []
    for share in shares:
        columns += [share, *[(share > level).astype(np.float32) for level in LEVELS]]
    end_mark = _table(".!?")[data[words.end[np.append(first[1:], len(line)) - 1] - 1]]
    columns += [np.log1p(n_words) / 8, length / n_words / 16, end_mark, _UPPER[data[words.start[first]]]]
    return Lines(words.doc[first], length, np.stack(columns, axis=1).astype(np.float32))


def with_neighbours(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after within the text, and a constant."""
    out = np.zeros((len(own), SIZE), np.float32)
    out[:, :BASE] = own
    same = np.flatnonzero(doc[1:] == doc[:-1])
    out[same + 1, BASE : 2 * BASE] = own[same]
    out[same, 2 * BASE : 3 * BASE] = own[same + 1]
    out[:, -1] = 1
    return out


class Chain(NamedTuple):
    """Texts in order of falling number of lines, so that step t works on the first ``active[t]``."""

    first: np.ndarray
    active: list[int]


def chain_of(doc: np.ndarray) -> Chain:
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(doc)))
    order = np.argsort(-counts, kind="stable")
    rising = np.sort(counts)
    steps = np.arange(rising[-1] if len(rising) else 0)
    return Chain(first[order], (len(counts) - np.searchsorted(rising, steps, "right")).tolist())


def forward_backward(chain: Chain, unary: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of the states of every line, expected number of each change of state).

    ``unary`` (lines, 2) and ``switch`` (2, 2) are scores. Sums are scaled at every step.
    """
    power = np.exp(unary - unary.max(axis=1, keepdims=True))
    moves = np.exp(switch)
    ahead = np.empty_like(power)
    for t, n in enumerate(chain.active):
        rows = chain.first[:n] + t
        value = power[rows] if t == 0 else (ahead[rows - 1] @ moves) * power[rows]
        ahead[rows] = value / value.sum(axis=1, keepdims=True)
    back = np.ones_like(power)
    pairs = np.zeros((2, 2))
    for t in range(len(chain.active) - 1, 0, -1):
        rows = chain.first[: chain.active[t]] + t
        later = power[rows] * back[rows]
        joint = ahead[rows - 1][:, :, None] * moves * later[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = later @ moves.T
        back[rows - 1] = value / value.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True), pairs


class Model(NamedTuple):
    """Weights for "good", scores of changes of state, and the logistic scale of a document's quality."""

    weights: np.ndarray
    switch: np.ndarray
    slope: float
    shift: float


def good_lines(model: Model, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    score = with_neighbours(doc, own) @ model.weights
    unary = np.stack([np.zeros_like(score), score], axis=1).astype(np.float64)
    return forward_backward(chain_of(doc), unary, model.switch)[0][:, 1]


def document_quality(n_docs: int, lines: Lines, good: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals; 0 for texts without a word."""
    total = np.bincount(lines.doc, lines.length, n_docs)
    return np.bincount(lines.doc, lines.length * good, n_docs) / np.maximum(total, 1)


def scaled(model: Model, quality: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * _logit(quality) + model.shift, -500, 500)))


def _logit(quality: np.ndarray) -> np.ndarray:
    return -np.log(1.02 - np.clip(quality, 0, 1))


def _fit_chain(doc: np.ndarray, features: np.ndarray, state: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 term, by Adam steps over all lines of the sample, in chains of ``CHAIN_LINES``."""
    begun = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    place = np.arange(len(doc)) - np.repeat(begun, np.diff(np.append(begun, len(doc))))
    doc = np.cumsum(place % CHAIN_LINES == 0) - 1  # of each line, its chain
    chain = chain_of(doc)
    weights, switch = np.zeros(features.shape[1]), np.zeros((2, 2))
    within = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[within], state[within + 1]), 1)
    x, n = features.astype(np.float64), len(doc)
    mean, square = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, STEPS + 1):
        score = x @ weights
        marginal, pairs = forward_backward(chain, np.stack([np.zeros(n), score], axis=1), switch)
        slope = np.concatenate([x.T @ (weight * (state - marginal[:, 1])), (seen - pairs).ravel()]) / n
        slope -= 1e-3 * np.concatenate([weights, switch.ravel()])
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, switch = weights + move[:-4], switch + move[-4:].reshape(2, 2)
    return weights, switch


def fit(doc: np.ndarray, lines: Lines, label: np.ndarray, share: np.ndarray) -> Model:
    """``label`` (0 or 1) is known of whole texts; ``share`` weighs a label as in all labelled rows.

    Lines of good texts are good. Lines of bad texts start as bad; those that the first
    fit finds good, but for the worst of each text, are good in the second fit.
    """
    if not len(doc):
        return Model(np.zeros(SIZE), np.zeros((2, 2)), 0.0, 0.0)
    features = with_neighbours(doc, lines.own)
    state = label[doc].astype(np.int64)
    weight = np.ones(len(doc))
    model = None
    for _ in range(3):
        model = Model(*_fit_chain(doc, features, state, weight), 1.0, 0.0)
        good = good_lines(model, doc, lines.own)
        worst = np.full(len(label), 2.0)
        np.minimum.at(worst, doc, good)
        state = np.where((label[doc] == 1) | ((good > 0.5) & (good > worst[doc])), 1, 0)
    held = np.unique(doc)
    z = _logit(document_quality(len(label), lines, good_lines(model, doc, lines.own))[held])
    y, w = label[held].astype(float), share[label[held]]
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps; the L2 term keeps separable samples finite
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([(w * (y - p) * z).sum() - 0.1 * slope, (w * (y - p)).sum() - 0.01 * shift])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        change = np.linalg.solve(h, g)
        slope, shift = slope + np.clip(change[0], -2, 2), shift + np.clip(change[1], -2, 2)
    return Model(model.weights, model.switch, float(slope), float(shift))


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("quality", pa.int32()), ("order", pa.int64()), ("n_lines", pa.int64()), ("length", pa.binary()), ("own", pa.binary())])
    for batch in batches:
        for texts in slices(batch.column("text")):
            lines = lines_of(texts)
            edges = np.searchsorted(lines.doc, np.arange(texts.count + 1))
            few = np.flatnonzero((np.diff(edges) > 0) & (np.diff(edges) <= SAMPLE_LINES))  # what no sample can hold stays here
            part = [slice(edges[i], edges[i + 1]) for i in few]
            rows = pa.array(few + texts.first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("quality").take(rows),
                    batch.column("order").take(rows),
                    pa.array(np.diff(edges)[few]),
                    pa.array([lines.length[p].tobytes() for p in part], pa.binary()),
                    pa.array([lines.own[p].tobytes() for p in part], pa.binary()),
                ],
                schema=schema,
            )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents of any length, at most ``SAMPLE_DOCS`` and ``SAMPLE_LINES`` lines of each label.

    Documents are taken whole in hash order until the next one would exceed the lines; one that exceeds them by itself
    is passed over. ``labels`` has (doc_id, quality); nulls and other values than 0 and 1 are left out, the greater of two
    labels holds. Of different texts under one doc_id the one with the fewest lines is taken, then the least by
    its features, so reruns agree. Without usable rows all scores are alike.
    """
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    marked = marked.withColumn("order", F.xxhash64("doc_id"))
    parts = [marked.where(F.col("quality") == q).orderBy("order", "doc_id").limit(SAMPLE_DOCS) for q in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # 2 * SAMPLE_DOCS rows of three numbers
    fields = "quality int, order long, n_lines long, length binary, own binary"
    rows = map_texts(docs.select("doc_id", "text").join(chosen, "doc_id").select("quality", "order", "text"), _sample_lines, fields)
    columns = ["quality", "n_lines", "length", "own"]
    rows = stage(rows, "sample").groupBy("order").agg(F.min(F.struct(*columns)).alias("x")).select("order", "x.*")
    sizes = rows.select("order", "quality", "n_lines").orderBy("order").collect()
    taken = F.lit(False)
    for q in (0, 1):
        own = [r for r in sizes if r["quality"] == q]
        if end := int(np.searchsorted(np.cumsum([r["n_lines"] for r in own]), SAMPLE_LINES, "right")):
            taken |= (F.col("quality") == q) & (F.col("order") <= own[end - 1]["order"])
    found = rows.where(taken).orderBy("order").collect()
    counted = [len(r["length"]) // 4 for r in found]
    doc = np.repeat(np.arange(len(found)), counted)
    length = np.frombuffer(b"".join(bytes(r["length"]) for r in found), np.float32)
    own = np.frombuffer(b"".join(bytes(r["own"]) for r in found), np.float32).reshape(-1, BASE)
    label = np.array([r["quality"] for r in found], np.int64)
    seen = np.bincount(label, minlength=2)
    share = np.array([counts.get(q, 0) / max(1, seen[q]) for q in (0, 1)])
    return fit(doc, Lines(doc, length, own), label, share / max(share.max(), 1e-9))


def _scores(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                lines = lines_of(texts)
                quality = document_quality(texts.count, lines, good_lines(model, lines.doc, lines.own))
                score = np.where(np.bincount(lines.doc, minlength=texts.count) > 0, scaled(model, quality), 0.0)
                rows = batch.slice(texts.first, texts.count).select(columns)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(score)], names=[*columns, "score"]
                )

    return run


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text, ...), in one pass without a shuffle.

    Only the text is read for a score. Null texts and texts without a word score 0.
    Equal texts score alike. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(docs, _scores(model, ["doc_id"]), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """Rows of ``docs`` whose text scores ``least`` or more, with all their columns; texts of any length are scored whole."""
    columns = docs.columns
    given = docs.select(F.struct(*columns).alias("row"), "text")
    schema = StructType([given.schema["row"], StructField("score", DoubleType())])
    return map_texts(given, _scores(model, ["row"]), schema).where(F.col("score") >= least).select("row.*")
