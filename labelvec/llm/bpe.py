"""Byte-pair encoding of whole texts with a pair occurrence index over the words of a partition."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.text import map_texts

# Bytes of text whose distinct words share one index; a longer text is a group of its own.
# Its words are the only Python strings, so memory follows the distinct ones.
GROUP_BYTES = 8 << 20
# Fixed by the tokenizer files: Unicode white space, and the printable stand-ins of bytes.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    spare = count(256)
    return [chr(b if b in PRINTABLE else next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, ranked pairs and pre-tokenizer of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is no BPE file with NFC, white space and lower case")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        names = byte_names()
        self.inner = np.array([ids[n] for n in names], np.int32)
        self.final = np.array([ids[n + end] for n in names], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        spaces = "".join(map(chr, SPACES))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", spaces))
        self.spaces = regex.compile(f"[{spaces}]+")
        # every token with a space before it, and its bounds
        raw = [(" " + t).encode() for t in self.tokens]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it isn't merged."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def parts(self, text: str) -> list[str]:
        """The text between white space. No piece reaches over white space, nor does normalisation."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space for str.split, not for the tokenizer
            return [p for p in self.spaces.split(text) if p]
        return text.split()

    def pieces(self, part: str) -> list[str]:
        """Pieces of a part after normalisation; special tokens stay whole."""
        if self.special and "<|" in part and (found := self.split.findall(part)):
            out, done = [], 0
            for token in found:
                at = part.index(token, done)
                out += [*self.pieces(part[done:at]), token]
                done = at + len(token)
            return out + self.pieces(part[done:])
        # lower case letter by letter: no rule for a sigma at the end of a word
        return self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())


def _alternate(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of two equal symbols, every other one from the left."""
    new = np.concatenate([[True], at[1:] != following[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return (np.arange(len(at)) - start) % 2 == 0


def encode_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, bounds of each word).

    The index maps every pair that has a rank to all its positions in ``words``. Active
    ranks are applied in ascending order, each to all its positions at once; the two
    pairs that a merge makes join the lists of their ranks. A merge only makes pairs with
    a symbol that is its own product, so their ranks are not below its own.
    """
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    symbol = vocabulary.inner[data]
    last = bounds[1:][lengths > 0] - 1
    symbol[last] = vocabulary.final[data[last]]
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    following[last] = -1
    before[bounds[:-1][lengths > 0]] = -1
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray, rank: np.ndarray) -> None:
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cut.tolist(), len(at)]
        for r, lo, hi in zip(rank[starts[:-1]].tolist(), starts, starts[1:]):
            if r in index:
                index[r].append(at[lo:hi])
            else:
                index[r] = [at[lo:hi]]
                heapq.heappush(active, r)

    for lo in range(0, n, 1 << 20):
        pairs = (lo + np.flatnonzero(following[lo : lo + (1 << 20)] >= 0)).astype(np.int32)
        add(pairs, vocabulary.ranks(symbol[pairs], symbol[pairs + 1]))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        left, right, made = vocabulary.left[r], vocabulary.right[r], vocabulary.merged[r]
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        after = following[at]
        good = alive[at] & (symbol[at] == left) & (after >= 0) & (symbol[after] == right)
        at = at[good]
        if not len(at):
            continue
        if len(lists) > 1:
            at = np.sort(at)
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        after = following[at]
        if left == right:
            some = _alternate(at, after)
            at, after = at[some], after[some]
        symbol[at] = made
        alive[after] = False
        beyond = following[after]
        following[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        prior = before[at]
        prior = prior[prior >= 0]
        at = at[has]
        pairs = np.concatenate([prior, at])
        add(pairs, vocabulary.ranks(symbol[pairs], symbol[following[pairs]]))
    kept = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], kept[bounds]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches, cut at whole texts, in lists of about ``GROUP_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        bytes_ = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            done = bytes_[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(bytes_, done + GROUP_BYTES - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(bytes_[min(hi, len(bytes_)) - 1] - done)
            lo = hi
            if size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def part_ids(vocabulary: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts one after the other, bounds of each part)."""
    number: dict[str, int] = defaultdict(count().__next__)
    pieces = [vocabulary.pieces(p) for p in parts]
    sizes = np.array([len(p) for p in pieces], np.int64)
    flat = np.fromiter((number[w] for ws in pieces for w in ws), np.int32, int(sizes.sum()))
    distinct = ["" if w in vocabulary.special else w for w in number]
    ids, bounds = encode_words(vocabulary, distinct)
    lengths = np.diff(bounds)
    special = sorted((number[t], i) for t, i in vocabulary.special.items() if t in number)
    for at, i in special:  # tokens of their own, put behind all others
        bounds[at], lengths[at] = len(ids), 1
        ids = np.append(ids, np.int32(i))
    place, ends = gathered(bounds[flat], lengths[flat])
    return ids[place], ends[np.concatenate([[0], np.cumsum(sizes)])]


def gathered(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of all ranges one after the other, bounds of each range)."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return np.arange(ends[-1]) + np.repeat(start - ends[:-1], length), ends


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for group in _groups(batches):
            number: dict[str, int] = defaultdict(count().__next__)
            read = []
            for batch in group:
                for lo in range(0, batch.num_rows, 250):
                    rows = batch.slice(lo, 250)
                    parts = [vocabulary.parts(t) if t else () for t in rows.column("text").to_pylist()]
                    sizes = np.array([len(p) for p in parts], np.int64)
                    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int32, int(sizes.sum()))
                    read.append((rows.column("doc_id"), sizes, flat))
            del group
            ids, bounds = part_ids(vocabulary, list(number))
            del number
            lengths = np.diff(bounds)
            for doc_id, sizes, flat in read:
                place, ends = gathered(bounds[flat], lengths[flat])
                offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[place], pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_id, tokens], names=["doc_id", "ids"])

    return run


def decoded(vocabulary: Vocabulary, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Texts of the lists ``ids[edges[i] : edges[i + 1]]``: tokens of a file without a decoder are joined by spaces."""
    start = vocabulary.token_bounds[ids]
    length = vocabulary.token_bounds[ids + 1] - start
    first = edges[:-1][np.diff(edges) > 0] - edges[0]
    start[first] += 1
    length[first] -= 1
    place, ends = gathered(start, length)
    offsets = ends[edges - edges[0]].astype(np.int64)
    body = vocabulary.token_bytes[place]
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                rows = batch.slice(lo, 250)
                lists = rows.column("ids")
                edges = np.asarray(lists.offsets)
                texts = decoded(vocabulary, np.asarray(lists.values)[edges[0] : edges[-1]], edges)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), lists, texts.cast(pa.string())], names=["doc_id", "ids", "decoded"]
                )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.asarray(lists.values).astype("<u4")
        edges = np.asarray(lists.offsets)
        sums = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(edges), pa.int64()), pa.array(sums), pa.array(texts)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text, ...), without special tokens added.

    A narrow stage: no shuffle, and memory for about ``GROUP_BYTES`` of text or the longest one. Null and
    blank texts have no ids; strings of special tokens in a text become those tokens, as the
    file asks. Other columns are ignored; repeated rows get equal results; no rows give none.
    """
    return map_texts(_texts(docs), _encode(path), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` to (doc_id, ids); null ids count as none."""
    tokens = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return map_texts(tokens, _decode(path), "doc_id long, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode(path)(_encode(path)(batches))

    return map_texts(_texts(docs), run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode``, ``decode`` and digests in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digest(_decode(path)(_encode(path)(batches)))

    return map_texts(_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
