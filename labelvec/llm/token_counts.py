"""Token counts by a deterministic transducer, whose maps over chunks compose by a parallel prefix scan.

No piece of the model has a space sign behind another character, or spans a
character that occurs in one-character pieces only. So texts fall into units that are
tokenized on their own. The transducer's states are the beginnings of units, named by a
fingerprint; reading a byte inside a unit emits nothing, and the step that ends a
unit is annotated with the number of its tokens. Annotations are compiled from the
pieces' scores for the units that a task meets.

Reading bytes maps a fingerprint (sum, length) to (sum + s**length * c, length + n).
Such maps compose, so chunks are mapped one by one, whatever state they are entered in, and
a scan over the chunks gives the states at their beginnings.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.text import BYTE_CODES, Texts, doc_of, map_texts, mix, powers, slices

CHUNK = 1 << 14
# Annotated units that a worker keeps between groups; beyond half of it they are dropped, and compiled again when met.
MAX_UNITS = 1 << 21
# Texts whose units are compiled together.
GROUP_SLICES = 32
LONG_UNIT = 128
SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_NEVER = np.int32(2**31 - 1)
_LENGTH = np.uint64(0x94D049BB133111EB)


class Pieces(NamedTuple):
    """Symbols (pieces and single characters), ranks of pairs, and bytes that always stand alone."""

    chars: np.ndarray  # sorted characters, as their bytes in a number
    char_symbol: np.ndarray
    keys: np.ndarray  # sorted pairs of symbols
    merged: np.ndarray
    rank: np.ndarray
    cost: np.ndarray  # tokens of a symbol that is left
    alone: np.ndarray


def _char_key(char: str) -> int:
    return int.from_bytes(char.encode(), "big")


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    number = {model.id_to_piece(i): k for k, i in enumerate(plain)}
    if any(SPACE in p.lstrip(SPACE) for p in number):
        raise ValueError(f"{path} has pieces with a space inside")
    scores = sorted({model.get_score(i) for i in plain}, reverse=True)
    rank_of = {s: r for r, s in enumerate(scores)}
    ranks = [rank_of[model.get_score(i)] for i in plain]
    cost = [1] * len(number)
    for piece in [p for p in number if len(p) > 1]:
        for char in piece:
            if char not in number:
                number[char] = len(number)
                cost.append(len(char.encode()))
    pairs = {}
    for piece, k in number.items():
        for cut in range(1, len(piece)):
            left, right = number.get(piece[:cut]), number.get(piece[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) | right] = (k, ranks[k])
    keys = np.array(sorted(pairs), np.int64)
    values = np.array([pairs[k] for k in keys.tolist()], np.int32)
    chars = sorted((_char_key(p), k) for p, k in number.items() if len(p) == 1)
    joined = {c for p in number if len(p) > 1 for c in p}
    alone = np.array([b < 128 and chr(b) != " " and chr(b) not in joined for b in range(256)])
    return Pieces(
        np.array([c for c, _ in chars], np.int64), np.array([k for _, k in chars], np.int64),
        keys, values[:, 0].astype(np.int64), values[:, 1].copy(), np.array(cost, np.int64), alone,
    )


def _pair_ranks(pieces: Pieces, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged symbol) of each pair; unknown characters (-1) and other pairs are never merged."""
    keys = (left << 32) | right
    at = np.minimum(np.searchsorted(pieces.keys, keys), len(pieces.keys) - 1)
    known = (pieces.keys[at] == keys) & (left >= 0) & (right >= 0)
    return np.where(known, pieces.rank[at], _NEVER), pieces.merged[at]


def _symbols(pieces: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, symbol or -1, bytes) of each character."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(data)))
    key = np.zeros(len(start), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        more = size > k
        key[more] = (key[more] << 8) | data[start[more] + k]
    key[key == 0x20] = _char_key(SPACE)
    at = np.minimum(np.searchsorted(pieces.chars, key), len(pieces.chars) - 1)
    return start, np.where(pieces.chars[at] == key, pieces.char_symbol[at], -1), size


def _merge_long(pieces: Pieces, symbols: list[int]) -> list[int]:
    """One long unit by a queue of pairs: least rank first, then the leftmost. A stale entry names symbols that are gone."""
    table = _pair_table(pieces)
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    queue = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := table.get((symbols[i] << 32) | symbols[j])) and symbols[i] >= 0 <= symbols[j]:
            heapq.heappush(queue, (found[1], i, symbols[i], symbols[j], found[0]))

    for i in range(n):
        push(i)
    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], symbols[j] = made, -2
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [s for s in symbols if s != -2]


_tables: dict[int, dict[int, tuple[int, int]]] = {}


def _pair_table(pieces: Pieces) -> dict[int, tuple[int, int]]:
    if id(pieces.keys) not in _tables:
        _tables[id(pieces.keys)] = dict(zip(pieces.keys.tolist(), zip(pieces.merged.tolist(), pieces.rank.tolist())))
    return _tables[id(pieces.keys)]


def unit_tokens(pieces: Pieces, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of tokens of each unit ``data[bounds[i] : bounds[i + 1]]``.

    In every round each unit that still has a pair merges its best one: the highest score, then the leftmost.
    """
    n_units = len(bounds) - 1
    start, symbol, size = _symbols(pieces, data)
    unit = np.searchsorted(bounds, start, "right") - 1
    unknown = symbol < 0
    tokens = np.bincount(unit[unknown], size[unknown], n_units).astype(np.int64)
    counts = np.bincount(unit, minlength=n_units)
    long_ = np.flatnonzero(counts > LONG_UNIT)
    first = np.cumsum(counts) - counts
    for u in long_.tolist():
        left = _merge_long(pieces, symbol[first[u] : first[u] + counts[u]].tolist())
        tokens[u] += sum(int(pieces.cost[s]) for s in left if s >= 0)
    keep = counts[unit] <= LONG_UNIT
    symbol, unit = symbol[keep], unit[keep]
    rank, merged = np.full(len(symbol), _NEVER, np.int32), np.zeros(len(symbol), np.int64)
    same = np.flatnonzero(unit[1:] == unit[:-1])
    rank[same], merged[same] = _pair_ranks(pieces, symbol[same], symbol[same + 1])
    while len(symbol):
        begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        lengths = np.diff(np.append(begin, len(unit)))
        best = np.minimum.reduceat(rank, begin)
        open_ = best < _NEVER
        done = np.repeat(~open_, lengths)
        left = done & (symbol >= 0)
        tokens += np.bincount(unit[left], pieces.cost[symbol[left]], n_units).astype(np.int64)
        if not open_.any():
            break
        hit = np.flatnonzero((rank == np.repeat(best, lengths)) & ~done)
        hit = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])]
        symbol[hit] = merged[hit]
        keep = ~done
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        symbol, unit, rank, merged = symbol[keep], unit[keep], rank[keep], merged[keep]
        at = place[hit]
        rank[at] = _NEVER
        both = np.concatenate([at, at[at > 0] - 1])
        both = both[both + 1 < len(unit)]
        both = both[unit[both] == unit[both + 1]]
        rank[both], merged[both] = _pair_ranks(pieces, symbol[both], symbol[both + 1])
    return tokens


class States(NamedTuple):
    """Maps of consecutive byte ranges: whether a unit begins inside, and (sum, length) read since then."""

    begins: np.ndarray
    total: np.ndarray
    length: np.ndarray


def scan(states: States) -> States:
    """All prefixes of the composition, by doubling steps."""
    begins, total, length = (x.copy() for x in states)
    step = 1
    while step < len(begins):
        here = np.flatnonzero(~begins[step:]) + step
        before = here - step
        sums = total[before] + powers(int(length[before].max(initial=0)) + 1)[length[before]] * total[here]
        lengths, starts = length[before] + length[here], begins[before]
        total[here], length[here], begins[here] = sums, lengths, starts
        step *= 2
    return States(begins, total, length)


def unit_states(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprint of the state at the end of every unit; units cover ``data`` from the first of ``starts`` on."""
    cuts = np.arange(0, len(data), CHUNK)
    part = np.union1d(starts, cuts)
    size = np.diff(np.append(part, len(data)))
    place = np.arange(len(data)) - np.repeat(part, size)
    total = np.add.reduceat(BYTE_CODES[data] * powers(int(size.max()))[place], part)
    fresh = np.zeros(len(part), bool)
    fresh[np.searchsorted(part, starts)] = True
    last = np.append(np.searchsorted(part, cuts[1:]), len(part)) - 1  # of each chunk
    exits = scan(States(fresh[last], total[last], size[last].astype(np.int64)))
    chunk = np.flatnonzero(~fresh[np.searchsorted(part, cuts)])  # entered inside a unit
    head = np.searchsorted(part, cuts[chunk])
    entry_total, entry_length = exits.total[chunk - 1], exits.length[chunk - 1]
    length = size.astype(np.int64)
    total[head] = entry_total + powers(int(entry_length.max(initial=0)) + 1)[entry_length] * total[head]
    length[head] += entry_length
    end = np.append(np.searchsorted(part, starts[1:]), len(part)) - 1
    return mix(total[end] + length[end].astype(np.uint64) * _LENGTH)


def unit_starts(data: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> np.ndarray:
    space = data == 0x20
    begins = alone[data]
    begins[1:] |= (space[1:] & ~space[:-1]) | begins[:-1]
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def with_prefix(texts: Texts) -> Texts:
    """Texts with the model's space sign in front; the sign itself in a text is a space."""
    data, ends = texts.data, texts.ends
    if _SPACE_BYTES in (body := data.tobytes()):
        parts = [body[a:b].replace(_SPACE_BYTES, b" ") for a, b in zip(ends[:-1], ends[1:])]
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    used = np.diff(ends) > 0
    data = np.insert(data, ends[:-1][used], 0x20)
    return Texts(data, ends + np.concatenate([[0], np.cumsum(used)]), texts.first)


class Transducer:
    """Annotations of the unit ends met so far: sorted fingerprints and their numbers of tokens."""

    def __init__(self, path: str):
        self.pieces = pieces_of(path)
        self.state, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def compile(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Add the units of (fingerprints, first bytes, ends, data) that aren't known."""
        states = np.concatenate([f[0] for f in found])
        states, first = np.unique(states, return_index=True)
        if len(self.state):
            at = np.minimum(np.searchsorted(self.state, states), len(self.state) - 1)
            new = self.state[at] != states
            states, first = states[new], first[new]
        if not len(states):
            return
        pieces, sizes = [], np.zeros(len(states), np.int64)
        offset, order = 0, np.argsort(first, kind="stable")
        k = 0
        for hashes, start, stop, data in found:
            hi = k + int(np.searchsorted(first[order[k:]], offset + len(hashes)))
            mine = order[k:hi]
            local = first[mine] - offset
            size = stop[local] - start[local]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[local], size)
            pieces.append(data[place])
            sizes[k:hi] = size
            offset, k = offset + len(hashes), hi
        counted = unit_tokens(self.pieces, np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)]))
        states, tokens = states[order], counted
        state = np.concatenate([self.state, states])
        by = np.argsort(state, kind="stable")
        self.state, self.tokens = state[by], np.concatenate([self.tokens, tokens])[by]

    def run(self, group: list[Texts]) -> Iterator[tuple[Texts, np.ndarray]]:
        """(texts, number of tokens of each) for every slice of the group."""
        read, found = [], []
        for texts in group:
            given = with_prefix(texts)
            starts = unit_starts(given.data, given.ends, self.pieces.alone)
            if not len(starts):
                read.append((texts, starts, starts, starts))
                continue
            states = unit_states(given.data, starts)
            distinct, first, which = np.unique(states, return_index=True, return_inverse=True)
            stop = np.append(starts[1:], len(given.data))
            found.append((distinct, starts[first], stop[first], given.data))
            read.append((texts, distinct, which, doc_of(given.ends, starts)))
        if found:
            if len(self.state) > MAX_UNITS // 2:
                self.state, self.tokens = self.state[:0], self.tokens[:0]
            self.compile(found)
        for texts, distinct, which, doc in read:
            if not len(doc):
                yield texts, np.zeros(texts.count, np.int64)
                continue
            tokens = self.tokens[np.searchsorted(self.state, distinct)]
            yield texts, np.bincount(doc, tokens[which], texts.count).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _transducer(path: str) -> Transducer:
    return Transducer(path)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(path)
        for batch in batches:
            group: list[Texts] = []
            for texts in [*slices(batch.column("text")), None]:
                if texts is not None:
                    group.append(texts)
                if group and (texts is None or len(group) == GROUP_SLICES):
                    for part, tokens in transducer.run(group):
                        ids = batch.column("doc_id").slice(part.first, part.count)
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array(np.diff(part.ends), pa.int64()), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"]
                        )
                    group = []

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text, ...).

    Counts equal those of the model's own library without added tokens. Null and empty texts
    have none. A narrow stage without a shuffle; memory follows the longest text. Other columns
    are ignored; repeated rows get equal results; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = map_texts(docs, _counts(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
