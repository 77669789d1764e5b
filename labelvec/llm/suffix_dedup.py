"""Repeated passages from sparse suffix arrays over words.

Only suffixes at minimiser positions are retained: the least of every ``STEP``
consecutive word grams. Two equal passages of ``MIN_WORDS`` words hold the same
minimiser at the same place, so every repeated passage is seen from a retained
suffix that lies inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.text import Texts, Words, find_words, map_texts, mix, ngrams, slices
from labelvec.session import stage

MIN_WORDS = 50
GRAM = 16
STEP = MIN_WORDS - GRAM + 1
LEFT = STEP - 1
WIDTH = LEFT + MIN_WORDS
# Retained suffixes that share a gram are compared in one block up to this number. More are dealt
# to several blocks by text and range of positions; what the blocks keep is then compared by a grouped minimum.
HOT_SUFFIXES = 512
DEAL_WORDS = 512
CHUNK_ROWS = 30_000


def minimisers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, hash, low, high) of the least gram of every window of ``STEP`` grams; the first of equals.

    A gram is the least of the windows that begin ``low`` to ``high`` words before it.
    """
    at, grams = ngrams(words, GRAM)
    if len(at) < STEP:
        return at[:0], grams[:0], at[:0], at[:0]
    least, place, size = grams, np.arange(len(at)), 1
    while size < STEP:
        shift = min(size, STEP - size)
        later = least[shift:] < least[:-shift]
        least = np.where(later, least[shift:], least[:-shift])
        place = np.where(later, place[shift:], place[:-shift])
        size += shift
    inside = np.flatnonzero(words.doc[at[: len(place)]] == words.doc[at[STEP - 1 :]])
    chosen, first = np.unique(place[inside], return_index=True)
    last = np.append(first[1:], len(inside)) - 1
    return at[chosen], grams[chosen], at[chosen] - at[inside[last]], at[chosen] - at[inside[first]]


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("at", pa.list_(pa.int32())), ("gram", pa.list_(pa.int64()))]
    )
    for batch in batches:
        for texts in slices(batch.column("text")):
            words = find_words(texts)
            counts = words.per_doc(texts.count)
            first = np.cumsum(counts) - counts
            at, grams, _, _ = minimisers(words)
            doc = words.doc[at]
            bounds = pa.array(np.searchsorted(doc, np.arange(texts.count + 1)), pa.int32())
            lists = [
                pa.ListArray.from_arrays(bounds, pa.array(at - first[doc], pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(grams.view(np.int64))),
            ]
            ids = batch.column("doc_id").slice(texts.first, texts.count)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), *lists], schema=schema)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around every suffix as 32-bit codes: ``LEFT`` before it, ``MIN_WORDS`` from it; ``low`` and ``high`` as above."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("at", pa.int32()), ("gram", pa.int64()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("deal", pa.int64()), ("around", pa.binary())]
    )
    for batch in batches:
        for texts in slices(batch.column("text")):
            words = find_words(texts)
            counts = words.per_doc(texts.count)
            lists = batch.column("places").slice(texts.first, texts.count)
            doc = np.repeat(np.arange(texts.count), lists.value_lengths().to_numpy())
            at, often = (lists.flatten().field(c).to_numpy() for c in ("at", "n"))
            fits = at < counts[doc]
            doc, at, often = doc[fits], at[fits], often[fits]
            place = at + (np.cumsum(counts) - counts)[doc]
            codes = np.concatenate([np.zeros(LEFT, np.uint32), words.hash.astype(np.uint32), np.zeros(MIN_WORDS, np.uint32)])
            gram_at, gram, low, high = minimisers(words)
            known = np.searchsorted(gram_at, place)
            good = (known < len(gram_at)) & (gram_at[np.minimum(known, max(0, len(gram_at) - 1))] == place) if len(gram_at) else np.zeros(len(place), bool)
            doc, at, often, place, known = doc[good], at[good], often[good], place[good], known[good]
            ids = np.asarray(batch.column("doc_id").slice(texts.first, texts.count))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash, dtype=np.uint64)])
            ends = np.cumsum(counts)
            deal = mix(mix(sums[ends] - sums[ends - counts])[doc] + at.astype(np.uint64) // np.uint64(DEAL_WORDS)).view(np.int64)
            for lo in range(0, len(at), 4096):
                part = slice(lo, lo + 4096)
                around = codes[place[part, None] + np.arange(WIDTH)]
                flat = pa.py_buffer(np.ascontiguousarray(around).tobytes())
                edges = pa.py_buffer((np.arange(len(around) + 1, dtype=np.int32) * 4 * WIDTH).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[doc[part]], pa.int64()),
                        pa.array(at[part], pa.int32()),
                        pa.array(gram[known[part]].view(np.int64)),
                        pa.array(often[part], pa.int64()),
                        pa.array(low[known[part]], pa.int32()),
                        pa.array(high[known[part]], pa.int32()),
                        pa.array(deal[part], pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(around), [None, edges, flat]),
                    ],
                    schema=schema,
                )


def matched(doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, earliest text) of passages that stood before, from retained suffixes; a row for each earliest text.

    Suffixes are sorted by their words and neighbours compared, which gives the length
    of their common prefix. For each number ``o`` of words to the left, suffixes in one
    run of common prefixes of ``MIN_WORDS - o`` words match if their ``o`` words before
    are equal too; all but the earliest (doc, at) of such a set are repeats. Rows of
    one (doc, at) are one occurrence. Each window is looked at from its own least gram only, which
    all its occurrences hold at the same place, so the earliest one is among the rows.
    """
    suffix = np.ascontiguousarray(around[:, LEFT:].astype(">u4"))
    order = np.argsort(suffix.view(f"S{4 * MIN_WORDS}").ravel(), kind="stable")
    around, doc_s, at_s, low, high = around[order], doc[order], at[order], low[order], high[order]
    equal = around[1:, LEFT:] == around[:-1, LEFT:]
    common = np.where(equal.all(axis=1), MIN_WORDS, (~equal).argmax(axis=1))
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((at_s, doc_s))] = np.arange(len(order))
    lead = np.zeros(len(order), np.uint64)
    found = []
    for o in range(STEP):
        if o:
            lead = mix(lead + around[:, LEFT - o].astype(np.uint64) + np.uint64(o))
        run = np.concatenate([[0], np.cumsum(common < MIN_WORDS - o)]).astype(np.uint64)
        rows = np.flatnonzero((low <= o) & (o <= high))
        key = mix(lead[rows] ^ mix(run[rows] + np.uint64(1)))
        by = np.lexsort((rank[rows], key))
        rows, key = rows[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        least = rows[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        repeat = (doc_s[rows] != doc_s[least]) | (at_s[rows] != at_s[least])
        later = rows[repeat]
        found.append((later, at_s[later].astype(np.int64) - o, doc_s[least[repeat]]))
    row, first, origin = (np.concatenate(x) for x in zip(*found))
    row, first, last, origin = _joined(row, first, origin)
    return order[row], first, last, origin


def _joined(row: np.ndarray, first: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, mark) of the distinct marks of every row; its windows overlap at its gram, so they are one span."""
    by = np.lexsort((mark, row))
    row, first, mark = row[by], first[by], mark[by]
    new = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    edges = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    if len(row):
        begin, end = np.minimum.reduceat(first, edges)[which], np.maximum.reduceat(first, edges)[which] + MIN_WORDS
    else:
        begin = end = first
    keep = new.copy()
    keep[1:] |= mark[1:] != mark[:-1]
    return row[keep], begin[keep], end[keep], mark[keep]


def _adjoining(doc: np.ndarray, first: np.ndarray, last: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of a text with one mark, as one row where they overlap or touch: a repeated line is one span, not one for each suffix."""
    if not len(doc):
        return doc, first, last, mark
    by = np.lexsort((first, mark, doc))
    doc, first, last, mark = doc[by], first[by].astype(np.int64), last[by].astype(np.int64), mark[by]
    own = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
    # Words of a text are fewer than 2**31, so each text and mark has a range of its own.
    reached = np.maximum.accumulate(last + (own << 32))
    begins = np.flatnonzero(np.concatenate([[True], first[1:] + (own[1:] << 32) > reached[:-1]]))
    ends = np.append(begins[1:], len(doc)) - 1
    return doc[begins], first[begins], reached[ends] - (own[ends] << 32), mark[begins]


def least_windows(
    doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray, seed: int
) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What a block of a hot gram holds: its distinct windows of ``MIN_WORDS`` words, and its repeats of them.

    (hash, text, first word, group) of the windows where they stand first; (row, first, last, group) of the
    repeats. Windows that the same texts repeat are one group, as they share the texts that
    their earliest occurrences are origins of.
    """
    around = around.astype(np.uint64)
    found = []
    for o in range(STEP):
        rows = np.flatnonzero((low <= o) & (o <= high))
        window = np.zeros(len(rows), np.uint64)
        for k in range(LEFT - o, LEFT - o + MIN_WORDS):
            window = mix(window + around[rows, k])
        found.append((window, rows, at[rows].astype(np.int64) - o))
    window, row, first = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((first, doc[row], window))
    window, row, first = window[by], row[by], first[by]
    who = doc[row]
    new = np.concatenate([[True], window[1:] != window[:-1]])[: len(window)]
    which = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    repeat = (who != who[head[which]]) | (first != first[head[which]])
    # a text counts once for each window
    r = np.flatnonzero(repeat)
    once = np.ones(len(r), bool)
    once[1:] = (which[r[1:]] != which[r[:-1]]) | (who[r[1:]] != who[r[:-1]])
    group = np.zeros(len(head), np.uint64)
    np.add.at(group, which[r[once]], mix(who[r[once]].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    group = mix(group + np.uint64(seed)).view(np.int64)
    return (window[new], who[new], first[new], group), _joined(row[r], first[r], group[which[r]])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within blocks, and (``window``) what blocks of a hot gram hold, to be compared with other blocks.

    Rows arrive sorted by block (gram, salt); they are compared in chunks that end between blocks. Repeats
    in blocks of a hot gram have a ``part``, a group of windows, instead of an origin.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("origin", pa.int64()), ("window", pa.int64()), ("part", pa.int64())]
    )
    held: pa.Table | None = None
    full = CHUNK_ROWS

    def rows(doc, first, last, origin=None, window=None, part=None) -> pa.RecordBatch:
        columns = [pa.nulls(len(doc), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (origin, window, part)]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first, pa.int32()), pa.array(last, pa.int32()), *columns], schema=schema)

    def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, at, low, high, n, gram, salt = (part.column(c).to_numpy() for c in ("doc_id", "at", "low", "high", "n", "gram", "salt"))
        around = np.frombuffer(b"".join(part.column("around").to_pylist()), np.uint32).reshape(-1, WIDTH)
        edges = np.flatnonzero(_changes(part)) + 1
        begin = np.concatenate([[0], edges])
        hot = np.maximum.reduceat(n, begin) > HOT_SUFFIXES
        alone = np.flatnonzero(~np.repeat(hot, np.diff(np.append(begin, len(n)))))
        if len(alone):
            row, first, last, origin = matched(doc[alone], at[alone], low[alone], high[alone], around[alone])
            who, first, last, origin = _adjoining(doc[alone][row], first, last, origin)
            yield rows(who, first, last, origin=origin)
        for a, b in zip(begin[hot].tolist(), np.append(edges, len(n))[hot].tolist()):
            seed = int(mix(gram[a : a + 1].view(np.uint64) + salt[a : a + 1].astype(np.uint64))[0])
            (window, who, first, group), (row, start, end, mark) = least_windows(doc[a:b], at[a:b], low[a:b], high[a:b], around[a:b], seed)
            yield rows(who, first, first + MIN_WORDS, window=window.view(np.int64), part=group)
            who, start, end, mark = _adjoining(doc[a:b][row], start, end, mark)
            yield rows(who, start, end, part=mark)

    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows >= full:
            changes = np.flatnonzero(_changes(held))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from done(held.slice(0, cut))
                held, full = held.slice(cut), CHUNK_ROWS
            else:
                held = held.group_by(held.column_names).aggregate([])  # rows that repeat a doc_id and its text
                full = max(CHUNK_ROWS, 2 * held.num_rows)
    if held is not None and held.num_rows:
        yield from done(held)


def _changes(part: pa.Table) -> np.ndarray:
    """Rows after which another block begins."""
    gram, salt = part.column("gram").to_numpy(), part.column("salt").to_numpy()
    return (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])


def retained_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, at, gram): number of words and retained suffixes of every row, staged."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(map_texts(docs, _retain, "doc_id long, n_words long, at array<int>, gram array<long>"), "suffixes")


def dealt_suffixes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Suffixes whose gram occurs more than once, with their words and block (gram, salt).

    A block holds about ``HOT_SUFFIXES`` suffixes, and never more than a few ranges of ``DEAL_WORDS`` words of a text.
    """
    suffixes = kept.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("at", "gram")).alias("s"))
    suffixes = suffixes.select("doc_id", "s.at", "s.gram")
    often = suffixes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    places = suffixes.join(often, "gram").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = "doc_id long, at int, gram long, n long, low int, high int, deal long, around binary"
    salt = F.pmod(F.xxhash64("doc_id", "deal"), F.ceil(F.col("n") / HOT_SUFFIXES)).cast("int")
    return map_texts(texts.join(places, "doc_id"), _contexts, fields).withColumn("salt", salt).drop("deal")


def repeats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, spans, origins): word ranges [first, last) that repeat an earlier passage of ``MIN_WORDS`` words or more.

    ``origins`` are the documents that hold the earliest occurrences of its windows of ``MIN_WORDS`` words, whatever the blocks.

    ``kept`` comes from ``retained_suffixes``. Suffixes whose gram occurs once are
    dropped after a combined count. The others are dealt out by gram, in blocks of about
    ``HOT_SUFFIXES``, and sorted and compared where they arrive. Blocks of one gram then
    exchange their distinct windows, of which each block keeps the earliest occurrence.
    """
    blocks = dealt_suffixes(docs, kept)
    blocks = blocks.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    found = stage(map_texts(blocks, _compare, "doc_id long, first int, last int, origin long, window long, part long"), "repeats")
    spans, heads = found.where("window is null").drop("window"), found.where("window is not null")
    earliest = heads.groupBy("window").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    heads = heads.drop("origin").join(earliest, "window").withColumn("origin", F.col("least.doc_id"))
    later = heads.where(F.struct("doc_id", "first") > F.col("least")).select("doc_id", "first", "last", "origin")
    among = spans.where("part is not null").drop("origin").join(heads.select("part", "origin").distinct(), "part")
    fields = ["doc_id", "first", "last", "origin"]
    spans = spans.where("part is null").select(fields).union(among.select(fields)).union(later)
    origins = F.array_sort(F.collect_set("origin")).alias("origins")
    return stage(spans.groupBy("doc_id").agg(_merged(F.collect_set(F.struct("first", "last"))), origins), "spans")


def _merged(spans):
    """Overlapping and adjoining ranges as one, in order."""
    one = "struct<first:int,last:int>"
    start = F.array().cast(f"array<{one}>")

    def add(done, s):
        end = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))),
        )
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["last"] < s["first"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(joined)

    return F.aggregate(F.array_sort(spans), start, add).alias("spans")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, dup_words, n_spans, spans, origins) of the ``docs`` (doc_id, text, ...) that repeat a passage.

    A word is repeated if a run of 50 words or more around it also occurs at a smaller
    (doc_id, position); the earliest occurrence is never marked, its document is one of
    ``origins``. Words are compared by their bytes, white space isn't compared. ``spans`` are
    word ranges [first, last). Null, blank and short texts repeat nothing. Rows that repeat a doc_id count as one
    document and get equal results; rows without a doc_id take no part.
    """
    kept = retained_suffixes(docs)
    out = kept.select("doc_id", "n_words").join(repeats(docs, kept), "doc_id")
    dup = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.select("doc_id", "n_words", dup.alias("dup_words"), F.size("spans").alias("n_spans"), "spans", "origins")


def _cut(columns: list[str], cuts: str):
    """Leave out the words of the column ``cuts``, each with the white space after it; texts without words left go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(cuts).to_pylist()
            column, at = batch.column("text"), batch.schema.get_field_index("text")
            texts, keep = column.to_pylist(), np.ones(batch.num_rows, bool)
            for part in slices(column):
                words = None
                for i in range(part.count):
                    row = part.first + i
                    if not spans[row]:
                        continue
                    words = words or find_words(part)
                    mine = words.start[np.searchsorted(words.doc, i) : np.searchsorted(words.doc, i, "right")]
                    edges = np.append(mine, part.ends[i + 1])
                    pieces, done = [], int(part.ends[i])
                    for s in spans[row]:
                        pieces.append(part.data[done : edges[min(s["first"], len(mine))]].tobytes())
                        done = int(edges[min(s["last"], len(mine))])
                    pieces.append(part.data[done : part.ends[i + 1]].tobytes())
                    texts[row] = b"".join(pieces).decode()
                    keep[row] = bool(texts[row].strip(" \t\n\v\f\r"))
            new = pa.array(texts, column.type)
            arrays = [new if k == at else batch.column(k) for k in range(batch.num_columns)]
            out = pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep))
            yield out.select(columns)

    return run


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; a document of which no word is left goes.

    Columns stay, whatever their names; an ``n_chars`` column follows the text of changed documents. Null, empty and short texts
    stay as they are; rows that repeat a doc_id are cut alike, those without one not at all. No rows give none.
    """
    of, cuts = (_unused(name, docs.columns) for name in ("_of", "_cuts"))
    spans = repeats(docs, retained_suffixes(docs)).select(F.col("doc_id").alias(of), F.col("spans").alias(cuts))
    joined = docs.join(spans, F.col("doc_id") == F.col(of), "left").drop(of)
    out = map_texts(joined, _cut(docs.columns, cuts), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
