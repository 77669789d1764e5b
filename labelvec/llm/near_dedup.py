"""MinHash near-duplicates: universal hash minima, banding, verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelvec.llm.graph import connected_components
from labelvec.llm.text import Texts, find_words, map_texts, mix, ngrams, slices
from labelvec.session import broadcast_if_small, stage

BANDS, ROWS = 42, 6
MINIMA = BANDS * ROWS
# Five standard deviations of the estimate from MINIMA agreements, at a similarity of 0.8.
SLACK = 5 * (0.8 * 0.2 / MINIMA) ** 0.5
# A slice has at most 1,024 texts: ten bits of a sort key; the other 54 hold the shingle.
_SHINGLE_BITS = np.uint64(54)
_SHINGLE_MASK = np.uint64((1 << 54) - 1)
# Shingles of the two sides of one comparison task.
PROBE_SHINGLES, BASE_SHINGLES = 20_000, 400_000

_seed = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_A = (_seed[:MINIMA] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_seed[MINIMA:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, bounds of each text)."""
    words = find_words(texts, lower=True)
    at, hashes = ngrams(words, width)
    doc = words.doc[at]
    counts = words.per_doc(texts.count)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # the whole sequence is one shingle
        first = np.cumsum(counts) - counts
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = counts[short] > k
            whole[more] = mix(whole[more] + words.hash[first[short[more]] + k] + np.uint64(k + 1))
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, whole])
    keys = np.sort((doc.astype(np.uint64) << _SHINGLE_BITS) | (hashes & _SHINGLE_MASK))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    edges = np.arange(texts.count + 1, dtype=np.uint64) << _SHINGLE_BITS
    if texts.count == 1 << 10:
        bounds = np.append(np.searchsorted(keys, edges[:-1]), len(keys))
    else:
        bounds = np.searchsorted(keys, edges)
    return keys & _SHINGLE_MASK, bounds


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of every hash ``a * x + b`` modulo 2**32 (a odd) over a shingle set; its low half."""
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(least, (x[lo : lo + 512, None] * _A + _B).min(axis=0), out=least)
    return least.astype(np.uint16)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if small == 0 or 100 * small < percent * large:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (small + large - both)


def _features(width: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("minima", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                shingles, bounds = shingle_sets(texts, width)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(k)))]) for k in (1, 2)]
                sums = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
                sizes = np.diff(bounds)
                digests, rows, seen = [], [], {}
                for i in range(texts.count):
                    digest = sums[i].tobytes() + int(sizes[i]).to_bytes(8, "little")
                    if digest not in seen:
                        seen[digest] = minima(shingles[bounds[i] : bounds[i + 1]]).tobytes()
                    digests.append(digest)
                    rows.append(seen[digest])
                ids = batch.column("doc_id").slice(texts.first, texts.count)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())],
                    schema=schema,
                )

    return run


def _estimated(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Share of equal minima in each pair."""
    sides = [np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, MINIMA) for x in (left, right)]
    return (sides[0] == sides[1]).mean(axis=1)


def _by_signature(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _estimated(batch.column("minima_a"), batch.column("minima_b")) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets_of(texts: list[str], width: int) -> list[np.ndarray]:
    out = []
    for part in slices(pa.array(texts, pa.large_string())):
        shingles, bounds = shingle_sets(part, width)
        out += [shingles[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def _by_sets(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = dict(zip(part.column("a").to_pylist(), part.column("text_a").to_pylist()))
                left = dict(zip(texts, _sets_of(list(texts.values()), width)))
                right = _sets_of(part.column("text_b").to_pylist(), width)
                keep = [similar(left[a], b, percent) for a, b in zip(part.column("a").to_pylist(), right)]
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _compare(width: int, percent: int, least: float):
    """Links between probes and the documents of one block of a bucket, at most one for each set of linked documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = _sets_of(rows["text"].tolist(), width)
        marks = np.frombuffer(b"".join(rows["minima"]), np.uint16).reshape(-1, MINIMA)
        bands = marks.reshape(-1, BANDS, ROWS)
        ids, parts, probe = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["probe"].to_numpy()
        band = int(rows["band"].iloc[0])
        root = {c: c for c in set(parts.tolist())}

        def top(c):
            while root[c] != c:
                c = root[c]
            return c

        links = []
        base = np.flatnonzero(~probe)
        for i in np.flatnonzero(probe):
            near = base[(marks[base] == marks[i]).mean(axis=1) >= least]
            # a pair is examined in the first band that both share, and only there
            shared = (bands[near] == bands[i]).all(axis=2)
            for j in near[shared.argmax(axis=1) == band]:
                p, q = top(int(parts[i])), top(int(parts[j]))
                if p != q and similar(sets[i], sets[j], percent):
                    root[max(p, q)] = min(p, q)
                    links.append((int(ids[i]), int(ids[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _band_rows(reps: DataFrame) -> DataFrame:
    """(band, key, id) for every representative and band."""
    keys = F.array(*[F.xxhash64(F.substring("minima", 2 * ROWS * b + 1, 2 * ROWS), F.lit(b)) for b in range(BANDS)])
    return reps.select("id", F.posexplode(keys).alias("band", "key"))


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the ids in ``wanted``, one row each. Up to a million ids go to the texts, else they meet by a shuffle."""
    wanted = stage(wanted, "wanted")
    return texts.join(broadcast_if_small(wanted), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def links_of(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect all similar ``reps`` (id, n_shingles, minima).

    First each bucket's least member is compared with the others. That joins most of a
    group of near copies with work in proportion to its size. Where a bucket still
    holds several components, every member outside the pivot's component is compared
    with all members of other components, in blocks of bounded size; the two sides
    of a block meet in one task, and only links leave it.
    """
    least = percent / 100 - SLACK
    rows = _band_rows(reps)
    pivots = rows.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = stage(rows.join(pivots, ["band", "key"]), "buckets")
    marks = reps.select("id", "minima")
    pairs = buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(marks.toDF("a", "minima_a"), "a").join(marks.toDF("b", "minima_b"), "b")
    pairs = stage(map_texts(pairs, _by_signature(least), "a long, b long"), "pairs")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = _texts_of(texts, wanted)
    near = pairs.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b")
    first = stage(map_texts(near, _by_sets(width, percent), "a long, b long").distinct(), "links")

    known = stage(connected_components(first), "linked")
    named = buckets.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = reps.select("id", "n_shingles")
    named = named.join(sizes, "id")
    mine = F.max(F.when(F.col("id") == F.col("pivot"), F.col("component")))
    open_ = (
        named.groupBy("band", "key")
        .agg(mine.alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n_shingles").alias("size"))
        .where("lo <> hi")
    )
    members = stage(named.join(open_, ["band", "key"]).drop("lo", "hi"), "members")
    probes = members.where("component <> main")
    blocks = probes.groupBy("band", "key").agg(F.sum("n_shingles").alias("probe_size"))
    members = members.join(blocks, ["band", "key"])
    n_base = F.ceil(F.col("size") / BASE_SHINGLES).cast("int")
    n_probe = F.ceil(F.col("probe_size") / PROBE_SHINGLES).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    base = members.select("band", "key", "id", "component", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), n_probe - 1)).alias("i"), own(n_base).alias("j"))
    probe = members.where("component <> main").select(
        "band", "key", "id", "component", F.lit(True).alias("probe"), own(n_probe).alias("i"), F.explode(F.sequence(F.lit(0), n_base - 1)).alias("j")
    )
    both = base.union(probe)
    dealt = both.join(marks, "id").join(_texts_of(texts, both.select("id").distinct()), "id")
    rest = dealt.groupBy("band", "key", "i", "j").applyInPandas(_compare(width, percent, least), "a long, b long")
    return stage(first.union(rest).distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets
    of ``width``-word shingles (A-Z lower-cased). Documents with equal sets are one
    class, named by its least doc_id; links are sought between classes only, so copies
    are never paired. ``component_id`` is the least doc_id reachable; ``kept`` marks it.

    With r = 6 rows in 42 bands a pair at 0.8 is missed with probability 3e-6; links are
    confirmed on whole sets. Null or blank texts have no shingle, are linked with
    nothing and kept. Fewer than ``width`` words form one shingle. Rows without a
    doc_id are never linked: component_id null, kept. Repeated rows get equal
    results. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stage(
        map_texts(docs, _features(width), "doc_id long, n_shingles long, digest binary, minima binary"), "minima"
    )
    real = marked.where("doc_id is not null and n_shingles > 0")
    reps = real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima"))
    reps = stage(reps, "classes")
    # An id may be repeated with other texts; then it stands for its first class only.
    reps = reps.groupBy("id").agg(F.min_by(F.struct("n_shingles", "minima", "digest"), "digest").alias("x")).select("id", "x.*")
    found = connected_components(links_of(docs, reps, width, percent))
    classes = reps.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    plain = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = marked.join(classes, "digest", "left").select("doc_id", "n_shingles", plain.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, with all their columns.

    Rows repeated with one doc_id and text are one document, of which one row stays: the least when written as JSON. Different
    texts under one doc_id all stay if one of them is kept, so no text is lost. Rows without a doc_id all stay.
    """
    found = near_duplicates(docs, width, percent).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    kept = stage(ids.where("kept").select("doc_id", "n"), "kept")
    named = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if kept.where("n > 1").limit(1).count():
        twice = kept.where("n > 1").select("doc_id")
        whole = F.struct(*docs.columns)
        one = named.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("least"))
        named = named.join(twice, "doc_id", "left_anti").select(docs.columns).union(one.select("least.*"))
    return named.select(docs.columns).union(docs.where("doc_id is null").select(named.columns)).select(docs.columns)
