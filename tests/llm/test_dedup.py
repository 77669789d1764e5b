import random
from collections import Counter

import numpy as np
import pytest
from brute import prose, words
from pyspark.sql import functions as F

from labelvec.llm import near_dedup, suffix_dedup
from labelvec.llm.graph import connected_components


def components(sets, percent):
    """Least id reachable over links between all pairs of sets."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def shingles(text, width):
    ws = words(text, lower=True)
    if len(ws) < width:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}


def families(n_groups=12, size=14, seed=1):
    """Groups of edits of edits, so that members are linked by chains; ids are shuffled."""
    rng = random.Random(seed)
    texts = []
    for g in range(n_groups):
        base = prose(rng, 60 + 10 * g).split(" ")
        members = [base]
        for _ in range(size):
            new = list(rng.choice(members))
            for _ in range(rng.randrange(1, 4)):
                new[rng.randrange(len(new))] = f"w{rng.randrange(1000)}"
            members.append(new)
        texts += [" ".join(m) for m in members] + [" ".join(base).upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width, monkeypatch):
    # small blocks, so that buckets are compared in many of them
    monkeypatch.setattr(near_dedup, "PROBE_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "BASE_SHINGLES", 800)
    texts = families()
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, width).collect()}
    sets = {3 * i: shingles(t, width) for i, t in enumerate(texts)}
    want = components(sets, 80)
    assert len(set(want.values())) < len(texts) / 2
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(sets[i]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(odd, odd_rows, nothing):
    got = near_dedup.near_duplicates(odd, 2).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].component_id for i in (10, 11, 12, 13, 14, 15)] == [10, 10, 10, 13, 14, 15]
    assert by_id[17].component_id == by_id[18].component_id == 17
    assert all(r.kept and r.component_id is None or r.n_shingles for r in got if r.doc_id is None)
    kept = near_dedup.keep_one(odd, 2)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[10] == ids[13] == ids[21] == 1 and ids[11] == ids[12] == ids[18] == 0 and ids[None] == 2
    assert near_dedup.near_duplicates(nothing).count() == near_dedup.keep_one(nothing).count() == 0


def test_texts_under_one_id_are_not_lost(spark):
    rng = random.Random(8)
    a, b = prose(rng, 90), prose(rng, 90)
    rows = [(5, a, "x"), (5, b, "y"), (5, b, "x"), (5, b, None), (9, prose(rng, 50), "z"), (9, None, "z"), (9, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    got = sorted(map(str, near_dedup.keep_one(docs.repartition(4)).collect()))
    assert got == sorted(map(str, near_dedup.keep_one(docs.coalesce(1)).collect()))
    kept = [(r.doc_id, r.text, r.note) for r in near_dedup.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


def test_minima_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64)
    marks = [near_dedup.minima(a + np.uint64(k)) for k in (0, 111)]
    assert abs((marks[0] == marks[1]).mean() - 889 / 1111) < 0.1


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] * 2
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.id for r in rows}) == 41 + 60 + 2
    assert {r.id: r.component for r in rows} == {
        **{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 299: 299, 300: 299
    }
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def marked(texts, least=50):
    """Words of each (id, text), ids rising, in a window that stood before."""
    seen, out = set(), {}
    for i, t in texts:
        ws, hit = words(t), set()
        for k in range(len(ws) - least + 1):
            window = tuple(ws[k : k + least])
            if window in seen:
                hit.update(range(k, k + least))
            seen.add(window)
        out[i] = hit
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_repeated_passages_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SUFFIXES", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 50)
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (49, 50, 51, 70, 140, 400)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(5, 120)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split(" ")
            a = rng.randrange(max(1, len(p) - 60))
            parts.insert(rng.randrange(3), " ".join(p[a : a + rng.randrange(45, 200)]))
        texts.append((i * 5, "  ".join(parts)))
    texts += [(400, "na " * 300), (401, "na " * 60 + prose(rng, 30)), (402, texts[3][1]), (403, passages[1]), (404, passages[0])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs).collect()}
    want = marked(texts)
    assert sum(map(len, want.values())) > 1000
    assert set(got) == {i for i in want if want[i]}
    for i, t in texts:
        if i not in got:
            continue
        spans = got[i].spans
        assert got[i].origins and all(o <= i for o in got[i].origins)
        assert {k for s in spans for k in range(s["first"], s["last"])} == want[i], i
        assert (got[i].n_words, got[i].dup_words, got[i].n_spans) == (len(words(t)), len(want[i]), len(spans))
    left = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs).collect()}
    for i, t in texts:
        rest = [w for k, w in enumerate(words(t)) if k not in want[i]]
        assert words(left.get(i)) == rest and (i in left) == bool(rest)


def test_repeats_of_odd_rows(odd, odd_rows, nothing):
    by_id = {r.doc_id: r for r in suffix_dedup.repeated_passages(odd).collect()}
    assert not {10, 13, 14, 15, 16, None} & set(by_id)
    assert by_id[11].dup_words == by_id[11].n_words and by_id[11].origins == [10]
    assert by_id[22].dup_words >= 60 and by_id[22].origins == [21]
    clash = odd.selectExpr("*", "1 AS spans", "'a' AS _of", "2.5D AS _cuts", "doc_id AS ORIGINS")
    assert sorted(map(str, suffix_dedup.cut_repeats(clash).drop("spans", "_of", "_cuts", "ORIGINS").collect())) == sorted(map(str, suffix_dedup.cut_repeats(odd).collect()))
    cut = suffix_dedup.cut_repeats(odd)
    assert cut.columns == odd.columns
    rows = cut.collect()
    assert Counter(r.doc_id for r in rows)[10] == 2 and 11 not in {r.doc_id for r in rows}
    assert all(r.text is None for r in rows if r.doc_id == 13)
    assert suffix_dedup.repeated_passages(nothing).count() == suffix_dedup.cut_repeats(nothing).count() == 0


def first_holders(texts, least=50):
    """Documents of each (id, text), ids rising, that hold the first occurrences of its repeated windows."""
    first, out = {}, {}
    for i, t in texts:
        ws = words(t)
        for k in range(len(ws) - least + 1):
            holder = first.setdefault(tuple(ws[k : k + least]), (i, k))
            if holder != (i, k):
                out.setdefault(i, set()).add(holder[0])
    return {i: sorted(s) for i, s in out.items()}


@pytest.mark.parametrize("hot", [512, 2])
def test_origins_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SUFFIXES", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 50)
    rng = random.Random(3)
    long = prose(rng, 300).split(" ")
    # pieces of one passage, so that a document's windows stand first in several documents
    texts = [(i, prose(rng, 10) + " " + " ".join(long[a : a + rng.randrange(60, 160)])) for i in range(40) for a in [rng.randrange(200)]]
    texts += [(50, " ".join(long)), (51, "la li " * 200), (52, "li la " * 90 + " ".join(long[100:180]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = first_holders(texts)
    assert max(map(len, want.values())) > 2
    for layout in (1, 5):
        got = suffix_dedup.repeated_passages(docs.repartition(layout)).collect()
        assert {r.doc_id: r.origins for r in got} == want


def test_no_block_grows_with_one_text_or_repeated_rows(spark, monkeypatch):
    texts = [(1, "na " * 40_000), (2, "na " * 30), (3, "la li lo " * 5_000)] + [(4, "na " * 700)] * 40
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 50)
    kept = suffix_dedup.retained_suffixes(docs)
    blocks = suffix_dedup.dealt_suffixes(docs, kept).groupBy("gram", "salt").agg(F.countDistinct("doc_id", "at").alias("n"))
    assert blocks.agg(F.max("n")).first()[0] <= 20 * suffix_dedup.HOT_SUFFIXES
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs, kept).collect()}
    assert [(r["first"], r["last"]) for r in got[1].spans] == [(1, 40_000)] and got[1].origins == [1]
    assert [(r["first"], r["last"]) for r in got[3].spans] == [(3, 15_000)] and got[3].origins == [3]
    assert [(r["first"], r["last"]) for r in got[4].spans] == [(0, 700)] and got[4].origins == [1]
    assert set(got) == {1, 3, 4}


def test_spans_of_a_text_and_mark_become_one():
    rng = random.Random(4)
    rows = [(rng.randrange(3), a := rng.randrange(60), a + rng.randrange(1, 9), rng.randrange(2)) for _ in range(80)]
    got = suffix_dedup._adjoining(*(np.array(c) for c in zip(*rows)))
    spans = list(zip(*(c.tolist() for c in got)))
    for doc in range(3):
        for mark in range(2):
            want = {k for d, a, b, m in rows if (d, m) == (doc, mark) for k in range(a, b)}
            own = sorted((a, b) for d, a, b, m in spans if (d, m) == (doc, mark))
            assert {k for a, b in own for k in range(a, b)} == want
            assert all(b < c for (_, b), (c, _) in zip(own, own[1:]))
