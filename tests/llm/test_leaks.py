import random
import re
from collections import defaultdict

import pytest
from brute import LOWER, SCHEMA, prose



from labelvec.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id string, text string, doc_id long, key string, n int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items):
    """One (doc_id, n_words, n_hit, spans, items) for each row."""
    runs = defaultdict(set)
    for name, text in items:
        own = words(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            runs[tuple(own[i : i + n])].add(name)
    sizes = {len(r) for r in runs}
    out = []
    for doc, text in docs:
        own = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (run := tuple(own[i : i + n])) in runs:
                    hit |= set(range(i, i + n))
                    found |= runs[run]
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc, len(own), len(hit), str(spans), str(sorted(found - {None}))))
    return sorted(out, key=str)


def told(frame):
    rows = frame.collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, str([[s.first, s.last] for s in r["spans"]]), str(list(r["items"]))) for r in rows), key=str)


def planted(seed, n_docs=60, n_items=25, short=True):
    rng = random.Random(seed)
    items = []
    for i in range(n_items):
        n = rng.choice([1, 3, 9, 10, 11, 14, 30]) if short else rng.choice([10, 11, 14, 30])
        items.append((str(i), prose(rng, n)))
    shared = prose(rng, 13)
    items += [("a", shared), ("b", "Of old: " + shared.upper()), ("a", prose(rng, 12)), (None, prose(rng, 15)), (None, None), ("e", ""), ("e2", " .. ")]
    docs = []
    for d in range(n_docs):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(prose(rng, rng.randrange(1, 40)))
            piece = words(rng.choice([t for _, t in items if t]))
            a = rng.randrange(0, 4)
            parts.append(rng.choice([" ", ", ", "\n--"]).join(piece[a:] if rng.random() < 0.5 else piece).title())
        docs.append((d, " ".join(parts)))
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(d, t, None, "a", 1, 2, "c", 3, "s") for d, t in docs], SCHEMA).repartition(4)
    return left, spark.createDataFrame([(i, t, 5, "k", 9) for i, t in items], ITEMS).repartition(2)


@pytest.mark.parametrize(("seed", "short"), [(1, True), (2, False)])
def test_hits_equal_brute_force(spark, seed, short):
    docs, items = planted(seed, short=short)
    docs += [docs[3], docs[4], (None, docs[5][1]), (999, docs[5][1]), (None, docs[3][1])]
    assert told(decontaminate.leaks(*frames(spark, docs, items))) == by_hand(docs, items)


def test_odd_rows(spark, odd, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows]
    long = words(odd_rows[9][1])
    items = [("x", " ".join(long[20_000:20_030])), ("y", odd_rows[0][1]), ("z", "straße àéîÉ ÑANDÚ"), ("s", "SAME LINE"), ("é", "中文 😀")]
    got = told(decontaminate.leaks(odd, frames(spark, [], items)[1]))
    assert got == by_hand(docs, items)


def test_no_documents_and_no_items(spark, odd, nothing):
    docs, items = planted(4, 5)
    left, right = frames(spark, docs, items)
    assert decontaminate.leaks(nothing, right).count() == 0
    none = decontaminate.leaks(left, spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == 5 and all(r.n_hit == 0 and r["items"] == [] for r in none)


def test_a_passage_in_all_documents_and_items_is_no_product(spark):
    rng = random.Random(6)
    passage = prose(rng, 20)
    items = [(f"{i:03}", passage + " " + prose(rng, 5)) for i in range(200)]
    docs = [(d, prose(rng, 10) + " " + passage) for d in range(300)]
    assert told(decontaminate.leaks(*frames(spark, docs, items))) == by_hand(docs, items)


def test_every_shared_run_keeps_a_common_gram(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, 30, 5)) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", decontaminate.winnowed(decontaminate.words_of("text")).alias("kept"))
    kept = {r.doc_id: {(v >> 32, v & 0xFFFFFFFF) for v in r.kept} for r in frame.collect()}
    for d, text in docs:
        other = words(prose(rng, 7, 5)) + words(text)[8:18] + words(prose(rng, 9, 5))
        text = spark.createDataFrame([(" ".join(other),)], "text string").select(decontaminate.winnowed(decontaminate.words_of("text"))).first()[0] if d < 4 else None
        if text is not None:
            mine = {h for h, at in kept[d] if 8 <= at <= 13}
            assert mine & {v >> 32 for v in text if 7 <= (v & 0xFFFFFFFF) <= 12}


def test_is_native(spark, odd):
    plan = decontaminate.leaks(odd, frames(spark, *planted(5, 3))[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
