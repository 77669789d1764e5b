import math
import pathlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import prose, words

from labelvec.llm import language_id, lm_scoring, queries, quality_crf, quality_rules

SF_DIR = "/root/testdata/sf0.01"
with_data = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="no test data")


# ---------------------------------------------------------------- language model


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_backoff_scores_equal_brute_force(spark, odd, odd_rows, orders, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(lm_scoring, "PARTITION_BYTES", 20_000)
    texts = [words(r[1], lower=True) for r in odd_rows]
    grams = lambda ws: Counter(tuple(ws[i : i + n]) for n in range(1, orders + 1) for i in range(len(ws) - n + 1))
    own = [grams(ws) for ws in texts]
    total = sum(own, Counter())
    n_all = sum(map(len, texts))
    want = defaultdict(list)
    for row, ws, mine in zip(odd_rows, texts, own):
        count = lambda g: total[g] - mine[g]
        score, full, unseen = 0.0, 0, 0
        for i in range(len(ws)):
            longest = min(orders, i + 1)
            for n in range(longest, -1, -1):
                gram = tuple(ws[i - n + 1 : i + 1])
                if n and count(gram):
                    below = count(gram[:-1]) if n > 1 else max(1, n_all - len(ws))
                    score += math.log(count(gram) / max(1, below))
                    break
                if not n:
                    score -= math.log(max(1, n_all - len(ws)))
                    unseen += 1
                score += math.log(0.4) if n else 0
            full += n == orders
        want[row[0]].append((len(ws), round(score, 6), full, unseen))
    got = defaultdict(list)
    for r in lm_scoring.score_documents(odd, orders).collect():
        got[r.doc_id].append((r.n_words, round(r.log_score, 6), r.n_full, r.n_unseen))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_backoff_without_rows(nothing):
    assert lm_scoring.score_documents(nothing).count() == 0


# ---------------------------------------------------------------- rules


def rules(rows, max_docs, least_left):
    holders = defaultdict(set)
    for place, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if words(line):
                holders[r[3], tuple(words(line, lower=True))].add((place, None) if r[0] is None else r[0])
    out = []
    for r in rows:
        text, ws = r[1] or "", words(r[1])
        lines = [x for x in text.split("\n") if words(x)]
        windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        repeat = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        lost = sum(len(words(x)) for x in lines if len(holders[r[3], tuple(words(x, lower=True))]) > max_docs)
        failed = len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)
        kept = not failed and 100 * (len(ws) - lost) >= least_left * len(ws)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((r[0], len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(repeat), failed, lost, kept))
    return sorted(out, key=repr)


def test_rules_equal_brute_force(spark, odd, odd_rows, nothing):
    got = quality_rules.quality_rules(odd)
    assert sorted(map(tuple, got.collect()), key=repr) == rules(odd_rows, 20, 50)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_frequent_lines_deplete(spark):
    common = [" ".join(f"shared{k}x{j}" for j in range(11)) for k in range(4)]
    rows = []
    for i in range(40):
        own = " ".join(f"word{i}x{k}" for k in range(60 if i % 2 else 20))
        rows.append((i, "\n".join([own, *common[1:], f"  {common[0].upper()} "]), None, "a" if i < 30 else None))
    rows += [(100 + i, rows[1][1], None, "b") for i in range(30)]  # copies are documents of their own
    rows += [(200, rows[1][1], None, "c")] * 30 + [(None, rows[1][1], None, "d")] * 30  # one document; thirty
    docs = spark.createDataFrame([r[:2] + r[3:] for r in rows], "doc_id long, text string, source string")
    got = sorted(map(tuple, quality_rules.quality_rules(docs, 20, 50).collect()), key=repr)
    assert got == rules(rows, 20, 50)
    kept = {r[0]: r[-1] for r in got}
    assert not kept[0] and kept[1] and kept[31] and kept[200]
    lost = {r[0]: r[-2] for r in got}
    assert lost[100] == lost[None] == len(words(rows[1][1])) and lost[200] == 0 and not kept[100] and not kept[None]


# ---------------------------------------------------------------- language


@with_data
def test_languages_of_held_out_rows(spark):
    got = queries.QUERIES["op4_language_id"](spark, SF_DIR)
    rows = got.join(queries.documents(spark, SF_DIR).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd, odd_rows, nothing):
    train = spark.createDataFrame([("the cat and the dog " * 9, "en"), ("el gato y la niña " * 9, "es"), (None, "fr"), ("x", None)], "text string, lang string")
    names, matrix = language_id.prototypes(train)
    assert names == ["en", "es"]
    got = language_id.languages(odd, names, matrix).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0) for i in (13, 14, 15))
    assert all(by_id[i].lang_pred in names for i in (10, 19, 23))
    assert language_id.languages(nothing, names, matrix).count() == 0
    none = language_id.prototypes(nothing)
    assert none[0] == [] and {r.lang_pred for r in language_id.languages(odd, *none).collect()} == {"und"}


def sums_by_hand(text):
    """Sum over the letters of ``text`` of the product of turned vectors of each letter and its neighbours."""
    points = [ord(c) if c.isalpha() else 0 for c in " " + (text or "").lower() + " "]
    vectors = {p: language_id.letter_vectors(np.array([p]))[0].astype(int) for p in set(points)}
    total = np.zeros(language_id.SIZE, int)
    for a, b, c in zip(points, points[1:], points[2:]):
        if b:
            total += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return total


FEW_WORDS = {
    "el": "και το σπίτι είναι μεγάλο με πολλά παράθυρα",
    "ru": "и этот дом очень большой и у него много окон",
    "ko": "그리고 이 집은 매우 크고 창문이 많이 있습니다",
    "fr": "et cette maison était très grande où les fenêtres brûlent",
    "en": "and this house is very big and it has many windows",
}


@pytest.mark.parametrize("held", [64, language_id.TRIGRAMS])
def test_profiles_equal_sums_by_hand(spark, odd, odd_rows, monkeypatch, held):
    monkeypatch.setattr(language_id, "TRIGRAMS", held)
    texts = [t for t in FEW_WORDS.values()] + ["", "?", FEW_WORDS["ko"] * 3, "".join(map(chr, range(0xAC00, 0xAC00 + 300)))]
    trigrams, seen = language_id.Trigrams(), set()
    for some in (texts, texts[::-1]):
        for i, got in language_id.profiles(trigrams, len(some), *language_id.trigram_codes(some)):
            assert (got == sums_by_hand(some[i])).all()
            seen.add(some[i])
        assert len(trigrams.codes) <= held
    assert seen == set(texts) - {"", "?"}


def test_predictions_equal_profiles_by_hand(spark, odd, odd_rows):
    rows = [(text, name) for name, text in FEW_WORDS.items() for _ in range(2)] + [("the dog and the cat", "en"), (None, "xx")]
    names, matrix = language_id.prototypes(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert names == sorted(FEW_WORDS)
    want = np.array([sum(sums_by_hand(t) for t, lang in rows if lang == name) for name in names], float)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(matrix, want)
    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.languages(odd, names, matrix).collect()}
    expected = set()
    for r in odd_rows:
        total = sums_by_hand(r[1])
        cosine = want @ total / max(np.linalg.norm(total), 1e-9)
        best = int(cosine.argmax())
        expected.add((r[0], names[best], round(max(cosine[best], 0.0), 6)) if total.any() else (r[0], "und", 0.0))
    assert got == expected


def test_letters_have_vectors_of_their_own():
    for lo, hi in ((0x61, 0x7A), (0xE0, 0xFF), (0x3B1, 0x3C9), (0x430, 0x44F), (0xAC00, 0xD7A3)):
        vectors = language_id.letter_vectors(np.arange(lo, hi + 1))
        assert len(np.unique(vectors, axis=0)) == hi - lo + 1


# ---------------------------------------------------------------- classifier


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    sizes = [3, 1, 5, 2]
    doc = np.repeat(np.arange(4), sizes)
    unary, switch = rng.normal(size=(len(doc), 2)), rng.normal(size=(2, 2))
    got, pairs = quality_crf.forward_backward(quality_crf.chain_of(doc), unary, switch)
    want_pairs = np.zeros((2, 2))
    for d in range(4):
        u = unary[doc == d]
        paths = list(itertools.product((0, 1), repeat=len(u)))
        weight = np.array([math.exp(sum(u[i, s] for i, s in enumerate(p)) + sum(switch[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for i in range(len(u)):
            assert got[doc == d][i, 1] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[i]))
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(pairs, want_pairs)


@with_data
def test_quality_of_held_out_rows(spark):
    got = queries.QUERIES["op7_quality_crf"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95


def test_quality_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame(
        [(10, 1), (19, 1), (12, 1), (24, 0), (20, 0), (16, None), (17, 7), (10, 1), (None, 0), (999, 1)], "doc_id long, quality int"
    )
    model = quality_crf.train(odd, labels)
    got = quality_crf.quality_scores(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[13] == by_id[14] == by_id[15] == 0 and by_id[10] > 0.7 > by_id[24]
    kept = quality_crf.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score >= 0.7)
    assert quality_crf.quality_scores(nothing, model).count() == quality_crf.keep_good(nothing, model).count() == 0
    unfitted = quality_crf.train(odd, labels.where("doc_id is null"))
    assert quality_crf.quality_scores(odd, unfitted).count() == len(odd_rows)


@with_data
def test_a_registered_query_uses_runs_of_three_words(spark):
    path = "/root/testdata/sf0.001"
    full = {n: {(r.doc_id, r.n_words): r.n_full for r in queries.QUERIES[n](spark, path).collect()} for n in ("op1_lm_scoring", "op1_lm_scoring_trigrams")}
    pairs, threes = full["op1_lm_scoring"], full["op1_lm_scoring_trigrams"]
    assert pairs.keys() == threes.keys()
    assert all(threes[k] <= pairs[k] for k in pairs) and 0 < sum(threes.values()) < sum(pairs.values())


def labelled(rng, n, longest):
    rows = []
    for i in range(n):
        good, lines = i % 2, 1 + rng.randrange(longest)
        line = (lambda: prose(rng, 12).replace("\n", " ") + ".") if good else (lambda: "$$$ ### | &&& %%% " + "X" * rng.randrange(1, 9))
        rows.append((i, "\n".join(line() for _ in range(lines)), good))
    return rows


def test_long_documents_are_fitted_and_lines_are_bounded(spark, monkeypatch):
    import random

    rows = labelled(random.Random(4), 40, 300)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, "another text under one id")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    fitted = []
    real = quality_crf.fit
    monkeypatch.setattr(quality_crf, "fit", lambda doc, lines, label, share: fitted.append((doc, label)) or real(doc, lines, label, share))
    model = quality_crf.train(docs, labels)
    counts = {i: len(t.split("\n")) for i, t, _ in rows} | {3: 1}
    assert sorted(np.bincount(fitted[0][0])) == sorted(counts.values()) and max(counts.values()) > 4 * quality_crf.CHAIN_LINES
    again = quality_crf.train(docs.coalesce(1), labels)
    assert (again.weights == model.weights).all() and again[2:] == model[2:]
    scores = {r.doc_id: r.score for r in quality_crf.quality_scores(docs.where("doc_id <> 3"), model).collect()}
    assert all((scores[i] >= 0.5) == bool(q) for i, _, q in rows if i != 3)

    order = [r.doc_id for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS o").orderBy("o").collect()]
    monkeypatch.setattr(quality_crf, "SAMPLE_LINES", 700)
    quality_crf.train(docs, labels)
    for q in (0, 1):
        left, want = 700, []
        for i in (i for i in order if i % 2 == q):
            if counts[i] > left:
                break
            left -= counts[i]
            want.append(counts[i])
        doc, label = fitted[-1]
        assert np.bincount(doc)[label == q].tolist() == want
