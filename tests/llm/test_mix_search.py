import pathlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import prose, words

from labelvec.llm import mixing, topk

# ---------------------------------------------------------------- mixing


def reshared(sizes, weights, share, most):
    """Targets by handing the excess on until no source is above its limit."""
    total, target, full = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        level = rest / sum(weights[i] for i in free) if free else 0
        target = [most * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        above = {i for i in free if target[i] > most * sizes[i]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 1000, rng.randrange(10_000)]) for _ in range(23)]
    names = [f"s{i:02}" for i in range(22)] + [None]
    rows = list(zip(names, sizes))
    got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()
    want = reshared(sizes, [(3, 1, 2)[i % 3] for i in range(23)], 1.5, 2.0)
    assert [r.source for r in sorted(got, key=lambda r: r.src)] == names
    assert [r.target for r in sorted(got, key=lambda r: r.src)] == pytest.approx(want)


@pytest.mark.parametrize("seed", range(6))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(5):
        n, seats = rng.randrange(1, 9), rng.choice([0, 1, 3, 50, 1000])
        rows += [(g, k, float(rng.choice([0, 1, 5, 5, 400, rng.randrange(1, 3000)])) + (k == 0), seats) for k in range(n)]
    want = Counter()
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        for _ in range(own[0][3]):
            best = max(own, key=lambda r: (r[2] / (2 * want[g, r[1]] + 1), -r[1]))
            want[g, best[1]] += 1
    frame = spark.createDataFrame(rows, "g int, k int, votes double, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(frame, "g", "k").collect()}
    assert got == {(r[0], r[1]): want[r[0], r[1]] for r in rows}


@pytest.fixture
def sources(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 200)), rng.choice(["big"] * 6 + ["a", "b", None])) for i in range(400)]
    rows += [(1000 + i, None, "a") for i in range(3)] + [(2000, " \n", "only blank")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_comes_near_its_targets(spark, sources, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    docs, rows = sources
    got = {r.doc_id: r for r in mixing.mix_sources(docs.repartition(5)).collect()}
    again = {r.doc_id: r for r in mixing.mix_sources(docs.repartition(2)).collect()}
    assert got == again and len(got) == len(rows)
    size, taken = Counter(), Counter()
    for i, text, source in rows:
        n = len(words(text))
        assert got[i].size == n and 0 <= got[i].taken <= 2 * n
        size[source] += n
        taken[source] += got[i].taken
    names = sorted(s for s in size if s is not None) + [None]
    want = dict(zip(names, reshared([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)))
    for i, _, source in rows:
        assert got[i].source_size == size[source]
        assert got[i].target == pytest.approx(want[source])
    for source in names:
        assert abs(taken[source] - want[source]) <= max(16, 0.02 * want[source])


def test_the_mix_holds_the_words_taken(spark, sources):
    docs, rows = sources
    docs = docs.selectExpr("*", "length(text) AS n_chars", "'mine' AS target", "0 AS size")
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = defaultdict(list)
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.text in texts[r.doc_id] and r.target == "mine"
        found[r.doc_id] += words(r.text)
    assert {i: len(ws) for i, ws in found.items()} == {i: n for i, n in got.items() if n}
    assert all(max(Counter(found[i]).values()) <= 2 * max(Counter(words(texts[i])).values()) for i in found)


def test_mix_of_odd_rows(odd, odd_rows, nothing):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(odd).columns == odd.columns
    assert sum(len(words(r.text)) for r in mixing.mixed(odd).collect()) == sum(r.taken for r in got)
    assert mixing.mix_sources(nothing).count() == mixing.mixed(nothing).count() == 0


def test_mix_is_native(odd):
    plan = mixing.mixed(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- search


@pytest.mark.parametrize("nodes", [1, 2, 3])
def test_top_k_equals_brute_force(spark, nodes, monkeypatch):
    for name, value in (("NODES", nodes), ("QUERY_BLOCK", 7), ("ROWS", 40), ("QUERIES", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)]  # many ties
    rows += [(400, None), (401, [0.5, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (None, rows[1][1])]
    rows += [(405 + i, rng.normal(size=3).tolist()) for i in range(3)] + [rows[7], rows[10], (50, rows[50][1])]
    real = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score").repartition(4)
    want = []
    for i, q in {i: q for i, q in real if i % 5 == 0}.items():
        others = sorted((-int(q @ v), j) for j, v in real if j != i and len(v) == len(q))[:5]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(others, 1)]
    got = topk.top_k(vectors, vectors.where("vec_id % 5 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 1.0]), (2, [2.0**22, 1.0 + 1 / 256]), (3, [-(2.0**22), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, vectors.where("vec_id = 0"), 5).collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 2, 2**60 + 256 * 257), (2, 1, 2**60 + 256 * 256), (3, 3, -(2**60))]




def test_a_task_names_few_rows_of_each_query(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topk, "ROWS", 50)
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(0, 60, (700, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(700)), pa.array((vectors / 256).tolist())], names=["vec_id", "embedding"])
    queries = {8: topk.Queries(np.arange(0, 700, 50), vectors[::50])}
    rows = [tuple(r.values()) for out in topk._local_lists(queries, 5)(iter([batch])) for r in out.to_pylist()]
    assert len(rows) == 14 * 2 * 5
    for query in range(0, 700, 50):
        want = set()
        for part in (slice(0, 4), slice(4, 8)):
            partial = vectors[:, part] @ vectors[query, part]
            partial[query] = -np.inf
            want |= {int(i) for i in np.argsort(-partial)[:5]}
        got = [r for r in rows if r[0] == query]
        assert {r[1] for r in got} == want
        assert all(r[2] == int(vectors[query] @ vectors[r[1]]) for r in got)
