import random

import numpy as np
import pytest

from labelvec.llm import vector_codes
from labelvec.llm.queries import QUERIES, SQL

FIELDS = "vec_id long, embedding array<double>, label string, code string, error int, ids int"


def by_hand(rows, parts, entries, rounds):
    """(vec_id, label, code, error, label_error) of every row that takes part, and the codebooks."""
    good = [(i, np.floor(256 * np.array(v)).astype(int), c) for i, v, c in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return [], []
    key = lambda r: (r[0] is None, r[0] or 0, r[1].tolist())
    size = len(min(good, key=key)[1])
    good = [r for r in good if len(r[1]) == size]
    first = {}
    for i, v, _ in sorted(good, key=key):
        first.setdefault(i, v)
    start = list(first.values())[:entries]
    books = [[v.reshape(parts, -1)[p].tolist() for v in start] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [r[1].reshape(parts, -1)[p].tolist() for r in good]
            at = [nearest(x, books[p])[1] for x in own]
            book = []
            for k, entry in enumerate(books[p]):
                mine = [x for x, a in zip(own, at) if a == k]
                book.append([sum(c) // len(mine) for c in zip(*mine)] if mine else entry)
            new.append(book)
        books = new
    out = []
    for i, v, label in good:
        found = [nearest(v.reshape(parts, -1)[p].tolist(), books[p]) for p in range(parts)]
        out.append([i, label, bytes(k for _, k in found), sum(d for d, _ in found)])
    sums = {label: sum(r[3] for r in out if r[1] == label) for label in {r[1] for r in out}}
    return sorted((tuple(r) + (sums[r[1]],) for r in out), key=str), books


def told(codes):
    rows = vector_codes.with_label_error(codes).collect()
    return sorted(((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in rows), key=str)


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], FIELDS).repartition(parts)


@pytest.mark.parametrize(("seed", "ties"), [(1, False), (2, True)])
def test_codes_equal_brute_force(spark, seed, ties):
    rng = random.Random(seed)
    draw = (lambda: rng.randrange(-3, 3) / 64) if ties else (lambda: rng.gauss(0, 0.3))
    rows = [(i, [draw() for _ in range(8)], rng.choice([None, "a", "b"])) for i in range(400)]
    rows += rows[:20] + [(5, [0.0] * 8, "a"), (3, None, "a"), (2, [None] + [0.5] * 7, "b"), (1, [float("nan")] * 8, None), (0, [float("inf")] * 8, "a")]
    rows += [(7, [0.1] * 7, "a"), (8, [], "b"), (9, [0.5] * 4, "b"), (None, [0.25] * 8, None), (None, [0.5] * 8, "z")]
    codes, books = vector_codes.vector_codes(vectors(spark, rows), parts=4, entries=16, rounds=2)
    want, book = by_hand(rows, 4, 16, 2)
    assert books.tolist() == book and told(codes) == want


def test_few_rows_start_few_entries(spark):
    rows = [(None, [1.0, 2.0], "a"), (4, [0.0, 1.0], None), (4, [0.0, 0.5], None)]
    codes, books = vector_codes.vector_codes(vectors(spark, rows), parts=2, entries=64)
    want, book = by_hand(rows, 2, 64, 2)
    assert books.tolist() == book and told(codes) == want and books.shape == (2, 2, 1)


def test_no_rows(spark):
    codes, books = vector_codes.vector_codes(vectors(spark, [(1, None, "a")]))
    assert codes.count() == 0 and books.size == 0


def test_huge_components_are_an_error(spark):
    with pytest.raises(Exception, match="no exact squared distances"):
        vector_codes.vector_codes(vectors(spark, [(1, [1e30] * 16, "a")]))


@pytest.mark.parametrize("n", [1, 17, 600])
def test_subtrees_are_ranges_around_their_centres(n):
    rng = np.random.default_rng(n)
    values = np.floor(rng.normal(0, 40, (n, 3))).astype(np.int64)
    values[n // 2 :] = values[: n - n // 2]
    tree = vector_codes._unpacked(vector_codes._packed(vector_codes.grow(values)))
    assert (tree.points[tree.which] == values).all()
    assert (tree.sums[-1] == values.sum(axis=0)).all() and tree.rows[-1] == n
    for k in range(len(tree.lo)):
        inside = tree.points[tree.lo[k] : tree.hi[k]]
        away = np.sqrt(((inside - inside[0]) ** 2).sum(axis=1))
        assert away.max() == pytest.approx(tree.radius[k])
        children = range(tree.first[k], tree.last[k])
        assert len(children) == 0 or [tree.lo[c] for c in children] + [tree.hi[k]] == [tree.lo[k]] + [tree.hi[c] for c in children]
        centres = tree.points[tree.lo[list(children)]] if children else inside[:1]
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[~np.eye(len(centres), dtype=bool)]
        assert (apart > tree.radius[k] / 2).all() and all(tree.radius[c] <= tree.radius[k] / 2 + 1e-9 for c in children)


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(3)
    values = np.floor(np.concatenate([rng.normal(c, 3, (2000, 4)) for c in (0, 400, 900)])).astype(np.int64)
    tree = vector_codes.grow(values)
    lo, hi, entry = vector_codes.assigned(tree, np.array([[0] * 4, [410] * 4, [905] * 4]))
    assert len(lo) < 50 and (np.repeat(entry, hi - lo)[tree.which] == np.repeat([0, 1, 2], 2000)).all()
