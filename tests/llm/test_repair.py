import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from labelvec.llm import conversation_repair as repair
from labelvec.llm.queries import QUERIES

FIELDS = "conv_id long, turn long, role string, text string, part string, seq int, turns int, dropped boolean"
LEGAL = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def classified(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def best_by_hand(rows):
    """Least (cost, audit, lines) by trying states from the end, inserts to a fixed point."""
    after, keep = {"": "u", "s": "u", "u": "a", "a": "u"}, {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            role, text, fault = rows[i]
            new = {}
            for state in ("", "s", "u", "a"):
                ways = []
                if state in best:
                    c, a, t = best[state]
                    ways.append((c + 3, "D" + a, t))
                if fault not in ("b", "d"):
                    if after[state] in best:
                        c, a, t = best[after[state]]
                        ways.append((c + 2 + (fault == "t"), "R" + a, ((name[after[state]], text), *t)))
                    if (state, role[:1]) in keep and role[:1] in best:
                        c, a, t = best[role[:1]]
                        ways.append((c + (fault == "t"), "K" + a, ((role, text), *t)))
                if ways:
                    new[state] = min(ways)
            best = new
        for _ in range(4):
            for state in ("", "s", "u", "a"):
                if after[state] in best:
                    c, a, t = best[after[state]]
                    best[state] = min(best.get(state, (c + 2, "I" + a, ((name[after[state]], ""), *t))), (c + 2, "I" + a, ((name[after[state]], ""), *t)))
    return best[""]


def by_hand(originals, rows):
    """conv_id -> result; ``rows`` are those after damage."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in originals}:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        told = classified(own)
        initials = [r[0][:1] for r in told]
        cost, audit, left = best_by_hand(told)
        lines = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == x for _, _, f in told) for x in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in left))
    return out


def told(frame):
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = frame.collect()
    found = {r.conv_id: tuple(r[f] for f in fields) for r in rows}
    assert len(found) == len(rows)
    return found


def invented(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(1, longest)):
            turn = rng.choice([turn, turn, turn, turn + 3, 1, None])
            text = rng.choice(["Yes.", "No", "", " \n", "a.b!", "One\ntwo. \n", "Ünï 😀?", None, "x" * 50 + "."])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows + rows[:5]


def frame(spark, rows, parts=5):
    more = [(*r, "x", 1, 2, True) for r in rows]
    return spark.createDataFrame(more, FIELDS).repartition(parts)


@pytest.mark.parametrize("shuffle", [1, 7])
def test_repairs_equal_brute_force(spark, shuffle):
    rows = [r for r in invented(3) if r[2] != ""]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        summary, _ = repair.repairs(repair.damaged(frame(spark, rows)), dropped="dropped")
        got = told(summary)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == by_hand(rows, damage(rows))


def test_a_long_conversation_is_cut_into_segments(spark, monkeypatch):
    rng = random.Random(9)
    roles = ["system"] + [rng.choice(["user", "assistant"]) for _ in range(1500)]
    rows = [(7, i // 2, role, f"{rng.randrange(700)}{rng.choice('.?x')}") for i, role in enumerate(roles)]
    rows += [(k, t, "user", "Short.") for k in (1, 20) for t in range(3)]
    summary, turns = repair.repairs(frame(spark, rows))
    want = by_hand(rows, rows)
    assert told(summary) == want
    texts = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.seq)):
        texts[r.conv_id] += [f"{t.role}:{t.text}" for t in r.turns]
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: w[-1] for c, w in want.items()}
    assert turns.count() > len(want)


@pytest.mark.parametrize("seed", range(3))
def test_both_heaps_meet_at_the_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randrange(10))]
        fault = {"": repair.FINE, "b": repair.BLANK, "d": repair.DUPLICATE, "t": repair.CUT}
        cost, audit, left = best_by_hand(rows)
        pattern = tuple((r[:1], fault[f]) for r, _, f in rows)
        assert repair.cheapest(pattern, repair.START, repair.ENDS) == (cost, audit)
        assert repair.applied(audit, repair.START, [r for r, _, _ in rows], [t for _, t, _ in rows]) == list(left)


def test_nothing_and_dropped_rows(spark):
    empty = spark.createDataFrame([], FIELDS)
    summary, turns = repair.repairs(empty)
    assert summary.count() == turns.count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None)]
    got = told(repair.repairs(repair.damaged(frame(spark, rows)), dropped="dropped")[0])
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got == by_hand(rows, damage(rows))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_registered_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op11_conversation_repair"](spark, path)) == by_hand(rows, damage(rows))
