"""Least edits that give conversations a legal order of roles, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state); the states are those of ``(s?(ua)+)?`` over role initials. Edges keep, rerole or
delete a row, or insert an empty turn. A forward and a reverse heap run towards each other until no crossing can cost as little as the
best one; of all crossings of least cost the one with the least audit is taken.

Rows are sorted by range over (conversation, turn). A conversation that lies inside a task and has at most ``SEGMENT_ROWS`` rows is repaired
at once. Others are cut into segments, each of which says what it costs to get from any state to any other; a second
pass adds up the segments of a conversation in order, with four running labels, so no conversation is ever held as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelvec.llm.text import BATCH_ROWS, map_texts
from labelvec.session import broadcast_if_small, stage

SEGMENT_ROWS, SEGMENT_CHARS = 512, 1 << 22
# Patterns of rows whose repair a task remembers, and their longest.
KNOWN, KNOWN_ROWS = 1 << 15, 64
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: nothing yet, after the system turn, after a user's, after an assistant's; legal ends are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINE, BLANK, DUPLICATE, CUT, DROPPED = range(5)
WHITE = r"\x20\x09-\x0D"


# ---------------------------------------------------------------- one lattice


def _forward(pattern: tuple, node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """(cost, edit, next node); a row of the pattern is (initial, fault)."""
    i, state = node
    yield INSERT, "I", (i, AFTER[state])
    if i < len(pattern):
        initial, fault = pattern[i]
        yield DELETE, "D", (i + 1, state)
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            yield REROLE + more, "R", (i + 1, AFTER[state])
            if (state, initial) in KEEPS:
                yield more, "K", (i + 1, KEEPS[state, initial])


def _reverse(pattern: tuple, node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """(cost, edit, node before)."""
    i, state = node
    rows = (i - 1, i) if i else (i,)
    for before in ((j, s) for j in rows for s in STATES):
        for cost, edit, to in _forward(pattern, before):
            if to == node:
                yield cost, edit, before


class _Heap:
    """Least (cost, audit) of the nodes reached from one side; of equal costs the nodes nearest to that side come first.

    Only kept rows cost nothing, and they lead away from it, so a node's label is least when it is taken.
    """

    def __init__(self, sources: list[tuple[int, int]], ahead: bool):
        self.ahead, self.done = ahead, {}
        self.heap = [(0, self._far(s), "", s) for s in sources]
        heapq.heapify(self.heap)

    def _far(self, node: tuple[int, int]) -> int:
        return node[0] if self.ahead else -node[0]

    def top(self) -> float:
        while self.heap and self.heap[0][3] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def take(self, pattern: tuple) -> tuple[int, int]:
        cost, _, audit, node = heapq.heappop(self.heap)
        self.done[node] = cost, audit
        for more, edit, to in (_forward if self.ahead else _reverse)(pattern, node):
            if to not in self.done:
                heapq.heappush(self.heap, (cost + more, self._far(to), audit + edit if self.ahead else edit + audit, to))
        return node


def cheapest(pattern: tuple, entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of the rows (initial, fault) from a state to one of others, ties to the least audit."""
    front, back = _Heap([(0, entry)], True), _Heap([(len(pattern), s) for s in ends], False)
    best = float("inf")
    while True:
        f, b = front.top(), back.top()
        if f + b > best or f + b == float("inf"):
            break
        if f <= b:
            node = front.take(pattern)
            cost = front.done[node][0]
            near = [(more, to) for more, _, to in _forward(pattern, node) if to in back.done]
            met = [cost + more + back.done[to][0] for more, to in near] + ([cost + back.done[node][0]] if node in back.done else [])
        else:
            node = back.take(pattern)
            cost = back.done[node][0]
            near = [(more, to) for more, _, to in _reverse(pattern, node) if to in front.done]
            met = [cost + more + front.done[to][0] for more, to in near] + ([cost + front.done[node][0]] if node in front.done else [])
        best = min([best, *met])
    if best == float("inf"):
        return None
    # All crossings of this cost: a node that both sides took, or an edge between one of each.
    audits = []
    for node, (cost, audit) in front.done.items():
        if node in back.done and cost + back.done[node][0] == best:
            audits.append(audit + back.done[node][1])
        for more, edit, to in _forward(pattern, node):
            if to in back.done and cost + more + back.done[to][0] == best:
                audits.append(audit + edit + back.done[to][1])
    return int(best), min(audits)


@functools.lru_cache(KNOWN)
def _known(pattern: tuple, entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    return cheapest(pattern, entry, ends)


def _cheapest(pattern: tuple, entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    return (_known if len(pattern) <= KNOWN_ROWS else cheapest)(pattern, entry, ends)


def applied(audit: str, entry: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the turns that the edits leave."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit == "I":
            state = AFTER[state]
            out.append((ROLE[state], ""))
            continue
        if edit == "K":
            state = KEEPS[state, roles[i][:1]]
            out.append((roles[i], texts[i]))
        elif edit == "R":
            state = AFTER[state]
            out.append((ROLE[state], texts[i]))
        i += 1
    return out


# ---------------------------------------------------------------- rows of a task

_PAIRS = ("su", "ua", "au")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = pa.schema(
    [("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int32()), ("seq", pa.int32()), ("turn", pa.int64())]
    + [(c, pa.int64()) for c in _COUNTS]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", _TURNS)]
    + [("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), ("last", pa.int64()), ("initials", pa.string())]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
_DDL = (
    "conv_id long, whole boolean, part int, seq int, turn long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string, turns array<struct<role:string,text:string>>, low long, high long, n_turns long, last long, "
    "initials string, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
)


@dataclass
class _Segment:
    """Rows of a conversation that follow each other."""

    turn: int | None = None  # of its first row, dropped ones included
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)  # distinct, without nulls
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def pattern(self) -> tuple:
        return tuple((role[:1], fault) for role, fault in zip(self.roles, self.faults))

    def row(self, conversation: int | None) -> dict:
        initials = [role[:1] for role in self.roles]
        return {
            "conv_id": conversation, "turn": self.turn,
            **{name: self.faults.count(fault) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))},
            "illegal": sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:])),
        }

    def repaired(self, conversation: int | None, turns: bool) -> dict:
        cost, audit = _cheapest(self.pattern(), START, ENDS)
        left = applied(audit, START, self.roles, self.texts)
        text = "\n".join(f"{role}:{text}" for role, text in left)
        return self.row(conversation) | {
            "whole": True, "gaps": self.turns[-1] - self.turns[0] + 1 - len(self.turns) if self.turns else 0, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
            "turns": [{"role": r, "text": t} for r, t in left] if turns else None,
        }

    def summary(self, conversation: int | None, part: int, seq: int) -> dict:
        pattern = self.pattern()
        ways = [_cheapest(pattern, s, (e,)) for s in STATES for e in STATES]
        return self.row(conversation) | {
            "whole": False, "part": part, "seq": seq, "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None,
            "n_turns": len(self.turns), "initials": self.roles[0][:1].ljust(1, "\0") + self.roles[-1][:1].ljust(1, "\0") if self.roles else None,
            "costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways], "roles": self.roles, "texts": self.texts,
        }


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=_FIELDS)


def _repair(turns: bool):
    """Whole conversations, and segments of those that are long or stand at an end of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found: list[dict] = []
        size, now, seq, segment, before, first = 0, None, -1, None, None, True
        for batch in batches:
            for conversation, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if segment is not None and conversation != now:
                    inside = not first and seq == 0
                    found.append(segment.repaired(now, turns) if inside else segment.summary(now, part, seq))
                    segment, first = None, False
                if segment is None:
                    now, seq, segment, before = conversation, 0, _Segment(turn), None
                elif len(segment.roles) >= SEGMENT_ROWS or segment.chars >= SEGMENT_CHARS:
                    found.append(segment.summary(now, part, seq))
                    seq, segment = seq + 1, _Segment(turn)
                if len(found) >= BATCH_ROWS or size >= SEGMENT_CHARS:
                    yield _rows(found)
                    found, size = [], 0
                if fault == DROPPED:
                    continue
                # Equal rows of one turn stand together: all but the first were seen before.
                if fault in (FINE, CUT) and before == (turn, role, text):
                    fault = DUPLICATE
                before = turn, role, text
                segment.add(turn, role, text, fault)
                size += len(text)
        if segment is not None:
            found.append(segment.summary(now, part, seq))
        if found:
            yield _rows(found)

    return run


@dataclass
class _Label:
    cost: int
    audit: str
    digest: "hashlib._Hash"
    any: bool
    way: tuple | None  # (way before, part, seq, audit of the segment, entry)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation in order: the least label of every state; then its row, and the edits of each segment."""

    def row(conversation, labels: dict[int, _Label], total: dict) -> list[dict]:
        label = min((labels[e] for e in ENDS if e in labels), key=lambda x: (x.cost, x.audit))
        low, high = total["low"], total["high"]
        out = [{
            "conv_id": conversation, "whole": True, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")},
            "gaps": 0 if low is None else high - low + 1 - total["n_turns"], "cost": label.cost, "audit": label.audit,
            "repaired_sha256": label.digest.hexdigest(),
        }]
        way = label.way
        while way is not None:
            way, part, seq, audit, entry = way
            out.append({"conv_id": conversation, "whole": False, "part": part, "seq": seq, "audit": audit, "cost": entry})
        return out

    def step(labels: dict[int, _Label], s: dict) -> dict[int, _Label]:
        new = {}
        for e in STATES:
            ways = [(labels[k].cost + s["costs"][4 * k + e], labels[k].audit + s["audits"][4 * k + e], k) for k in labels if s["costs"][4 * k + e] is not None]
            if not ways:
                continue
            cost, audit, k = min(ways)
            old, piece = labels[k], s["audits"][4 * k + e]
            digest, some = old.digest.copy(), old.any
            for role, text in applied(piece, k, s["roles"], s["texts"]):
                digest.update(f"{'\n' if some else ''}{role}:{text}".encode())
                some = True
            new[e] = _Label(cost, audit, digest, some, (old.way, s["part"], s["seq"], piece, k))
        return new

    now, labels, total = None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            s = batch.slice(i, 1).to_pylist()[0]
            if labels is None or s["conv_id"] != now:
                if labels is not None:
                    yield _rows(row(now, labels, total))
                now, labels = s["conv_id"], {START: _Label(0, "", hashlib.sha256(), False, None)}
                total = {c: 0 for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")} | {"low": None, "high": None, "initial": None}
            labels = step(labels, s)
            for c in ("blank", "duplicate", "truncated", "illegal"):
                total[c] += s[c]
            if s["n_turns"]:
                total["n_turns"] += s["n_turns"] - (total["high"] == s["low"])
                total["low"] = s["low"] if total["low"] is None else total["low"]
                total["high"] = s["high"]
            if s["initials"]:
                if total["initial"] is not None and total["initial"] + s["initials"][0] not in _PAIRS:
                    total["illegal"] += 1
                total["initial"] = s["initials"][1]
    if labels is not None:
        yield _rows(row(now, labels, total))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that the edits of each segment leave."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["turns"] = [{"role": a, "text": b} for a, b in applied(r["audit"], r["entry"], r["roles"], r["texts"])]
        fields = pa.schema([_FIELDS.field("conv_id"), _FIELDS.field("turn"), _FIELDS.field("seq"), _FIELDS.field("turns")])
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in fields.names} for r in rows], schema=fields)


# ---------------------------------------------------------------- whole tables


def turns_of(rows: DataFrame, dropped: Column) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of any rows; a missing role or text is one space."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], dropped.alias("dropped"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Faults by ``crc32("conv_id:turn") % 20``; rows that are dropped stay, with ``dropped`` set."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns_of(rows, F.crc32(key) % 20 == 0).withColumn("kind", F.crc32(key) % 20)
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "dropped",
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _with_faults(rows: DataFrame) -> DataFrame:
    """The first fault of every row; of rows with equal role and text in one turn, all but the first are told by the order of rows."""
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut = F.col("text").rlike(rf"[^.!?{WHITE}][{WHITE}]*\z")
    same = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    rows = rows.withColumns({"same": F.when(~blank & ~F.col("dropped"), same), "place": place})
    often = rows.where("same is not null").groupBy(F.col("conv_id").alias("_conv"), F.col("same").alias("_same")).agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    often = stage(often.where("_n > 1").drop("_n"), "repeated")
    rows = rows.join(broadcast_if_small(often), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    fault = F.when(F.col("dropped"), DROPPED).when(blank, BLANK).when(F.col("place") > F.col("_first"), DUPLICATE).when(cut, CUT).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))


def repairs(rows: DataFrame, dropped: str | None = None, turns: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn, role, text, ...), and the repaired turns.

    Rows are taken by turn, missing turns first, and within a turn by role and text. A missing conv_id is a conversation of its own; a
    missing role or text is one space, and a role without a legal initial can't be kept. Equal rows are occurrences of
    their own, so the later are duplicates. Blank rows are deleted; a text of any length is one turn. Rows with the column ``dropped``
    set only name their conversation; one without other rows gives zeros, an empty audit and the digest of an empty text. No rows give none; further columns are left out.

    The first frame is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); the second one (None without
    ``turns``) (conv_id, turn, seq, turns): the turns of a conversation, in the order of (turn, seq) if it is long.
    An audit has a letter for each edit, so a conversation's is as long as itself; its rows pass by in segments.
    """
    gone = F.lit(False) if dropped is None else F.col(dropped)
    ready = _with_faults(turns_of(rows, gone))
    ready = ready.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    found = stage(map_texts(ready, _repair(turns), _DDL), "repairs")
    parts = found.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")
    composed = stage(map_texts(parts, _compose, _DDL), "composed")
    fields = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    summary = found.where("whole").select(fields).union(composed.where("whole").select(fields))
    if not turns:
        return summary, None
    edits = composed.where("not whole").select(F.col("conv_id").alias("_conv"), "part", "seq", "audit", F.col("cost").cast("int").alias("entry"))
    pieces = found.where("not whole").select("conv_id", "part", "seq", "turn", "roles", "texts")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    pieces = pieces.join(edits, ["part", "seq"]).where(same).select("conv_id", "turn", "seq", "audit", "entry", "roles", "texts")
    left = map_texts(pieces, _turns, "conv_id long, turn long, seq int, turns array<struct<role:string,text:string>>")
    whole = found.where("whole").select("conv_id", "turn", F.lit(0).alias("seq"), "turns")
    return summary, whole.union(left)


# The checksum's polynomial is a fixed value; its table and sums follow bit by bit.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, crc),
names AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
turned AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN names ON keyed.conv_id IS NOT DISTINCT FROM names.conv_id, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM turned),
told AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'cut' ELSE '' END AS fault
  FROM (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS bare FROM numbered)),
ins(s, t, paid, letters, added) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
  (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
ops(op, t, keeps, u, price) AS (VALUES
  ('D', 0, NULL, 0, 3), ('D', 1, NULL, 1, 3), ('D', 2, NULL, 2, 3), ('D', 3, NULL, 3, 3),
  ('R', 0, NULL, 2, 2), ('R', 1, NULL, 2, 2), ('R', 2, NULL, 3, 2), ('R', 3, NULL, 2, 2),
  ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0)),
label AS (
  SELECT c, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM names
  UNION ALL
  SELECT label.c, label.i + 1, u, min({'cost': b.cost + paid + price + CASE WHEN op <> 'D' AND fault = 'cut' THEN 1 ELSE 0 END,
    'audit': concat(b.audit, letters, op), 'lines': list_concat(b.lines, list_concat(added, CASE op WHEN 'D' THEN []::VARCHAR[]
      WHEN 'K' THEN [concat(role, ':', text)] ELSE [concat(CASE u WHEN 2 THEN 'user' ELSE 'assistant' END, ':', text)] END))})
  FROM label JOIN ins USING (s) JOIN ops USING (t) JOIN told ON told.c = label.c AND told.i = label.i + 1
  WHERE (keeps IS NULL OR keeps = initial) AND (op = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY label.c, label.i, u),
counts AS (
  SELECT c, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'cut') AS truncated,
    count(*) FILTER (past IS NOT NULL AND concat(past, initial) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM names LEFT JOIN (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS past FROM told) USING (c) GROUP BY c),
ended AS (
  SELECT c, min({'cost': b.cost + paid, 'audit': concat(b.audit, letters), 'lines': list_concat(b.lines, added)}) AS b
  FROM label JOIN counts USING (c) JOIN ins USING (s) WHERE label.i = n AND t IN (0, 3) GROUP BY c)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit,
  sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256
FROM names JOIN counts USING (c) JOIN ended USING (c)
"""
