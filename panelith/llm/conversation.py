"""Conversation structure repair at the least cost.

A conversation's rows, in order of turn, are mended so that its roles read ``(system? (user assistant)+)?``. Nodes are (rows done, state of
that pattern); arcs keep, rerole or delete the next row or insert an empty one. The least costs from the start (forward) and to the end
(backward) tell the tight arcs, those on some cheapest way: forward + arc + backward equals the total. Along them the set of nodes that
the letters so far can reach, the frontier, is carried on; at each step the least letter that leaves it is taken.

Rows that are equal in conversation, turn, role and text are one row with a number of copies, so that copies meet before any shuffle. Rows are then
sorted over ranges of (conversation, turn, role, digest), and a long conversation spans several tasks. Pieces of at most ``PIECE`` rows state what
they cost from each state to each other one; these 4 x 4 matrices, chained from the end, give each piece the costs behind it, and the
conversation's pieces pass once more, in order, to be mended and hashed. A digest over a whole conversation is a chain by nature: for a
conversation of many pieces that last pass is one task, which holds one piece at a time. Conversations that lie inside one task and one piece
are finished where they were sorted.

Edge cases: a null role or text counts as one space, and so does a null id or turn where it is written; rows without a turn come first and count for no gap; rows
of the same turn stand in order of role and the text's SHA-256; null ids are one conversation; conversations whose rows have 0 ``copies`` give
zeros, an empty audit and the hash of the empty text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows and characters of a piece, at most (one row may have more characters).
PIECE, PIECE_CHARS = 4096, 4 << 20
#: Costs of the edits; an undeleted truncated row costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INF = 1 << 60

# States of the pattern: nothing yet, behind the system row, behind a user row, behind an assistant row. By state: where a role's initial leads, and the role that may be put there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
PUT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Costs behind the last row: the pattern may end before it begins or behind an assistant row.
ENDS = (0, INF, INF, 0)
LEGAL = frozenset(("su", "ua", "au"))

_SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as the test damages them, by crc32 of ``conv_id:turn`` modulo 20, and ``copies`` (0: dropped)."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat_ws(":", *written).cast("binary")) % 20
    given = common.pick(rows, ["conv_id", "turn", "role", "text"]).withColumn("code", code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"))


class Row:
    """A row of a conversation: its fault, whether its text is cut, how many copies go, and what it says."""

    __slots__ = ("turn", "role", "text", "copies", "lost", "cut")

    def __init__(self, turn: int | None, role: str, text: str, copies: int, repeats: bool):
        self.turn, self.role, self.text, self.copies = turn, role, text, copies
        blank = not text.strip(_SPACE)
        self.lost = "blank" if blank else "duplicate" if repeats else ""
        self.cut = not blank and not repeats and text.rstrip(_SPACE)[-1] not in ".!?"


def _arcs(row: Row | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows done, next state) of the arcs that leave a node. Without a row only insertions are left."""
    put = PUT[state][1]
    out = [("I", INSERT, 0, put)]
    if row is None:
        return out
    out.append(("D", DELETE, 1, state))
    if not row.lost:
        more = TRUNCATED if row.cut else 0
        kept = NEXT[state].get(row.role[:1])
        if kept is not None:
            out.append(("K", more, 1, kept))
        out.append(("R", REROLE + more, 1, put))
    return out


def backward(rows: list[Row], behind: tuple[int, ...] | list[int]) -> list[list[int]]:
    """Least cost from each node to the end, given those behind the last row."""
    out = [_settle(list(behind))]
    for row in reversed(rows):
        after = out[-1]
        extra = DELETE * (row.copies - 1)
        raw = [min(cost + extra + after[to] for _, cost, done, to in _arcs(row, state) if done) for state in range(4)]
        out.append(_settle(raw))
    out.reverse()
    return out


def _settle(costs: list[int]) -> list[int]:
    """Costs to the end with insertions before the next row; two in a row lead as far as any number."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[PUT[state][1]]) for state, c in enumerate(costs)]
    return costs


def forward(rows: list[Row], entry: tuple[int, ...] | list[int]) -> list[list[int]]:
    """Least cost from the start to each node, given those of the states before the first row."""
    out = [_spread(list(entry))]
    for row in rows:
        new, extra = [INF] * 4, DELETE * (row.copies - 1)
        for state, so_far in enumerate(out[-1]):
            if so_far < INF:
                for _, cost, done, to in _arcs(row, state):
                    if done:
                        new[to] = min(new[to], so_far + cost + extra)
        out.append(_spread(new))
    return out


def _spread(costs: list[int]) -> list[int]:
    for _ in range(2):
        new = list(costs)
        for state, c in enumerate(costs):
            to = PUT[state][1]
            new[to] = min(new[to], c + INSERT)
        costs = new
    return costs


def cheapest(rows: list[Row], entry: int, behind: tuple[int, ...] | list[int], last: bool) -> tuple[str, list[tuple[str, str]], int, int]:
    """(letters, repaired (role, text) pairs, state at the end, cost) of the cheapest edits with the least letters, from state ``entry``.

    ``behind`` has the costs behind these rows; where further rows follow (not ``last``), the way ends with the last row's edits.
    """
    ahead = forward(rows, [0 if s == entry else INF for s in range(4)])
    back = backward(rows, behind)
    total = back[0][entry]
    end = _settle(list(behind))
    letters: list[str] = []
    # a node of the frontier: (rows done, state); each remembers the one way of reaching it by the letters so far
    frontier: dict[tuple[int, int], tuple | None] = {(0, entry): None}
    while True:
        over = [n for n in frontier if n[0] == len(rows) and (not last or end[n[1]] == behind[n[1]] == 0)]
        if over:
            node = over[0]
            break
        steps: dict[str, dict[tuple[int, int], tuple]] = {}
        for (done, state), way in frontier.items():
            row = rows[done] if done < len(rows) else None
            for letter, cost, moved, to in _arcs(row, state):
                extra = DELETE * (row.copies - 1) if moved else 0
                if ahead[done][state] + cost + extra + back[done + moved][to] == total:
                    steps.setdefault(letter, {})[done + moved, to] = (way, letter, done, state)
        letter = min(steps)
        frontier = steps[letter]
        done = next(iter(frontier))[0]  # the letters tell how many rows are done
        letters.append(letter if letter == "I" else letter + "D" * (rows[done - 1].copies - 1))
    way, out = frontier[node], []
    while way is not None:
        way, letter, done, state = way
        if letter == "K":
            out.append((rows[done].role, rows[done].text))
        elif letter == "R":
            out.append((PUT[state][0], rows[done].text))
        elif letter == "I":
            out.append((PUT[state][0], ""))
    out.reverse()
    return "".join(letters), out, node[1], total


def matrix(rows: list[Row]) -> list[int]:
    """Least costs from each state before the rows to each state behind them, row by row."""
    return [c for entry in range(4) for c in forward(rows, [0 if s == entry else INF for s in range(4)])[-1]]


def behind_costs(matrices: list[list[int]]) -> list[tuple[int, ...]]:
    """For each piece of a conversation, in order, the costs behind it."""
    out, costs = [], list(ENDS)
    for m in reversed(matrices):
        out.append(tuple(costs))
        after = _settle(costs)
        costs = [min(m[4 * s + to] + after[to] for to in range(4)) for s in range(4)]
    out.reverse()
    return out


#: What is counted; a piece's first and last turn and role tell how it joins its neighbours.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def tally(rows: list[Row]) -> dict:
    """Faults, illegal neighbours and different turns of a piece, and its edges."""
    out: dict = dict.fromkeys(COUNTS, 0)
    before: Row | None = None
    for row in rows:
        if row.lost:
            out[row.lost] += row.copies
        else:
            out["duplicate"] += row.copies - 1
            out["truncated"] += row.cut
        out["illegal"] += row.copies - 1 + (before is not None and before.role[:1] + row.role[:1] not in LEGAL)
        out["turns"] += row.turn is not None and (before is None or before.turn != row.turn)
        before = row
    turns = [r.turn for r in (rows[0], rows[-1])] if rows else [None, None]
    known = next((r.turn for r in rows if r.turn is not None), None)
    return out | {"first_turn": known, "last_turn": turns[1], "first_role": rows[0].role[:1] if rows else None, "last_role": rows[-1].role[:1] if rows else None}


def joined(a: dict | None, b: dict) -> dict:
    """The tally of a piece and the next one."""
    if a is None or a["first_role"] is None:
        return b
    if b["first_role"] is None:
        return a
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    first = a["first_turn"] if a["first_turn"] is not None else b["first_turn"]
    return out | {"first_turn": first, "last_turn": b["last_turn"], "first_role": a["first_role"], "last_role": b["last_role"]}


def _gaps(t: dict) -> int:
    return 0 if t["first_turn"] is None else t["last_turn"] - t["first_turn"] + 1 - t["turns"]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Mended:
    """A conversation that is mended piece by piece; keeps its state, its hash and what it counts."""

    def __init__(self):
        self.state, self.cost, self.position = START, 0, 0
        self.letters: list[str] = []
        self.hash, self.tally = hashlib.sha256(), None

    def take(self, rows: list[Row], behind: tuple[int, ...], last: bool) -> list[tuple[int, str, str, str]]:
        """(position, edit, role, text) of the repaired rows of a piece."""
        letters, pairs, state, total = cheapest(rows, self.state, behind, last)
        if not self.letters:
            self.cost = total
        self.state = state
        self.letters.append(letters)
        self.tally = joined(self.tally, tally(rows))
        out = []
        for (role, text), letter in zip(pairs, letters.replace("D", ""), strict=True):
            self.hash.update(f"{chr(10) if self.position else ''}{role}:{text}".encode())
            out.append((self.position, letter, role, text))
            self.position += 1
        return out

    def report(self) -> tuple:
        t = self.tally
        return (_gaps(t), t["blank"], t["duplicate"], t["truncated"], t["illegal"], self.cost, "".join(self.letters), self.hash.hexdigest())


_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("repeats", pa.bool_())]))
_TURNS = pa.list_(pa.struct([("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_REPORT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _batch(conv_type: pa.DataType, out: list[tuple], turns: bool) -> pa.RecordBatch:
    """Records (conversation, piece number, matrix, rows, report, repaired turns) as a batch; an open piece has no report, a finished one nothing else."""
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    report = [[None if r is None else r[k] for r in cols[4]] for k in range(8)]
    arrays = [
        pa.array(cols[0], type=conv_type),
        pa.array(cols[1], type=pa.int64()),
        pa.array(cols[2], type=pa.list_(pa.int64())),
        pa.array(cols[3], type=_ROWS),
        *(pa.array(c, type=t) for c, t in zip(report, _REPORT_TYPES, strict=True)),
    ]
    names = ["conv_id", "piece", "matrix", "rows", *(f.split(" ")[0] for f in REPORT.split(", "))]
    if turns:
        arrays.append(pa.array(cols[5], type=_TURNS))
        names.append("mended")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _pieces(turns: bool, most: int = PIECE):
    """Sorted rows become finished conversations and open pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        waiting: list[Row] = []
        conv = number = chars = 0
        started = alone = False  # any conversation yet; the present one began inside this task and was not cut
        conv_type, out, size = pa.int64(), [], 0

        def finish() -> tuple:
            m = _Mended()
            rows = m.take(waiting, ENDS, True)
            return (conv, part + number, None, None, m.report(), [dict(zip(("position", "edit", "role", "text"), r, strict=True)) for r in rows] if turns else None)

        def leave() -> tuple:
            held = [{"turn": r.turn, "role": r.role, "text": r.text, "copies": r.copies, "repeats": r.lost == "duplicate"} for r in waiting]
            return (conv, part + number, matrix(waiting), held, None, None)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for this, turn, role, text, copies, repeats in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if not started or this != conv:
                    if started:
                        out.append(finish() if alone else leave())
                    waiting, chars, number, alone, started, conv = [], 0, number + 1, started, True, this
                elif len(waiting) >= most or chars > PIECE_CHARS:
                    out.append(leave())
                    waiting, chars, number, alone = [], 0, number + 1, False
                if copies:
                    waiting.append(Row(turn, role, text, copies, repeats))
                    chars += len(text)
                size += len(text) if copies else 1
                if len(out) >= 4096 or size > PIECE_CHARS:
                    yield _batch(conv_type, out, turns)
                    out, size = [], 0
        if started:
            out.append(leave())
        if out:
            yield _batch(conv_type, out, turns)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of the pieces, by conversation and in order, become the costs behind each piece."""
    conv, held = None, []

    def out() -> pa.RecordBatch:
        costs = behind_costs([m for _, m in held])
        last = [n + 1 == len(held) for n in range(len(held))]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], type=pa.int64()), pa.array([list(c) for c in costs], type=pa.list_(pa.int64())), pa.array(last)], names=["its_piece", "behind", "last"])

    for batch in batches:
        for this, piece, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and this != conv:
                yield out()
                held = []
            conv = this
            held.append((piece, m))
    if held:
        yield out()


def _mend(turns: bool):
    """Pieces with the costs behind them, by conversation and in order, are mended one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: _Mended | None = None
        for batch in batches:
            out = []
            for conv, piece, rows, behind, last in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                m = m or _Mended()
                mended = m.take([Row(r["turn"], r["role"], r["text"], r["copies"], r["repeats"]) for r in rows], tuple(behind), last)
                if turns and mended:
                    out.append((conv, piece, None, None, None, [dict(zip(("position", "edit", "role", "text"), r, strict=True)) for r in mended]))
                if last:
                    out.append((conv, piece, None, None, m.report(), None))
                    m = None
            yield _batch(batch.schema.field("conv_id").type, out, turns)

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, repeats and the digest of a text; each different row once."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    here = copies > 0
    given = rows.select(
        F.col("conv_id"),
        F.when(here, F.col("turn").cast("long")).alias("turn"),
        F.when(here, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
        F.when(here, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"),
        copies.alias("copies"),
    )
    each = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.concat_ws(":", F.coalesce(F.length(F.col("conv_id").cast("string")), F.lit(-1)), F.col("conv_id").cast("string"), F.length("role"), "role", "text")
    speaks = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    # blank rows repeat nothing; a key of their own keeps them from meeting in one task
    same = F.unhex(F.sha2(F.when(speaks, said).otherwise(F.concat_ws(":", said, F.col("turn").cast("string"))), 256))
    marked = each.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("same", same).withColumn("speaks", speaks)
    held = common.materialize(marked, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = held.where("copies > 0 and speaks").groupBy("same").agg(F.min(when).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = common.materialize(first, "repeats")
    found = common.look_up(held, first, ["same"], "times", held.count())
    return found.withColumn("repeats", F.col("first").isNotNull() & (F.col("first") < when)).drop("first", "same", "speaks")


def repair(rows: DataFrame, turns: bool = False, piece: int = PIECE) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``turns`` the repaired rows themselves: conv_id, position, edit (K, R or I), role, text.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    n = common.parallelism(spark)
    conv = rows.schema["conv_id"].dataType.simpleString()
    more = ", mended array<struct<position: long, edit: string, role: string, text: string>>" if turns else ""
    schema = f"conv_id {conv}, piece long, matrix array<long>, rows array<struct<turn: long, role: string, text: string, copies: long, repeats: boolean>>, {REPORT}{more}"
    keys = ["conv_id", "turn", "role", "digest"]
    dealt = _ordered(rows).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "copies", "repeats")
    pieces = common.materialize(dealt.mapInArrow(_pieces(turns, piece), schema), "pieces")
    opened = pieces.where("rows is not null")
    light = opened.select("conv_id", "piece", "matrix").repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece")
    behind = common.materialize(light.mapInArrow(_chain, "its_piece long, behind array<long>, last boolean"), "behind")
    placed = opened.join(behind, opened["piece"] == behind["its_piece"]).repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece")
    finished = placed.select("conv_id", "piece", "rows", "behind", "last").mapInArrow(_mend(turns), schema)
    every = pieces.where("rows is null").unionAll(finished)
    if turns:
        return every.select("conv_id", F.explode("mended").alias("m")).select("conv_id", "m.*")
    return every.select("conv_id", *[f.split(" ")[0] for f in REPORT.split(", ")])


#: The same in DuckDB's SQL: the test's damage, then the least (cost, letters) of each state, row by row.
ORACLE = r"""
WITH RECURSIVE written AS (
  SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS code
  FROM written
), damaged AS (
  SELECT conv_id, turn, coalesce(CASE code WHEN 4 THEN 'user' ELSE role END, ' ') AS role,
         coalesce(CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END, ' ') AS text, copy
  FROM coded, (VALUES (1), (2)) AS c(copy) WHERE code <> 0 AND (copy = 1 OR code = 3)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end, substr(role, 1, 1) AS initial FROM damaged
), f AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM r
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
         count(*) FILTER (NOT blank AND NOT seen AND open_end) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id
), puts(state, letters, cost, said, mid) AS (
  VALUES (0, '', 0, [], 0), (0, 'I', 2, ['user:'], 2), (0, 'II', 4, ['user:', 'assistant:'], 3), (1, '', 0, [], 1), (1, 'I', 2, ['user:'], 2), (1, 'II', 4, ['user:', 'assistant:'], 3),
         (2, '', 0, [], 2), (2, 'I', 2, ['assistant:'], 3), (2, 'II', 4, ['assistant:', 'user:'], 2), (3, '', 0, [], 3), (3, 'I', 2, ['user:'], 2), (3, 'II', 4, ['user:', 'assistant:'], 3)
), next(mid, initial, role, goal) AS (
  VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)
), arcs AS (
  SELECT f.conv_id, k, mid, 'D' AS letter, 3 AS cost, CAST([] AS VARCHAR[]) AS said, mid AS goal FROM f, (VALUES (0), (1), (2), (3)) AS m(mid)
  UNION ALL SELECT f.conv_id, k, mid, 'K', CAST(open_end AS INTEGER), [f.role || ':' || text], goal FROM f JOIN next USING (initial) WHERE NOT blank AND NOT seen
  UNION ALL SELECT f.conv_id, k, mid, 'R', 2 + CAST(open_end AS INTEGER), [next.role || ':' || text], goal FROM f, next WHERE NOT blank AND NOT seen AND next.role IS NOT NULL
), ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, {'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])} AS best FROM counts
  UNION ALL
  SELECT w.conv_id, w.k + 1, a.goal, min({'cost': w.best.cost + p.cost + a.cost, 'audit': w.best.audit || p.letters || a.letter, 'said': w.best.said || p.said || a.said})
  FROM ways w JOIN puts p ON p.state = w.state JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.k = w.k + 1 AND a.mid = p.mid GROUP BY w.conv_id, w.k, a.goal
), done AS (
  SELECT c.conv_id, min({'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.letters, 'said': w.best.said || p.said}) AS best
  FROM counts c JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n JOIN puts p ON p.state = w.state WHERE p.mid IN (0, 3) GROUP BY c.conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(d.best.cost, 0) AS BIGINT) AS cost, coalesce(d.best.audit, '') AS audit, sha256(coalesce(array_to_string(d.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
