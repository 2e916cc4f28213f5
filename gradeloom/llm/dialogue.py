"""Conversation repair: the cheapest edits that make the roles alternate.

A conversation is a lattice: its rows one after another, times what the roles so far allow
next. Arcs keep, rerole or delete a row or insert an empty one, at whole-number costs. The
auction algorithm finds shortest paths through it: every node has a price, a lower bound of
the cost from there to the end. A path grows from the origin along the arc that its end's
price pays for; where no arc is that cheap, the price rises to the cheapest and the path
shrinks by a node. When it reaches the end, prices along it are exact and its arcs tight; as
arcs are tried in the order of their letters and prices only rise, it is the first of all
cheapest paths in that order.

Prices are settled in pieces of a few rows from the end on, so paths stay short. A
conversation that lies within one task is done there. One that is longer than a block, or cut
by the edge of a task, is solved in blocks: auctions give each block's costs from each state
to each state, those are composed per task and then per conversation, and a last pass in row
order traces the edits and hashes the text, holding one block at a time.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch, save, with_columns

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = (USER, USER, ASSISTANT, USER)  # what may follow, other than a system row at the start
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
# The state after a row whose role starts with this is kept; -1 where it may not stand.
KEPT = {
    b"s": (SYSTEM, -1, -1, -1),
    b"u": (USER, USER, -1, USER),
    b"a": (-1, -1, ASSISTANT, -1),
}
NOWHERE = (-1, -1, -1, -1)
LEGAL = {(b"s", b"u"), (b"u", b"a"), (b"a", b"u")}
NEVER = float("inf")
# From each state to the end without rows: nothing, two, one or no inserted rows.
END = (0, 2 * INSERT, INSERT, 0)

PIECE = 64  # rows whose prices are settled together
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20

BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", "sound"

# One lattice row: cost to delete, number of rows deleted, states after keeping, cost to keep,
# cost to rerole (None where the row must go).
Row = tuple[int, int, tuple[int, ...], int, int | None]


def lattice_row(initial: bytes, fault: str, n: int) -> Row:
    if fault in (BLANK, DUPLICATE):
        return DELETE * n, n, NOWHERE, 0, None
    more = TRUNCATED if fault == CUT else 0
    return DELETE, 1, KEPT.get(initial, NOWHERE), more, REROLE + more


def first_prices(rows: list[Row], right) -> list[list]:
    """Lower bounds of the costs to the right edge: the least that each row costs, whatever
    comes before it. Nodes from which the edge is out of reach have the price ``NEVER``."""
    least = min(right)
    prices = [list(right)]
    shut = NEVER in right
    for delete, _, kept, keep, rerole in reversed(rows):
        own = delete if rerole is None else min(delete, keep)
        least += own
        now = [least] * STATES
        if shut:
            after = prices[-1]
            reach = [
                after[q] < NEVER
                or (rerole is not None and (after[NEXT[q]] < NEVER or kept[q] >= 0 and after[kept[q]] < NEVER))
                for q in range(STATES)
            ]
            for q in range(STATES):  # through inserted rows
                a = NEXT[q]
                if not (reach[q] or reach[a] or reach[NEXT[a]]):
                    now[q] = NEVER
        prices.append(now)
    prices.reverse()
    return prices


def auction(rows: list[Row], prices: list[list], state: int) -> tuple[list[tuple[str, int]], int]:
    """The first of the cheapest paths from the left edge at ``state`` to the right edge:
    ``(letter, state after)`` per edit, and the state reached. Prices are raised on the way;
    those at the right edge are exact and stay."""
    ks, qs, edits = [0], [state], []
    n = len(rows)
    while True:
        k, q = ks[-1], qs[-1]
        if k == n:
            return edits, q
        delete, _, kept, keep, rerole = rows[k]
        here, after = prices[k], prices[k + 1]
        to = NEXT[q]
        best, letter, at, then = delete + after[q], "D", k + 1, q
        cost = INSERT + here[to]
        if cost < best:
            best, letter, at, then = cost, "I", k, to
        if rerole is not None:
            if kept[q] >= 0:
                cost = keep + after[kept[q]]
                if cost < best:
                    best, letter, at, then = cost, "K", k + 1, kept[q]
            cost = rerole + after[to]
            if cost < best:
                best, letter, at, then = cost, "R", k + 1, to
        if best > here[q]:  # the price rises, the path shrinks
            here[q] = best
            if edits:
                edits.pop()
                ks.pop()
                qs.pop()
        else:
            edits.append((letter, then))
            ks.append(at)
            qs.append(then)


def settle(rows: list[Row], right) -> tuple[list[list[list]], list]:
    """Prices of all pieces of the rows, given the exact prices at their right edge, and the
    exact prices at their left edge."""
    pieces = []
    for start in range((len(rows) - 1) // PIECE * PIECE, -1, -PIECE):
        part = rows[start : start + PIECE]
        prices = first_prices(part, right)
        for q in range(STATES):
            if prices[0][q] < NEVER:
                auction(part, prices, q)
        pieces.append(prices)
        right = prices[0]
    return pieces[::-1], list(right)


def trace(rows: list[Row], pieces: list[list[list]], state: int) -> Iterator[tuple[int, str, int]]:
    """``row, letter, state after`` along the tight arcs, the first in letter order."""
    for number, prices in enumerate(pieces):
        start = number * PIECE
        part = rows[start : start + PIECE]
        edits, state = auction(part, prices, state)
        k = start
        for letter, then in edits:
            yield k, letter, then
            k += letter != "I"


def crossing(rows: list[Row]) -> list[list]:
    """``cost[from][to]`` over the rows; ``NEVER`` where there is no way."""
    out = [[NEVER] * STATES for _ in range(STATES)]
    for to in range(STATES):
        right = [0 if q == to else NEVER for q in range(STATES)]
        left = settle(rows, right)[1]
        for q in range(STATES):
            out[q][to] = left[q]
    return out


def before(cost: list[list], right) -> list:
    """Prices at a left edge from those at the right edge."""
    return [min(c + r for c, r in zip(row, right)) for row in cost]


def compose(a: list[list], b: list[list]) -> list[list]:
    return [[min(x + b[m][to] for m, x in enumerate(row)) for to in range(STATES)] for row in a]


# --- one conversation, block by block ----------------------------------------------------

# turn, role, text, fault, number of rows
Turn = tuple[int | None, bytes, bytes, str, int]


class Repair:
    """Counts, edits and hash of one conversation, fed with its turns in order."""

    def __init__(self):
        self.state = START
        self.cost = self.illegal = self.turns = 0
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, SOUND: 0}
        self.first = self.last = self.initial = None
        self.letters: list[str] = []
        self.hash = hashlib.sha256()
        self.empty = True

    def _count(self, turn: Turn) -> None:
        t, role, _, fault, n = turn
        self.counts[fault] += n
        if t is not None and (self.first is None or t != self.last):
            self.turns += 1
            self.first = t if self.first is None else self.first
            self.last = t
        initial = role[:1]
        if self.initial is not None:
            self.illegal += (self.initial, initial) not in LEGAL
        self.illegal += n - 1  # equal roles side by side
        self.initial = initial

    def _write(self, role: bytes, text: bytes) -> None:
        self.hash.update(role + b":" if self.empty else b"\n" + role + b":")
        self.hash.update(text)
        self.empty = False

    def feed(self, turns: list[Turn], right) -> Iterator[tuple[str, int | None, bytes, bytes]]:
        """Edit a block whose right edge has these exact prices; yields what stays:
        ``letter, turn, role, text``."""
        rows = []
        for turn in turns:
            self._count(turn)
            _, role, _, fault, n = turn
            # Of equal rows in a row the first may stay, unless it repeats an earlier turn.
            rows.append(lattice_row(role[:1], fault, n))
        for k, letter, then in trace(rows, settle(rows, right)[0], self.state):
            delete, n, _, keep, rerole = rows[k]
            self.state = then
            if letter == "D":
                self.letters.append("D" * n)
                self.cost += delete
                continue
            self.letters.append(letter)
            if letter == "I":
                self.cost += INSERT
                stays = (letter, None, NAMES[then], b"")
            else:
                t, role, text, _, _ = turns[k]
                self.cost += keep if letter == "K" else rerole
                stays = (letter, t, role if letter == "K" else NAMES[then], text)
            self._write(*stays[2:])
            yield stays

    def finish(self) -> Iterator[tuple[str, int | None, bytes, bytes]]:
        while self.state in (SYSTEM, USER):
            self.state = NEXT[self.state]
            self.letters.append("I")
            self.cost += INSERT
            self._write(NAMES[self.state], b"")
            yield "I", None, NAMES[self.state], b""

    def row(self, conv) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, 2**63 - 1)
        c = self.counts
        return (
            conv, gaps, c[BLANK], c[DUPLICATE], c[CUT], self.illegal, self.cost,
            "".join(self.letters), self.hash.hexdigest(),
        )


RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)
BLOCKS = "part int, seq int, crossing array<double>, turns binary"


# --- damage ------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of every row of ``rows(conv_id, turn, role, text,
    ..)`` after a fixed damage; ``copies`` is 0 for a dropped row and 2 for a repeated one.

    What happens is decided by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1
    empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes it a
    user's. A null counts as one space in the CRC, as role and as text; ids and turns stay null.
    Other columns are not read. Texts are handled whole, whatever their length.
    """
    key = "concat(coalesce(string(conv_id), ' '), ':', coalesce(string(turn), ' '))"
    return (
        rows.select("conv_id", "turn", "role", "text", F.expr(f"crc32({key}) % 20").alias("_c"))
        .selectExpr(
            "conv_id",
            "turn",
            "IF(_c = 4, 'user', coalesce(role, ' ')) AS role",
            "CASE _c WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') "
            "ELSE coalesce(text, ' ') END AS text",
            "CASE _c WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END AS copies",
        )
    )


# --- repair ------------------------------------------------------------------------------


def _judged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns with their first fault. Equal rows of one turn become one row with their number,
    so that no key, however often it is repeated, is more than a row per task."""
    end = "trim(TRAILING ' \\t\\n\\u000B\\u000C\\r' FROM text)"
    base = rows.selectExpr(
        "conv_id", "turn", "role", "text", "copies",
        "md5(concat(length(role), ':', role, text)) AS dig",
        f"{end} = '' AS blank",
        f"right({end}, 1) NOT IN ('.', '!', '?') AS cut",
    )
    # (role, text) on more than one row of a conversation.
    again = scratch.save(
        base.where("copies > 0 AND NOT blank")
        .groupBy("conv_id", "dig")
        .agg(F.min("turn").alias("first"), F.max(F.expr("int(turn IS NULL)")).alias("none"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "dialogue-again",
    )
    joined = base.where("copies > 0").alias("b").join(
        again.alias("g"), F.expr("b.conv_id <=> g.conv_id AND b.dig = g.dig"), "left"
    )
    own = ["b.conv_id", "b.turn", "b.dig", "b.role", "b.text", "b.copies", "b.blank", "b.cut"]
    lone = joined.where("g.none IS NULL").select(*own, F.lit(False).alias("later"))
    many = joined.where("g.none IS NOT NULL").select(
        *own, F.expr("IF(g.none = 1, b.turn IS NOT NULL, b.turn > g.first)").alias("later")
    )
    many = many.groupBy("conv_id", "turn", "dig").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"),
        F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.first("later").alias("later"),
    )
    # Conversations of which rows were dropped, so that none is forgotten.
    gone = base.where("copies = 0").select("conv_id").distinct()
    return lone.unionByName(many).unionByName(gone, allowMissingColumns=True).selectExpr(
        "conv_id", "turn", "dig", "coalesce(copies, 0L) AS copies",
        "cast(role AS binary) AS role", "cast(text AS binary) AS text",
        f"CASE WHEN blank THEN '{BLANK}' WHEN later THEN '{DUPLICATE}' WHEN cut THEN '{CUT}' "
        f"ELSE '{SOUND}' END AS fault",
    )


def _turns(t, role: bytes, text: bytes, fault: str, n: int) -> Iterable[Turn]:
    """Of equal rows all but the first are duplicates."""
    if n > 1 and fault in (CUT, SOUND):
        return ((t, role, text, fault, 1), (t, role, b"", DUPLICATE, n - 1))
    return ((t, role, text, fault, n),)


class _Out:
    """Result rows in batches."""

    def __init__(self, schema: pa.Schema, size: int = 2048):
        self.schema, self.size, self.rows, self.bytes = schema, size, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= self.size or self.bytes >= BLOCK_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _first_pass(schema: pa.Schema):
    """Sorted turns to results, or to blocks where a conversation may go on in another task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = _Out(schema), TaskContext.get().partitionId()
        none = (None,) * 4
        nothing, conv = object(), None
        conv = nothing
        turns: list[Turn] = []
        size, seq, edge = 0, 0, True  # edge: the task's first conversation, or one in blocks

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal turns, size, seq
            cost = crossing([lattice_row(t[1][:1], t[3], t[4]) for t in turns])
            packed = pickle.dumps(turns)
            yield from out.add(
                (conv, *(None,) * 8, part, seq, [float(c) for row in cost for c in row], packed), len(packed)
            )
            turns, size, seq = [], 0, seq + 1

        for batch in batches:
            for c, t, n, role, text, fault in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if c != conv or conv is nothing:
                    if conv is not nothing:
                        if edge:
                            yield from block()
                            edge = False
                        else:
                            whole = Repair()
                            for _ in whole.feed(turns, END):
                                pass
                            for _ in whole.finish():
                                pass
                            yield from out.add((*whole.row(conv), *none))
                            turns, size = [], 0
                    conv, seq = c, 0
                if not n:
                    continue  # dropped: here for its conv_id only
                for turn in _turns(t, role, text, fault, n):
                    turns.append(turn)
                size += len(text)
                if len(turns) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield from block()
                    edge = True
        if conv is not nothing:
            yield from block()  # the task's last conversation
        yield from out.flush()

    return run


def _square(flat: list[float]) -> list[list]:
    return [flat[STATES * q : STATES * (q + 1)] for q in range(STATES)]


def _across(table: pa.Table) -> pa.Table:
    """All blocks of a conversation in one task as one."""
    rows = sorted(zip(table["seq"].to_pylist(), table["crossing"].to_pylist()))
    cost = _square(rows[0][1])
    for _, flat in rows[1:]:
        cost = compose(cost, _square(flat))
    return table.select(["conv_id", "part"]).slice(0, 1).append_column(
        "crossing", pa.array([[c for row in cost for c in row]], pa.list_(pa.float64()))
    )


def _edges(key: str, out: str):
    """Prices at the right edge of every row of a group, from the last on."""

    def run(table: pa.Table) -> pa.Table:
        keys = table[key].to_pylist()
        costs = table["crossing"].to_pylist()
        after = table["right"].to_pylist() if "right" in table.column_names else None
        right = list(after[0]) if after else list(map(float, END))
        edges: list = [None] * len(keys)
        for i in sorted(range(len(keys)), key=lambda i: -keys[i]):
            edges[i] = list(right)
            right = before(_square(costs[i]), right)
        return table.select([c for c in ("conv_id", "part", "seq") if c in out]).append_column(
            "right", pa.array(edges, pa.list_(pa.float64()))
        )

    return run


def _last_pass(schema: pa.Schema):
    """Blocks in order to results, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        nothing = object()
        conv, work = nothing, None
        for batch in batches:
            for i in range(batch.num_rows):
                c = batch.column(0)[i].as_py()
                if c != conv or conv is nothing:
                    if work is not None:
                        for _ in work.finish():
                            pass
                        yield from out.add(work.row(conv))
                    conv, work = c, Repair()
                for _ in work.feed(pickle.loads(batch.column(1)[i].as_py()), batch.column(2)[i].as_py()):
                    pass
        if work is not None:
            for _ in work.finish():
                pass
            yield from out.add(work.row(conv))
        yield from out.flush()

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Per ``conv_id`` of ``rows(conv_id, turn, role, text, copies, ..)``: ``gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by the MD5 of their role and text.
    ``copies`` is how often a row stands there: 0 counts for its conv_id only, so a
    conversation without rows has zeros, an empty audit and the hash of nothing. Role and text
    are not null. A null conv_id is a conversation of its own. ``gaps`` leaves null turns out
    and is at most the largest long. An empty role can be reroled, not kept. An empty table gives an
    empty result; columns beside the five are not read.

    Sorting by range keeps a conversation in few tasks, whatever its size. The last pass is
    sequential per conversation that does not fit a block, as its hash is; it holds a block
    of at most 4,096 rows, or 8 MB of text or one longer text, at a time.
    """
    spark = rows.sparkSession
    result = with_columns(rows, ["conv_id"], RESULT)
    kind = rows.schema["conv_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        judged = _judged(rows, scratch)
        ordered = judged.repartitionByRange("conv_id", "turn", "dig").sortWithinPartitions("conv_id", "turn", "dig")
        both = with_columns(rows, ["conv_id"], f"{RESULT}, {BLOCKS}")
        first = save(
            ordered.select("conv_id", "turn", "copies", "role", "text", "fault").mapInArrow(_first_pass(_arrow(both)), both),
            "dialogue",
        )
    done = first.where("turns IS NULL").select(*result.names)
    blocks = first.where("turns IS NOT NULL")
    narrow = blocks.select("conv_id", "part", "seq", "crossing")
    parts = narrow.groupBy("conv_id", "part").applyInArrow(_across, f"conv_id {kind}, part int, crossing array<double>")
    edges = parts.groupBy("conv_id").applyInArrow(
        _edges("part", "conv_id part"), f"conv_id {kind}, part int, right array<double>"
    )
    known = narrow.alias("n").join(
        edges.alias("e"), F.expr("n.conv_id <=> e.conv_id AND n.part = e.part")
    ).select("n.conv_id", "n.part", "n.seq", "n.crossing", "e.right")
    known = save(
        known.groupBy("conv_id", "part").applyInArrow(
            _edges("seq", "conv_id part seq"), f"conv_id {kind}, part int, seq int, right array<double>"
        ),
        "dialogue-edges",
    )
    whole = blocks.alias("b").join(
        known.alias("k"), F.expr("b.conv_id <=> k.conv_id AND b.part = k.part AND b.seq = k.seq")
    ).select("b.conv_id", "b.turns", "k.right", "b.part", "b.seq")
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    last = whole.select("conv_id", "turns", "right").mapInArrow(_last_pass(_arrow(result)), result)
    return done.unionByName(last)


_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), i::BIGINT))"""
# Rows are walked through one by one, with the cheapest and then least audit per state of the
# roles: 0 at the start, 1 after a system, 2 a user, 3 an assistant row.
SQL = rf"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS tab), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS ch FROM conversations
), c AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(ch, lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS k FROM o, t
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again FROM c WHERE k <> 0
), r AS (
  SELECT *, md5(length(role) || ':' || role || text) AS dig, row_number() OVER () AS u FROM d
), n AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, dig ORDER BY turn NULLS FIRST, u) AS seen,
    left(role, 1) AS ini, lag(left(role, 1)) OVER w AS prev,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig, u)
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault FROM n
), ids AS (SELECT DISTINCT conv_id FROM conversations),
m(ini, q, q2) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
e(q, q2, ins, k) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
  (0, 2, 1, 'u'), (1, 2, 1, 'u'), (2, 3, 1, 'a'), (3, 2, 1, 'u'),
  (0, 3, 2, 'ua'), (1, 3, 2, 'ua'), (2, 2, 2, 'au'), (3, 3, 2, 'ua')),
x(q, q2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
s AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS rep FROM ids
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.rep FROM (
    SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'rep': rep}}) AS b FROM (
      SELECT s.conv_id, f.i, a.q2 AS q, s.cost + e.ins * 5 + a.cost + CASE WHEN f.fault = 'truncated' AND a.letter <> 'D' THEN 5 ELSE 0 END AS cost,
        s.audit || repeat('I', e.ins) || a.letter AS audit,
        s.rep || CASE e.k WHEN 'u' THEN 'user:' || chr(10) WHEN 'a' THEN 'assistant:' || chr(10)
          WHEN 'ua' THEN 'user:' || chr(10) || 'assistant:' || chr(10)
          WHEN 'au' THEN 'assistant:' || chr(10) || 'user:' || chr(10) ELSE '' END
        || CASE a.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
          ELSE a.role || ':' || f.text || chr(10) END AS rep
      FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN e ON e.q = s.q
      JOIN (
        SELECT 'D' AS letter, q, q AS q2, NULL AS ini, NULL AS role, 2 AS cost FROM x
        UNION ALL SELECT 'R', q, q2, NULL, role, 1 FROM x
        UNION ALL SELECT 'K', q, q2, ini, NULL, 0 FROM m
      ) a ON a.q = e.q2 AND (a.ini IS NULL OR a.ini = f.ini) AND (a.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    ) GROUP BY conv_id, i, q
  ) z
), l AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
best AS (
  SELECT s.conv_id, min({{'cost': cost + 5 * (CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END),
    'audit': audit || repeat('I', CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END),
    'rep': rep || CASE q WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10)
      WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS b
  FROM s LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(l.n, 0) GROUP BY s.conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit AS audit,
  sha256(CASE WHEN b.rep = '' THEN '' ELSE left(b.rep, length(b.rep) - 1) END) AS repaired_sha256
FROM best LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM best.conv_id
"""
