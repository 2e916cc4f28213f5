"""Conversation repair against plain search, across task and block edges, and edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import dialogue, queries
from test_llm_queries import rows

SPACE = " \t\n\x0b\x0c\r"


def damaged(original):
    out = []
    for conv, turn, role, text in original:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def order(r):
    dig = hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    return r[1] is not None, r[1] or 0, dig


def repaired(turns):
    """By going through all rows with the cheapest, then least edits per state."""
    turns = sorted(turns, key=order)
    seen, faults = set(), []
    for _, _, role, text in turns:
        body = text.rstrip(SPACE)
        faults.append(
            "blank" if not body else "duplicate" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}  # by the last role's initial

    def insert(states):
        out = dict(states)
        for q, (c, letters, kept) in states.items():
            for _ in range(2):
                q = step[q]
                c, letters, kept = c + 5, letters + "I", (*kept, names[q] + ":")
                if q not in out or (c, letters) < out[q][:2]:
                    out[q] = c, letters, kept
        return out

    for (_, _, role, text), fault in zip(turns, faults):
        now = {}

        def offer(q, c, letters, kept):
            if q not in now or (c, letters) < now[q][:2]:
                now[q] = c, letters, kept

        for q, (c, letters, kept) in insert(best).items():
            offer(q, c + 2, letters + "D", kept)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "cut" else 0
            i = role[:1]
            if i and (i == step[q] or (i == "s" and q == "")):
                offer(i, c + more, letters + "K", (*kept, f"{role}:{text}"))
            offer(step[q], c + 1 + more, letters + "R", (*kept, f"{names[step[q]]}:{text}"))
        best = now
    ends = insert(best)
    c, letters, kept = min((ends[q] for q in ("", "a") if q in ends), key=lambda x: x[:2])
    known = [t[1] for t in turns if t[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("cut"),
        sum(p not in ("su", "ua", "au") for p in pairs), c, letters,
        hashlib.sha256("\n".join(kept).encode()).hexdigest(),
    )


def plain(original, harm=damaged):
    by = {r[0]: [] for r in original}
    for r in harm(original):
        by[r[0]].append(r)
    return sorted(((c, *repaired(t)) for c, t in by.items()), key=lambda r: (r[0] is not None, r[0] or 0))


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


DDL = "conv_id long, turn long, role string, text string"


def invented(seed, n, convs, spread):
    rng = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "user", "tool", "", "sys", "User", "ua", None]
    texts = ["Yes.", "No!", "Why?", "because", "", " \n", "Yes.", "Ok. \t", "né", None, "a.\nb", "x" * 40 + "?"]
    return [
        (
            rng.choice([None, *range(convs)]), rng.choice([None, *range(-3, spread)]), rng.choice(roles),
            rng.choice(texts) if rng.random() < 0.3 else f"{rng.random()}{rng.choice(['.', '', '!'])}",
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_plain_search_on_the_whole_table(spark, sf):
    path = f"/root/testdata/sf{sf}"
    got = result(queries.QUERIES["op11_repair_conversations"](spark, path))
    assert got == plain(rows(path, "conversations", "conv_id, turn, role, text"))


@pytest.mark.parametrize("block, piece, seed", [(4096, 64, 1), (7, 3, 2), (1, 1, 3), (5, 64, 4)])
def test_invented_conversations_in_blocks(spark, monkeypatch, block, piece, seed):
    monkeypatch.setattr(dialogue, "BLOCK_ROWS", block)
    monkeypatch.setattr(dialogue, "PIECE", piece)
    original = invented(seed, 900, 40, 25) + invented(seed + 50, 500, 1, 400)  # two long ones
    df = spark.createDataFrame(original, DDL).repartition(9)
    assert result(dialogue.repair(dialogue.damage(df))) == plain(original)


def test_cheapest_edits_of_all_small_conversations(spark):
    """Every way to edit, tried out."""
    rng = random.Random(9)
    kinds = {"u": b"u", "a": b"a", "s": b"s", "x": b"x"}
    for _ in range(400):
        turns = [
            (i, rng.choice(["user", "assistant", "system", "xx"]), rng.choice([f"{i}.", f"{i}", "", "same."]))
            for i in range(rng.randint(0, 7))
        ]
        seen, lattice = set(), []
        for _, role, text in turns:
            fault = (
                dialogue.BLANK if not text else dialogue.DUPLICATE if (role, text) in seen
                else dialogue.CUT if text[-1] != "." else dialogue.SOUND
            )
            seen.add((role, text))
            lattice.append(dialogue.lattice_row(kinds[role[0]], fault, 1))
        pieces, left = dialogue.settle(lattice, dialogue.END)
        edits = list(dialogue.trace(lattice, pieces, 0))
        state = edits[-1][2] if edits else 0
        letters = "".join(e[1] for e in edits) + {1: "II", 2: "I"}.get(state, "")
        want = repaired([(0, i, role, text) for i, role, text in turns]) if turns else (0, 0, 0, 0, 0, 0, "", "")
        # Turns differ here, so their order is that of the list.
        assert (left[0], letters) == want[5:7]
        # Prices never exceed what any arc costs, and are met along the path.
        prices = pieces[0] if pieces else []
        for k, row in enumerate(lattice):
            for q in range(4):
                assert prices[k][q] <= row[0] + prices[k + 1][q]
                assert prices[k][q] <= dialogue.INSERT + prices[k][dialogue.NEXT[q]]


def test_crossing_composes_to_the_price_of_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        lattice = [
            dialogue.lattice_row(rng.choice([b"u", b"a", b"s", b"x"]), rng.choice(["blank", "sound", "truncated", "sound"]), 1)
            for _ in range(rng.randint(2, 30))
        ]
        cut = rng.randrange(len(lattice))
        a, b = dialogue.crossing(lattice[:cut]), dialogue.crossing(lattice[cut:])
        assert dialogue.compose(a, b) == dialogue.crossing(lattice)
        assert dialogue.before(dialogue.compose(a, b), dialogue.END) == dialogue.settle(lattice, dialogue.END)[1]


def test_edge_cases(spark):
    long = "word " * 400_000
    original = [
        (1, None, None, None), (1, 2**63 - 1, "user", "Hi."), (1, -(2**63), "assistant", "Yes."),
        (None, 5, "user", long + "."), (None, 5, "user", long + "."), (None, 6, "assistant", "done."),
        (2, 1, "", "Empty role."), (3, 1, "user", "?"), (4, None, "system", "Rules."),
    ]
    df = spark.createDataFrame(original, DDL)
    got = result(dialogue.repair(dialogue.damage(df)))
    want = [(c, min(g, 2**63 - 1), *more) for c, g, *more in plain(original)]
    assert got == want
    assert dialogue.repair(dialogue.damage(df.limit(0))).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("copies", "dig", "part", "audit", "later", "_c")})
    assert result(dialogue.repair(dialogue.damage(clash))) == want
    gone = [(c, t, "user", "a.") for c in range(60) for t in (1,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    got = result(dialogue.repair(dialogue.damage(spark.createDataFrame(gone, DDL))))
    assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone]


def test_one_row_many_times_and_one_long_conversation(spark):
    """A third of all rows equal, and a conversation of many blocks."""
    turn = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 3)
    many = spark.range(30_000).selectExpr("7L AS conv_id", f"{turn}L AS turn", "'user' AS role", "'Hi.' AS text")
    turns = [(8, t, "user" if t % 2 else "assistant", f"{t}{'.' if t % 5 else ''}") for t in range(20_000)]
    df = many.unionByName(spark.createDataFrame(turns, DDL))
    got = {r[0]: r for r in result(dialogue.repair(dialogue.damage(df.repartition(8))))}
    assert got[7][3] == 59_999 and got[7][5] == 59_999 and got[7][7] == "D" * 60_000
    assert got[8] == plain(turns)[0]
