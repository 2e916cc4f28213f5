"""Chat examples with history: against plain slicing, at any size of a conversation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import history

DDL = "conv_id long, turn long, role string, text string"


def plain(turns, budget, overhead=4, count=lambda t: len(t.split())):
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t, role or "", text or ""))
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        for i, (t, role, text) in enumerate(own):
            if role != "assistant":
                continue
            j, used = i, 0
            while j and used + count(own[j - 1][2]) + overhead <= budget:
                j -= 1
                used += count(own[j][2]) + overhead
            kept = [(r, x) for _, r, x in own[j:i]]
            out.append((c, t, kept, used, text, bool(kept) and kept[-1][0] == "user"))
    return sorted(out, key=repr)


def result(df):
    return sorted(
        ((r.conv_id, r.turn, [tuple(m) for m in r.messages], r.n_tokens, r.output, r.answers) for r in df.collect()),
        key=repr,
    )


def invented(seed, n, convs, longest=12):
    rng = random.Random(seed)
    return [
        (
            rng.choice([None, *range(convs)]), rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", None]),
            None if rng.random() < 0.05 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, longest))),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("budget", [1, 5, 17, 60, 4000])
def test_equals_plain_slicing(spark, budget):
    turns = invented(budget, 300, 6) + [(2, 1000 + i, "assistant", "long " * 70) for i in range(3)]
    turns += [(3, 7, "user", "same"), (3, 7, "user", "same"), (3, 7, "assistant", "same")]
    df = spark.createDataFrame(turns, DDL).repartition(5)
    assert result(history.conversation_messages(df, budget)) == plain(turns, budget)


def test_costs_by_a_tokenizer(spark):
    def letters():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    turns = invented(3, 200, 4)
    df = spark.createDataFrame(turns, DDL)
    got = history.conversation_messages(df, 50, overhead=2, tokenizer_factory=letters)
    assert result(got) == plain(turns, 50, 2, len)

    def lazy():
        return lambda texts: []

    with pytest.raises(Exception, match="the tokenizer gave 0 results"):
        history.conversation_messages(df, 50, tokenizer_factory=lazy).collect()
    with pytest.raises(ValueError):
        history.conversation_messages(df, 50, overhead=0)


def test_running_start_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(1, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(11)
    got = {r.i: r.start for r in history.running_start(df, "g", ["i"], "n").collect()}
    total, want = {}, {}
    for g, i, n in rows:
        want[i] = total.get(g, 0)
        total[g] = want[i] + n
    assert got == want
    assert history.running_start(df.limit(0), "g", ["i"], "n").count() == 0


def test_one_conversation_of_a_million_turns(spark):
    """It is spread over tasks, and no window holds more than two budgets of tokens."""
    n, budget = 1_000_000, 64
    turns = spark.range(n).selectExpr(
        "1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
        "repeat('w ', int(id % 13)) AS text",
    )
    df = history.conversation_messages(turns, budget)
    got = df.agg(
        F.count("*").alias("n"), F.max("n_tokens").alias("most"), F.max(F.size("messages")).alias("longest"),
        F.sum("n_tokens").alias("tokens"), F.count_if("answers").alias("answers"),
    ).first()
    sample = [(1, t, "user" if t % 2 == 0 else "assistant", "w " * (t % 13)) for t in range(13 * 40)]
    # The pattern repeats every 26 turns: what 20 rounds cost tells what a million do.
    costs = [c for _, t, _, c, _, _ in plain(sample, budget) if 260 <= t < 520]
    first = [c for _, t, _, c, _, _ in plain(sample, budget) if t < 260]
    rounds, left = divmod(n - 260, 260)
    tail = [c for _, t, _, c, _, _ in plain(sample, budget) if 260 <= t < 260 + left]
    assert got.n == got.answers == n // 2 and got.most <= budget and got.longest <= budget // history.OVERHEAD
    assert got.tokens == sum(first) + rounds * sum(costs) + sum(tail)
