"""Splits and sampling: sizes, membership, determinism, skew."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as TX
from gradeloom.operators import sample
from gradeloom.operators import split as S


def keyed(spark, counts):
    rows, i = [], 0
    for name, n in counts.items():
        for _ in range(n):
            rows.append((i, name))
            i += 1
    return spark.createDataFrame(rows, "id bigint, strat_key string")


def sizes(df):
    return {(r.strat_key, r.split): r["count"] for r in df.groupBy("strat_key", "split").count().collect()}


def total(found, split):
    return sum(n for (_, s), n in found.items() if s == split)


@pytest.mark.parametrize(
    "counts",
    [
        {"a": 500, "b": 300, "c": 200},
        {"a": 997, "b": 13, "c": 7, "d": 2},
        {"hot": 2000, "b": 3, "c": 5},
        {"a": 10},
    ],
)
def test_exact_sizes(spark, counts):
    n = sum(counts.values())
    out = S.stratified_split(keyed(spark, counts))
    found = sizes(out)
    held = math.ceil((1 - 0.8) * n)
    test = math.ceil((1 - 0.1 / (1 - 0.8)) * held)
    assert total(found, "test") == test
    assert total(found, "val") == held - test
    assert total(found, "train") == n - held
    for name, c in counts.items():  # every stratum within one row of its share
        assert abs(found.get((name, "train"), 0) - c * (n - held) / n) < 1
    assert out.select("id").distinct().count() == n == out.count()


def test_single_member_stratum(spark):
    out = S.stratified_split(keyed(spark, {"a": 99, "alone": 1}))
    assert out.where("strat_key = 'alone'").first().split == "train"
    assert total(sizes(out), "train") == 100 - math.ceil((1 - 0.8) * 100)
    with pytest.raises(Exception, match="stratum with a single row: alone"):
        S.stratified_split(keyed(spark, {"a": 99, "alone": 1}), on_single="error").collect()


def test_split_ignores_partitioning_and_row_order(spark):
    df = keyed(spark, {"a": 300, "b": 40})
    one = {(r.id, r.split) for r in S.stratified_split(df).collect()}
    two = {(r.id, r.split) for r in S.stratified_split(df.orderBy(F.rand(3)).repartition(7)).collect()}
    other = {(r.id, r.split) for r in S.stratified_split(df, seed=7).collect()}
    assert one == two != other


def test_members_are_the_smallest_hashes(spark):
    import hashlib

    counts = {"a": 120, "b": 45}
    out = S.stratified_split(keyed(spark, counts)).collect()
    for name in counts:
        rows = sorted(
            (hashlib.md5(f"{r.id}|42".encode()).hexdigest(), r.split) for r in out if r.strat_key == name
        )
        order = [s for _, s in rows]
        assert order == sorted(order, key=["test", "val", "train"].index)


def test_copies_of_a_key_stay_together(spark):
    rows = [(i if i > 300 else 0, "a") for i in range(900)]  # a third shares one key
    df = spark.createDataFrame(rows, "id bigint, strat_key string")
    out = S.stratified_split(df)
    assert out.where("id = 0").select("split").distinct().count() == 1
    assert out.count() == 900


def test_balance_takes_scores_as_they_stand(spark):
    import json

    scores = [7, 6, 6.5, True, "9", None]
    rows = [("train", json.dumps({"p": {"score": x, "feedback": "f"}})) for x in scores]
    df = spark.createDataFrame(rows + [("test", "oops")], "split string, label string")
    out = [r.asDict() for r in S.split_balance(df, ["p"], 6).collect()]
    assert out == [{"split": "train", "trait": "p", "low": 2, "high": 2, "low_pct": 50.0, "high_pct": 50.0}]


def test_null_stratum_and_composite_key(spark):
    rows = [(i % 50, t, None if i % 3 else "x") for i, t in enumerate(["p", "q"] * 50)]
    df = spark.createDataFrame(rows, "id bigint, trait string, strat_key string")
    out = S.stratified_split(df, key=("trait", "id"))
    assert out.count() == 100 and out.where("split is null").count() == 0


def test_quotas_do_not_overflow(spark):
    big = 10**12
    counts = spark.createDataFrame([("a", 7 * big), ("b", 2 * big), ("c", big + 1)], "stratum string, n bigint")
    rows = {r.stratum: r for r in S.split_quotas(counts).collect()}
    n = 10 * big + 1
    held = math.ceil(n * (1 - 0.8))
    assert sum(r.train_n for r in rows.values()) == n - held
    assert sum(r.test_n + r.val_n for r in rows.values()) == held
    for r in rows.values():
        assert r.train_n + r.val_n + r.test_n == r.n
        assert abs(r.train_n - r.n * (n - held) / n) < 2


def test_stratified_split_does_not_shuffle_rows(spark, sf_dir):
    from gradeloom.sources import views

    df = S.with_strat_key(views.label_gt(spark, sf_dir))
    out = S.stratified_split(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange" in line or "Window" in line:
            assert "text#" not in line
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_split_hash_is_map_only(spark):
    df = spark.range(20000)
    out = S.stratified_split_hash(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    share = {r.split: r["count"] / 20000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.01


def test_sample_matches_brute_force(spark):
    import hashlib

    ids = random.Random(5).sample(range(10**9), 777)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id bigint, text string").repartition(5)
    got = {(r.trait, r.draw): (r.id, r.text) for r in sample.sample_join(df, ["u", "v"], 150).collect()}

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    ranked = sorted(ids, key=lambda i: md5(f"{i}|42"))
    for trait in ("u", "v"):
        for d in range(1, 151):
            pick = ranked[int(md5(f"{trait}|{d}|42")[:15], 16) % len(ids)]
            assert got[(trait, d)] == (pick, f"t{pick}")
    assert len(got) == 300


def test_sample_small_table(spark):
    df = spark.createDataFrame([(5, "only")], "id bigint, text string")
    out = sample.sample_join(df, ["u"], 20).collect()
    assert len(out) == 20 and {r.id for r in out} == {5}


def test_head_n(spark):
    df = spark.createDataFrame([(i, 100 - i) for i in range(50)], "id bigint, k bigint").repartition(6)
    rows = sample.head_n_with_id(df, 3, "k").collect()
    assert sorted((r.id, r.k) for r in rows) == [(1, 51), (2, 52), (3, 53)]
    assert sample.head_n_with_id(df, 0, "k").count() == 0


TEXTS = ["a b", "  a\tb\n", "", " 　 ", "x y z", "a\x1cb\x1fc", "one", "é ü​v", "a\u0085b", "\x00 q"]


def test_words_as_python_counts_them(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select(
        "i", TX.word_count(F.col("t")).alias("n"), TX.words(F.col("t")).alias("w"), TX.strip(F.col("t")).alias("s")
    ).collect()
    for r in rows:
        assert r.n == len(TEXTS[r.i].split())
        assert r.w == TEXTS[r.i].lower().split()
        assert r.s == TEXTS[r.i].strip()
