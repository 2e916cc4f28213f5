"""Rows by rank: digit by digit, with groups of bounded size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import hashing as H
from gradeloom.operators import sample, select
from gradeloom.operators import split as S


@pytest.mark.parametrize("ranked", [1, 7, 10_000])
def test_kth_key(spark, ranked):
    rng = random.Random(ranked)
    keys = {"".join(rng.choice("0A") for _ in range(rng.randint(1, 14))) for _ in range(400)}
    keys |= {"AB", "ABC", "ABCD", "ABCDE", "ABCDEF0"}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    order = sorted(keys)
    for k in {1, 2, 3, len(order), *rng.sample(range(1, len(order)), 6)}:
        assert select.kth_key(df, "k", k, ranked) == order[k - 1]
    assert select.kth_key(df, "k", len(order) + 1, ranked) is None


def hashed(spark, n, groups):
    rows = spark.range(n).selectExpr("id", f"concat('g', id % {groups}) AS g")
    return rows.withColumn("hash", H.seeded_hash(["id"], 1))


@pytest.mark.parametrize("ranked, buckets", [(3, 3), (50, 50), (10_000, 10_000)])
def test_located_buckets_are_of_bounded_size(spark, ranked, buckets):
    rows = hashed(spark, 60_000, 2)
    by_group = {}
    for r in rows.select("g", "hash").collect():
        by_group.setdefault(r.g, []).append(r.hash)
    order = {g: sorted(h) for g, h in by_group.items()}
    rng = random.Random(ranked)
    asked = [(g, i, rng.randrange(30_000)) for g in order for i in range(40)] + [("g0", 99, 0), ("g1", 99, 29_999)]
    wanted = spark.createDataFrame(asked, "g string, i long, rank long")
    found = select.locate(rows, select.bucket_counts(rows, ["g"]), wanted, ["g"], ["i"], ranked_rows=ranked)
    near = select.in_buckets(rows, found, ["g"])
    assert near.groupBy("g", "bucket").count().agg(F.max("count")).first()[0] <= buckets
    members = {}
    for r in near.collect():
        members.setdefault((r.g, r.bucket), []).append(r.hash)
    got = {(r.g, r.i): sorted(members[r.g, r.bucket])[r.rank] for r in found.collect()}
    assert got == {(g, i): order[g][rank] for g, i, rank in asked}


def test_draws_do_not_depend_on_the_bucket_size(spark):
    rows = hashed(spark, 30_000, 1).select("id")
    draws = [
        sorted(map(tuple, sample.sample_with_replacement(rows, ["a", "b"], 500, ranked_rows=r).collect()))
        for r in (1, 4, 10_000)
    ]
    assert draws[0] == draws[1] == draws[2] and len(draws[0]) == 1000
    assert sample.sample_with_replacement(rows.limit(0), ["a"], 5).count() == 0


def test_splits_do_not_depend_on_the_bucket_size(spark):
    rows = hashed(spark, 20_000, 7).selectExpr("id", "g AS strat_key")
    rows = rows.unionByName(rows.where("id < 40").selectExpr("5L AS id", "strat_key"))  # copies of a key
    splits = [
        sorted(map(tuple, S.stratified_split(rows, ranked_rows=r).collect())) for r in (1, 30, 10_000)
    ]
    assert splits[0] == splits[1] == splits[2]


def quotas(counts, train=0.8, val=0.1):
    total = sum(counts.values())
    m = {s: 0 if n == 1 else n for s, n in counts.items()}
    pool = sum(m.values())
    held = min(math.ceil(total * (1 - train)), pool)

    def shares(own, seats):
        whole = sum(own.values())
        if not whole:
            return dict.fromkeys(own, 0)
        out = {s: n * seats // whole for s, n in own.items()}
        for s in sorted(own, key=lambda s: (-(own[s] * seats % whole), s.encode()))[: seats - sum(out.values())]:
            out[s] += 1
        return out

    trained = shares(m, pool - held)
    rest = {s: m[s] - trained[s] for s in m}
    vals = shares(rest, held - math.ceil(held * (1 - val / (1 - train))))
    return {s: (n, rest[s] - vals[s], vals[s], n - rest[s]) for s, n in counts.items()}


@pytest.mark.parametrize("seed, strata, most", [(1, 3000, 3), (2, 500, 40), (3, 12, 100_000), (4, 40, 1)])
def test_quotas_of_very_many_strata(spark, seed, strata, most):
    rng = random.Random(seed)
    counts = {f"s{i}{'é' * (i % 3)}": rng.randint(1, most) for i in range(strata)}
    df = spark.createDataFrame(list(counts.items()), "stratum string, n long")
    got = S.split_quotas(df, ranked_rows=20).select("stratum", "n", "test_n", "val_n", "train_n")
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == quotas(counts)


def test_counts_beyond_double_precision(spark):
    counts = {"a": 2**53 + 1, "b": 2**60, "c": 3, "d": 2**53 + 1}
    df = spark.createDataFrame(list(counts.items()), "stratum string, n long")
    got = {r.stratum: r.test_n + r.val_n + r.train_n for r in S.split_quotas(df).collect()}
    assert got == counts


def test_no_window_over_all_strata(spark):
    rows = hashed(spark, 500, 50).selectExpr("id", "g AS strat_key")
    counts = rows.groupBy(F.col("strat_key").alias("stratum")).agg(F.count("*").alias("n"))
    plan = S.split_quotas(counts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    plan = S.stratified_split(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
