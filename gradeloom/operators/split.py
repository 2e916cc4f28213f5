"""Stratified train/val/test splits and their statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import hashing as H
from gradeloom.functions import labels as L
from gradeloom.operators.labels import parse_label
from gradeloom.operators.select import RANKED_ROWS, bucket_counts, in_buckets, kth_key, locate
from gradeloom.session import materialize
from gradeloom.settings import (
    SEED,
    STRATIFY_BY,
    THRESHOLD,
    TRAIN_RATIO,
    VAL_RATIO,
)


def with_strat_key(
    df: DataFrame,
    traits: Sequence[str] = STRATIFY_BY,
    threshold: int = THRESHOLD,
    label: str = "label",
    out: str = "strat_key",
) -> DataFrame:
    parsed = parse_label(df, label)
    return parsed.select(*df.columns, L.strat_key("parsed", traits, threshold).alias(out))


def strat_key_histogram(keyed: DataFrame, stratum: str = "strat_key") -> DataFrame:
    return keyed.groupBy(stratum).agg(F.count("*").alias("n"))


def _ceil_share(n: int, ratio: float) -> int:
    return math.ceil(float(n) * float(ratio))


def _largest_remainder(
    counts: DataFrame, count: str, seats: int, total: int, out: str, ranked_rows: int
) -> DataFrame:
    """Give ``seats`` of ``total`` to the strata in proportion to ``count``: the floor of
    each share, then one more for the largest remainders (ties: by stratum).

    Which remainders are the largest is found by their histogram, digit by digit, so the
    strata are neither sorted nor gathered.
    """
    if total == 0:
        return counts.withColumn(out, F.lit(0).cast("bigint"))
    share = f"cast({count} AS DECIMAL(19,0)) * cast({seats} AS DECIMAL(19,0))"
    df = counts.withColumns(
        {
            "_floor": F.expr(f"({share}) div cast({total} AS DECIMAL(19,0))"),
            "_rest": F.expr(f"cast(({share}) % cast({total} AS DECIMAL(19,0)) AS BIGINT)"),
        }
    )
    left = seats - (df.agg(F.sum("_floor")).first()[0] or 0)
    # Large remainders first: hex digits of what is missing, then of the stratum.
    order = F.concat(F.lpad(F.hex(F.lit(2**63 - 1) - F.col("_rest")), 16, "0"), F.hex(F.col("stratum").cast("binary")))
    df = df.withColumn("_order", order)
    cut = kth_key(df, "_order", left, ranked_rows) if left else None
    extra = F.when(F.col("_order") <= F.lit(cut), 1).otherwise(0) if left else F.lit(0)
    return df.withColumn(out, F.col("_floor") + extra).drop("_floor", "_rest", "_order")


def split_quotas(
    counts: DataFrame,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
    on_single: str = "train",
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """``stratum, n`` -> rows per stratum for ``test_n``, ``val_n`` and ``train_n``.

    Two splits in a row, as sizes go: train against the rest (the rest is rounded up), then
    val against test (test is rounded up). There may be as many strata as rows: totals are
    aggregated and the largest remainders selected by histograms, in a few passes over
    ``counts``, which should be a stored table.

    A stratum with one row cannot be split: it goes to train, or fails the job with
    ``on_single="error"``.
    """
    single = F.col("n") == 1
    total, singles = counts.agg(F.sum("n"), F.count_if(single)).first()
    total = total or 0
    if on_single == "error" and singles:
        name = counts.where(single).agg(F.min("stratum")).first()[0]
        raise ValueError(f"stratum with a single row: {name}")
    pool = total - singles
    held = min(_ceil_share(total, 1 - train_ratio), pool)
    test_share = 1 - val_ratio / (1 - train_ratio) if train_ratio < 1 else 0.0
    val_seats = held - _ceil_share(held, test_share)
    df = counts.withColumn("_n", F.when(single, 0).otherwise(F.col("n")))
    df = _largest_remainder(df, "_n", pool - held, pool, "_train", ranked_rows)
    df = df.withColumn("_rest_n", F.col("_n") - F.col("_train"))
    df = materialize(df.select("stratum", "n", "_rest_n"), "quotas")
    df = _largest_remainder(df, "_rest_n", val_seats, held, "val_n", ranked_rows)
    return df.select(
        "stratum",
        "n",
        (F.col("_rest_n") - F.col("val_n")).alias("test_n"),
        "val_n",
        (F.col("n") - F.col("_rest_n")).alias("train_n"),
    )


def _cuts(rows: DataFrame, quotas: DataFrame, counts: DataFrame, ranked_rows: int) -> DataFrame:
    """Per stratum, the hash of the last row of ``test`` and of ``val`` in hash order.

    Only rows of the buckets in which a cut falls are ranked. Copies of one key are counted,
    not listed.
    """
    targets = quotas.select(
        "stratum",
        F.inline(
            F.array(
                F.struct(F.lit("test_cut").alias("cut"), F.col("test_n").alias("target")),
                F.struct(
                    F.lit("val_cut").alias("cut"), (F.col("test_n") + F.col("val_n")).alias("target")
                ),
            )
        ),
    ).where("target > 0")
    wanted = targets.select("stratum", "cut", (F.col("target") - 1).alias("rank"))
    found = locate(rows, counts, wanted, ["stratum"], ["cut"], ranked_rows=ranked_rows)
    within = Window.partitionBy("stratum", "cut").orderBy("hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    near = (
        in_buckets(rows, found, ["stratum"])
        .groupBy("stratum", "bucket", "hash")
        .agg(F.count("*").alias("copies"))
        .join(found, ["stratum", "bucket"])
    )
    ranked = near.withColumn("through", F.sum("copies").over(within))
    return (
        ranked.where("through > rank")
        .groupBy("stratum")
        .pivot("cut", ["test_cut", "val_cut"])
        .agg(F.min("hash"))
    )


def stratified_split(
    df: DataFrame,
    stratum: str = "strat_key",
    key: Sequence[str] = ("id",),
    seed: int = SEED,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
    on_single: str = "train",
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Add ``split``: exact sizes per stratum, members by seeded hash order of the key.

    Nothing wide is shuffled and no stratum is gathered or sorted, however large, nor are the
    strata, however many: a few narrow passes find, per stratum, the hash below which a row is test and below which it is val;
    the rows themselves are then labelled in a map-only pass. Rows with the same key always
    land in the same split.
    The cuts are written first, so that Spark knows their size when it decides whether to
    broadcast them.
    """
    h = H.seeded_hash(key, seed)
    strat = F.coalesce(F.col(stratum), F.lit("unknown"))
    rows = df.select(strat.alias("stratum"), h.alias("hash"))
    buckets = bucket_counts(rows, ["stratum"])
    counts = materialize(buckets.groupBy("stratum").agg(F.sum("n").alias("n")), "strata")
    quotas = split_quotas(counts, train_ratio, val_ratio, on_single, ranked_rows)
    cuts = _cuts(rows, materialize(quotas, "quotas"), buckets, ranked_rows)
    cuts = materialize(cuts.withColumnRenamed("stratum", "_stratum"), "cuts")
    out = df.withColumns({"_hash": h, "_st": strat})
    out = out.join(cuts, F.col("_st") == F.col("_stratum"), "left")
    split = (
        F.when(F.col("_hash") <= F.col("test_cut"), "test")
        .when(F.col("_hash") <= F.col("val_cut"), "val")
        .otherwise("train")
    )
    return out.select(*df.columns, split.alias("split"))


def stratified_split_hash(
    df: DataFrame,
    key: Sequence[str] = ("id",),
    seed: int = SEED,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
) -> DataFrame:
    """Add ``split`` in one map-only pass. Ratios hold in expectation, in every stratum."""
    u = H.hex_to_long(H.seeded_hash(key, seed), 8)
    test = int(round((1 - train_ratio - val_ratio) * 16**8))
    held = int(round((1 - train_ratio) * 16**8))
    return df.withColumn(
        "split", F.when(u < test, "test").when(u < held, "val").otherwise("train")
    )


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n"))


def split_balance(
    split: DataFrame,
    traits: Sequence[str] = STRATIFY_BY,
    threshold: int = THRESHOLD,
    label: str = "label",
) -> DataFrame:
    """Per split and trait: ``low`` and ``high`` counts and their shares in percent."""
    parsed = parse_label(split, label)
    rows = ", ".join(
        f"struct({L.literal(t)} AS trait, {L.bin_sql('parsed', t, 'score', threshold=threshold)} AS bin)"
        for t in traits
    )
    counts = (
        parsed.selectExpr("split", f"inline(array({rows}))")
        .where("bin IS NOT NULL")
        .groupBy("split", "trait")
        .agg(F.expr("count_if(bin = 'low') AS low"), F.expr("count_if(bin = 'high') AS high"))
    )
    total = F.col("low") + F.col("high")
    return counts.withColumns(
        {"low_pct": F.col("low") * 100 / total, "high_pct": F.col("high") * 100 / total}
    )
