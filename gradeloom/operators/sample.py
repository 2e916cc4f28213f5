"""First rows, and seeded sampling with replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import hashing as H
from gradeloom.operators.select import RANKED_ROWS, bucket_counts, in_buckets, locate
from gradeloom.session import materialize
from gradeloom.settings import SEED


def head_n_with_id(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first ``n`` rows by ``order_by``, with ``id`` 1..n replacing any id.

    Spark keeps ``n`` rows per task and merges them; only those are numbered, so ``n`` is
    meant to be a sample size, not the size of the data.
    """
    first = df.orderBy(order_by).limit(n)
    numbered = first.withColumn("id", F.row_number().over(Window.orderBy(order_by)))
    return numbered.withColumn("id", F.col("id").cast("bigint"))


def sample_with_replacement(
    df: DataFrame,
    traits: Sequence[str],
    n: int,
    key: str = "id",
    seed: int = SEED,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """``n`` uniform draws per trait: ``trait, draw`` (1..n) and the drawn row's key.

    Rows are numbered in seeded hash order of their key, which must be unique. Counts per
    hash bucket tell which bucket holds a drawn number; drawn buckets with more than
    ``ranked_rows`` rows are split further, so a group that is ranked does not grow with the
    table. The rest of the table is only counted.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), H.seeded_hash([key], seed).alias("hash"))
    counts = bucket_counts(rows)
    total = counts.agg(F.sum("n")).first()[0]
    names = F.array(*[F.lit(t) for t in traits])
    draws = spark.range(1, n + 1).select(
        F.explode(names).alias("trait"), F.col("id").alias("draw")
    )
    u = H.hex_to_long(H.seeded_hash(["trait", "draw"], seed), 15)
    wanted = draws.select("trait", "draw", F.pmod(u, F.lit(total)).alias("rank"))
    placed = locate(rows, counts, wanted, carry=["trait", "draw"], ranked_rows=ranked_rows)
    order = Window.partitionBy("bucket").orderBy("hash", "key")
    ranked = in_buckets(rows, placed).select(
        "bucket", "key", (F.row_number().over(order) - 1).cast("bigint").alias("rank")
    )
    return placed.join(ranked, ["bucket", "rank"]).select(
        "trait", "draw", F.col("key").alias(key)
    )


def sample_join(
    df: DataFrame,
    traits: Sequence[str],
    n: int,
    key: str = "id",
    seed: int = SEED,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """The draws with the columns of the drawn rows.

    The draws are written first: from their known size Spark decides whether to broadcast
    them, so that the wide rows are filtered where they are read.
    """
    draws = materialize(sample_with_replacement(df, traits, n, key, seed, ranked_rows), "draws")
    return draws.join(df, key)
