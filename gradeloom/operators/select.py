"""Selecting rows by rank without ranking all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import materialize

RANKED_ROWS = 10_000  # a group that is ranked has about as many rows, however many there are
DIGITS = 3  # hex digits per step: histograms of 4096 counts
LAST = 12  # beyond so many digits rows share a bucket only as copies of one key


def kth_key(rows: DataFrame, key: str, k: int, ranked_rows: int = RANKED_ROWS) -> str | None:
    """The k-th smallest value (from 1) of a text column of hex digits that holds no value
    twice; None if there are fewer.

    A histogram of the next three digits says where the k-th row lies, and only rows that
    share its digits go on, until few are left. Nothing is sorted before that, and at most
    4369 counts reach the driver per step. A value sorts before those it is the start of.
    """
    prefix, left = "", k
    while True:
        inside = rows.where(F.col(key).startswith(prefix)) if prefix else rows
        step = F.substring(key, len(prefix) + 1, DIGITS)
        counts = inside.groupBy(step.alias("d")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted(map(tuple, counts)):
            if left <= n:
                break
            left -= n
        else:
            return None
        prefix += d
        if len(d) < DIGITS:  # the value ends here
            return prefix
        if n <= ranked_rows:
            whole = inside.where(F.col(key).startswith(prefix))
            return whole.orderBy(key).limit(left).agg(F.max(key)).first()[0]


def bucket_counts(rows: DataFrame, group: Sequence[str] = (), hash: str = "hash") -> DataFrame:
    """Rows per group and first three digits of the hash, written: at most 4096 per group."""
    first = F.left(F.col(hash), F.lit(DIGITS)).alias("bucket")
    return materialize(rows.groupBy(*group, first).agg(F.count("*").alias("n")), "buckets")


def locate(
    rows: DataFrame,
    counts: DataFrame,
    wanted: DataFrame,
    group: Sequence[str] = (),
    carry: Sequence[str] = (),
    hash: str = "hash",
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Where the rows lie that have a ``rank`` (from 0) in hash order inside their group:
    ``group, carry, bucket, rank``, the rank now among the rows of the bucket.

    ``wanted`` has ``group``, ``carry`` and ``rank``; ``counts`` is ``bucket_counts(rows)``. As
    long as a bucket has more than ``ranked_rows`` rows, the buckets looked for, and only they, are
    split by three more digits. So the directory grows with the rows, and what is left
    to rank does not. A rank and its bucket meet in an equi-join on equal shares of the group,
    under which a bucket is listed about twice; no group of either side is multiplied.
    """
    group, carry = list(group), list(carry)
    outer, at, length = [], wanted, DIGITS
    while True:
        keys = group + outer
        inside = Window.partitionBy(*keys)
        before = inside.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.select(
            "*",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"),
            F.sum("n").over(inside).alias("_total"),
            F.count("*").over(inside).alias("_parts"),
        )
        ends = F.sequence(_share(F.col("begin")), _share(F.col("begin") + F.col("n") - 1))
        spans = spans.withColumn("_share", F.explode(ends))
        if keys:
            sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_total"), F.count("*").alias("_parts"))
            asked = at.join(sizes, keys)
        else:
            total, parts = counts.agg(F.sum("n"), F.count("*")).first()
            asked = at.withColumns({"_total": F.lit(total).cast("bigint"), "_parts": F.lit(parts)})
        asked = asked.withColumn("_share", _share(F.col("rank"))).drop("_total", "_parts")
        found = asked.join(spans.drop("_total", "_parts"), [*keys, "_share"])
        hit = (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("begin") + F.col("n"))
        at = found.where(hit).select(
            *group, *carry, "bucket", (F.col("rank") - F.col("begin")).alias("rank"), "n"
        )
        at = materialize(at, "located")
        most = at.agg(F.max("n")).first()[0]
        at = at.drop("n")
        if most is None or most <= ranked_rows or length >= LAST:
            return at
        # The next digits of the rows in the buckets looked for.
        parent = F.left(F.col(hash), F.lit(length)).alias("_outer")
        length += DIGITS
        child = F.left(F.col(hash), F.lit(length)).alias("bucket")
        asked = at.select(*group, F.col("bucket").alias("_outer")).distinct()
        within = rows.select(*group, parent, child).join(asked, [*group, "_outer"], "left_semi")
        counts = materialize(within.groupBy(*group, "_outer", "bucket").agg(F.count("*").alias("n")), "buckets")
        at, outer = at.withColumnRenamed("bucket", "_outer"), ["_outer"]


def _share(position: Column) -> Column:
    """Which of as many equal shares as the group has buckets a rank belongs to."""
    return F.floor(position.cast("decimal(19,0)") * F.col("_parts") / F.col("_total")).cast("bigint")


def in_buckets(rows: DataFrame, located: DataFrame, group: Sequence[str] = (), hash: str = "hash") -> DataFrame:
    """The rows of the located buckets, with ``bucket``."""
    asked = located.select(*group, "bucket").distinct()
    length = asked.agg(F.max(F.length("bucket"))).first()[0] or DIGITS
    bucket = F.left(F.col(hash), F.lit(length))
    return rows.withColumn("bucket", bucket).join(asked, [*group, "bucket"], "left_semi")
