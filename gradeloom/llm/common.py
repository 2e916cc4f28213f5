"""Shared small pieces: saved intermediate tables, fixed-size bitmaps, ASCII case."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.session import BATCH_BYTES, prepare, scratch_path

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Python tasks get texts in batches of this many bytes, or one row if it is longer; a
    batch is held by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(prepare(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """The saved tables of one piece of work. Leaving the block removes their files, so what
    is to outlive it is saved outside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write to the shared folder and read back: later stages neither repeat the work nor
        depend on the executors that did it."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


_RECORDED: list[list[str]] = []


def save(df: DataFrame, name: str) -> DataFrame:
    """A table that outlives the operator, because its lazy result reads it."""
    own = Scratch(df.sparkSession)
    out = own.save(df, name)
    for paths in _RECORDED[-1:]:
        paths.extend(own.paths)
    return out


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note in ``paths`` what is saved meanwhile."""
    _RECORDED.append(paths)
    try:
        yield
    finally:
        _RECORDED.pop()


def release(spark: SparkSession, paths: list[str], needed: DataFrame) -> None:
    """Remove recorded tables, but for those whose files ``needed`` reads."""
    files = [f.split(":", 1)[-1].lstrip("/") for f in needed.inputFiles()]
    for path in list(paths):
        if not any(f.startswith(path.split(":", 1)[-1].lstrip("/")) for f in files):
            paths.remove(path)
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_columns(df: DataFrame, names, extra: str) -> StructType:
    """The schema of some columns of ``df`` followed by the columns of ``extra`` (DDL)."""
    return StructType([*[df.schema[n] for n in names], *StructType.fromDDL(extra).fields])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def bucket_count(rows: int, per_bucket: int) -> int:
    """A number of hash buckets that follows the number of rows."""
    return max(1, -(-rows // per_bucket))


BITMAP_BITS = 1 << 26


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A one-hash filter of 64-bit keys as ``bits / 8`` bytes, whatever the number of keys.

    Set bits are combined per 64-bit word before anything reaches the driver, so at most
    ``bits / 64`` rows of two numbers do. More keys only make it pass more; whatever reads it
    follows with an exact join.
    """
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        keys.where(F.col(column).isNotNull())
        .select(
            F.shiftright(slot, 6).alias("w"),
            F.expr(f"shiftleft(1L, int({column} & 63))").alias("b"),
        )
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys may be in the bitmap."""
    slot = keys & np.uint64(len(words) * 64 - 1)
    word = words[(slot >> np.uint64(6)).astype(np.int64)]
    return ((word >> (keys & np.uint64(63))) & np.uint64(1)).astype(bool)


def native_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> DataFrame:
    """The same filter as a table of one row ``words``, for use inside a plan through ``split``."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.where(F.col(column).isNotNull()).select(
        F.shiftright(slot, 6).cast("bigint").alias("w"),
        F.expr(f"shiftleft(1L, int({column} & 63))").alias("b"),
    )
    return save(dense_words(words, bits // 64), "bitmap")


def dense_words(words: DataFrame, n: int) -> DataFrame:
    """One row ``words``: the n longs that OR together the ``b`` of every word number ``w``."""
    none = words.sparkSession.range(n).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    each = words.unionByName(none).groupBy("w").agg(F.bit_or("b").alias("b"))
    return each.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x")).select(
        F.col("x.b").alias("words")
    )


def split(rows: DataFrame, keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` is surely not among that of ``keys``, and the others; a null is not.

    The filter is broadcast as a table of one row. As a value in the plan it would be in the code
    of every task, which the driver holds several times over.
    """
    words = native_bitmap(keys, column, bits)
    word = F.get(words["words"], F.expr(f"int(shiftrightunsigned({column} & {bits - 1}L, 6))"))
    hit = word.bitwiseAND(F.expr(f"shiftleft(1L, int({column} & 63))")) != 0
    maybe = F.coalesce(hit, F.lit(False))
    words = F.broadcast(words)
    return rows.join(words, maybe, "left_anti"), rows.join(words, maybe, "left_semi")
