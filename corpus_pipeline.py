"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mix.

Every stage takes the documents its predecessor has kept, and all but the last return the
columns of ``documents``. ``run`` writes each stage's result and reads it again, so a stage
depends on files only; then it removes what the stage had saved. A stage that is called alone
leaves the tables its lazy result reads in the shared folder.

In every stage columns beside ``doc_id``, ``text`` and ``source`` come back as they are, whatever
their names; repeated rows, nulls in any column and texts of any length are rows like
others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, minhash, mixing, quality, repeats
from gradeloom.llm.common import recorded, release, save, small_batches, table
from gradeloom.session import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


NEAR_PERCENT = 80  # op2 by itself links from 85 on


def _stage(build: Stage) -> Stage:
    @wraps(build)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(prepare(spark))
        return build(spark, docs, sf_dir)

    return stage


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Empty and null texts have the score of
    no features; a null doc_id is never learned from."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    scored = quality.score(packed, table(spark, sf_dir, "labels"), keep=("_row", "doc_id"))
    return scored.where("predicted = 1").select("_row.*")


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. A text without words is like no other,
    so all of those stay; of equal rows one stays."""
    return minhash.deduplicate(docs, percent=NEAR_PERCENT)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand earlier already. A null text stays null or
    becomes empty; a text may become empty, its row stays."""
    return repeats.remove_repeats(docs)


@_stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window. A text without words holds none."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = decontaminate.find(packed, table(spark, sf_dir, "benchmark"), keep=("_row",))
    return found.where(~F.col("contaminated")).select("_row.*")


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, numbered by ``copy``, or ``copy_`` where
    the documents have such a column. A null source is a source of its own; texts without
    words take no words but are drawn like others."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("benchmark", without_leaks),
    ("mix", mixed),
]

# The classifier and the grouping of near-duplicates are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        left: list[str] = []
        with recorded(left):
            result = stage(spark, docs, sf_dir)
            written: list[str] = []
            with recorded(written):
                new = save(result, f"pipeline-{name}")
        # The result is a written table now: what it was made from can go.
        release(spark, left + old, new)
        docs, old = new, written
    return docs
