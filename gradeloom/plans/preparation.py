"""From raw text to labelled, cleaned and split examples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators import labels as O
from gradeloom.operators import split as S
from gradeloom.operators.augment import augment_minority
from gradeloom.operators.infer import Client, judge_label_rows
from gradeloom.session import materialize, prepare
from gradeloom.settings import CRITERIA, SEED, STRATIFY_BY, THRESHOLD, TRAIN_RATIO, VAL_RATIO
from gradeloom.sources import jsonl


def label_corpus(
    raw: DataFrame,
    judge_factory: Callable[[], Client],
    rewriter_factory: Callable[[], Client] | None = None,
    n_per_trait: int = 0,
    criteria: Sequence[str] = CRITERIA,
    pause: float = 2.0,
) -> DataFrame:
    """``raw`` (id, text), with ``n_per_trait`` rewrites per weak trait, all judged.

    Each model stage is written before the next one reads it: its calls are not repeated
    when a later stage fails.
    """
    sources = [raw.select("id", "text")]
    if rewriter_factory and n_per_trait:
        new = materialize(augment_minority(raw, n_per_trait, rewriter_factory), "rewrites")
        sources.append(new.where("error is null").select("id", "text", "trait"))
    rows = O.union_sources(*sources[::-1])
    judged = judge_label_rows(rows, judge_factory, criteria, pause=pause)
    return materialize(judged, "judged")


def clean_and_split(
    spark: SparkSession,
    folders: Sequence[str],
    output: str,
    criteria: Sequence[str] = CRITERIA,
    traits: Sequence[str] = STRATIFY_BY,
    threshold: int = THRESHOLD,
    seed: int = SEED,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
) -> DataFrame:
    """Clean the labelled folders, split by stratum and write ``split=..`` sub-folders.

    Keys of the records beyond the known ones stay with them, in ``rest`` on the way. The cleaned rows are written once; finding the cuts and writing the splits read that.
    """
    prepare(spark)
    labeled = O.project_labeled(jsonl.scan_records(spark, folders), keep=("rest",))
    clean = materialize(S.with_strat_key(O.clean_labels(labeled, criteria), traits, threshold), "clean")
    split = S.stratified_split(
        clean,
        key=("trait", "id"),
        seed=seed,
        train_ratio=train_ratio,
        val_ratio=val_ratio,
    )
    jsonl.write_partitioned(split.drop("strat_key"), output, "split")
    return jsonl.scan_split(spark, output, "split")
