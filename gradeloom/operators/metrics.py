"""Validity, score summaries and comparison metrics.

Every aggregate groups by a handful of (system, trait) values and combines map-side, so
a system that holds most rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as TX
from gradeloom.operators.labels import evaluate_once
from gradeloom.settings import CRITERIA, THRESHOLD


def validity_rate(validated: DataFrame) -> DataFrame:
    """Per system: ``valid``, ``total``, ``invalid``."""
    valid = F.count_if(F.col("reason").isNull())
    return validated.groupBy("system").agg(
        valid.alias("valid"), F.count("*").alias("total"), (F.count("*") - valid).alias("invalid")
    )


def score_histogram(validated: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """``system, trait, score, n`` over valid rows: at most ten rows per system and trait,
    from which every summary and threshold follows without another pass."""
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("trait"), F.get("scores", F.lit(i)).alias("score"))
            for i, t in enumerate(criteria)
        ]
    )
    return (
        validated.where("scores is not null")
        .select("system", F.inline(rows))
        .groupBy("system", "trait", "score")
        .agg(F.count("*").alias("n"))
    )


def trait_summary_sweep(
    validated: DataFrame, thresholds: Sequence[int], criteria: Sequence[str] = CRITERIA
) -> DataFrame:
    """Per system, trait and threshold: mean, min, max, and counts above / at or below."""
    levels = F.array(*[F.lit(int(t)) for t in thresholds])
    hist = score_histogram(validated, criteria).withColumn("threshold", F.explode(levels))
    n, s = F.col("n"), F.col("score")
    above = F.when(s > F.col("threshold"), n).otherwise(0)
    return hist.groupBy("system", "trait", "threshold").agg(
        (F.sum(s * n) / F.sum(n)).alias("avg_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.sum(above).alias("n_above"),
        F.sum(n - above).alias("n_at_or_below"),
    )


def trait_summary(
    validated: DataFrame, threshold: int = THRESHOLD, criteria: Sequence[str] = CRITERIA
) -> DataFrame:
    return trait_summary_sweep(validated, [threshold], criteria).drop("threshold")


def first_k_errors(validated: DataFrame, k: int = 10, position: str = "pos") -> DataFrame:
    """The first ``k`` invalid rows of each system, by position. Each task keeps its own
    first ``k`` before anything is shuffled."""
    w = Window.partitionBy("system").orderBy(position)
    return (
        validated.where("reason is not null")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def trait_mse(traits: DataFrame) -> DataFrame:
    """Per system and trait: ``mse`` and ``n`` over comparable rows."""
    d = (F.col("score") - F.col("gt_score")).cast("bigint")
    return traits.groupBy("system", "trait").agg(
        F.avg(d * d).alias("mse"), F.count("*").alias("n")
    )


def overall_mse(per_trait: DataFrame) -> DataFrame:
    """Per system: the unweighted mean over traits; NULL if nothing was compared."""
    return per_trait.groupBy("system").agg(F.avg("mse").alias("overall_mse"))


def _hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Per pair of lower-cased texts: the words of each, and those of each that the other has
    too, repeats counted; NULL hits where a text is NULL."""
    for own, other in batches:
        rows = []
        for a, b in zip(own, other):
            p, g = (a or "").split(), (b or "").split()
            if a is None or b is None:
                rows.append((len(p), len(g), None, None))
            else:
                rows.append((len(p), len(g), sum(map(set(g).__contains__, p)), sum(map(set(p).__contains__, g))))
        yield pd.DataFrame(rows, columns=["np", "ng", "hp", "hg"], dtype="Int64")


def lexical_match(traits: DataFrame) -> DataFrame:
    """Add ``precision``, ``recall`` and ``f1`` of ``pred_text`` against ``gt_text``.

    Greedy matching with word identity as the similarity: the share of predicted words found
    in the reference, and the reverse. Both texts sit in one row, so nothing is joined. They
    are lower-cased by Spark and cut at white space and looked up by hash in its Python tasks,
    which takes time in proportion to the words of a text of any length.
    """
    kept = traits.columns
    hits = F.pandas_udf(_hits, "np bigint, ng bigint, hp bigint, hg bigint")
    df = traits.withColumn("_hits", hits(F.lower("pred_text"), F.lower("gt_text")))

    def share(n: str, hit: str):
        return F.when(F.col(f"_hits.{n}") > 0, F.col(f"_hits.{hit}") / F.col(f"_hits.{n}")).otherwise(F.lit(0.0))

    df = df.withColumns({"_pr": share("np", "hp"), "_re": share("ng", "hg")})
    return _with_f1(df).select(*kept, "precision", "recall", "f1")


def _with_f1(df: DataFrame) -> DataFrame:
    p, r = F.col("_pr"), F.col("_re")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return evaluate_once(df, p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def feedback_match(matched: DataFrame) -> DataFrame:
    """Per system and trait: mean precision, recall and F1."""
    return matched.groupBy("system", "trait").agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )


def overall_match_f1(per_trait: DataFrame) -> DataFrame:
    """Per system: the mean of the trait F1 values; NULL if nothing was compared."""
    return per_trait.groupBy("system").agg(F.avg("f1").alias("overall_f1"))


def avg_transcript_words(df: DataFrame, column: str = "text") -> DataFrame:
    """Mean number of words, and the number of texts."""
    return df.agg(
        F.avg(TX.word_count(F.coalesce(F.col(column), F.lit("")))).alias("avg_words"),
        F.count("*").alias("n"),
    )


def observe_rows(df: DataFrame, name: str, **flags) -> tuple[DataFrame, Observation]:
    """Count the rows (and the rows meeting each flag) that pass a step, without a pass of
    its own: the numbers are there once the job that uses the result has run."""
    obs = Observation(name)
    counts = [F.count_if(cond).alias(k) for k, cond in flags.items()]
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *counts), obs
