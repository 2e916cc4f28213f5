"""Evaluate prediction files against a ground-truth file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import align as A
from gradeloom.operators import metrics as M
from gradeloom.operators.labels import union_sources, with_reason
from gradeloom.session import materialize, prepare
from gradeloom.settings import CRITERIA, THRESHOLD
from gradeloom.sources import jsonl, report


TRUTH = "ground truth"  # its name among the validated files


@dataclass
class Evaluation:
    """Results as small tables, and the rendered report lines. Validity, summary and errors
    cover the ground truth too, which is judged like a prediction file. ``match`` and
    ``overall_match`` are None unless feedback was compared."""

    validity: DataFrame
    summary: DataFrame
    errors: DataFrame
    traits: DataFrame
    overall: DataFrame
    coverage: DataFrame
    match: DataFrame | None
    overall_match: DataFrame | None
    lines: DataFrame


def validate_records(records: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """``reason`` and ``scores`` for records of ``jsonl.records_of_lines``."""
    out = with_reason(records, criteria)
    return out.select(
        *[c for c in records.columns if c != "line_error"],
        F.coalesce("line_error", "reason").alias("reason"),
        "scores",
    )


def evaluate_files(
    spark: SparkSession,
    predictions: Mapping[str, str],
    truth: str,
    criteria: Sequence[str] = CRITERIA,
    thresholds: Sequence[int] = (THRESHOLD,),
    by: str = "id",
    with_feedback: bool = False,
) -> Evaluation:
    """``predictions``: system -> path. ``by``: ``id``, or ``pos`` to pair lines by number.

    Files are scanned once. What later steps share is stored narrow: opened records (labels
    only), verdicts (no text), and aligned scores; all tables and the report come from those.
    ``with_feedback`` adds the word match of feedback texts.
    """
    prepare(spark)
    records = materialize(
        jsonl.records_of_lines(jsonl.scan_systems(spark, predictions)).drop("value", "text"),
        "records",
    )
    truth_lines = jsonl.scan_lines_with_position(spark, truth)
    truth_records = materialize(
        jsonl.records_of_lines(truth_lines).drop("value", "text"), "truth-records"
    )
    every = records.unionByName(truth_records.withColumn("system", F.lit(TRUTH)))
    verdicts = validate_records(every, criteria).select("system", "pos", "reason", "scores")
    verdicts = materialize(verdicts, "verdicts")
    aligned = A.align(
        records.select("system", by, "label"),
        truth_records.select(by, "label"),
        list(predictions),
        [by],
        criteria,
        with_feedback,
    )
    aligned = materialize(aligned, "aligned")
    compared = A.compared_traits(aligned, criteria)
    traits = materialize(M.trait_mse(compared), "traits")
    coverage = A.compare_coverage(aligned)
    match = None
    if with_feedback:
        match = materialize(M.feedback_match(M.lexical_match(compared)), "match")
    blocks = [report.validity_report(verdicts, t, criteria) for t in thresholds]
    lines = union_sources(
        *[b.withColumn("block", F.lit(i)) for i, b in enumerate(blocks)],
        report.comparison_report(traits, coverage, criteria, match).withColumn(
            "block", F.lit(len(blocks))
        ),
    )
    return Evaluation(
        validity=M.validity_rate(verdicts),
        summary=M.trait_summary_sweep(verdicts, thresholds, criteria),
        errors=M.first_k_errors(verdicts),
        traits=traits,
        overall=M.overall_mse(traits),
        coverage=coverage,
        match=match,
        overall_match=M.overall_match_f1(match) if match is not None else None,
        lines=materialize(lines, "report"),
    )
