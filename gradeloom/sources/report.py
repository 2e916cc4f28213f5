"""The text report on a set of systems."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators import metrics as M
from gradeloom.operators.labels import union_sources
from gradeloom.settings import CRITERIA


# The wording and the blank lines of the report, below.


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded on its exact binary value. Python's own
    formatting; used on report lines only, of which there are a few per system."""

    def fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f"{x:.{digits}f}", na_action="ignore")

    return F.pandas_udf(fmt, "string")(value)


def _index(column: str, names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int")


def _line(part: int, item: Column | int, line_no: int, text: Column | str) -> Column:
    item = item if isinstance(item, Column) else F.lit(item)
    text = text if isinstance(text, Column) else F.lit(text)
    return F.struct(
        F.lit(part).alias("part"),
        item.alias("item"),
        F.lit(line_no).alias("line_no"),
        text.alias("line"),
    )


def _lines(df: DataFrame, *lines: Column) -> DataFrame:
    """Each row becomes report lines placed by (system, part, item, line_no)."""
    return df.select("system", F.inline(F.array(*lines)))


def validity_report(
    validated: DataFrame,
    threshold: int,
    criteria: Sequence[str] = CRITERIA,
    shown_errors: int = 10,
) -> DataFrame:
    """``system, part, item, line_no, line``: counts, first errors and score summary of each
    system. ``validated`` needs ``system, pos, reason, scores`` and is read three times:
    store it first."""
    head = _lines(
        M.validity_rate(validated),
        _line(0, 0, -1, ""),
        _line(0, 0, 0, F.concat("system", F.lit(f" check with score threshold {threshold}:"))),
        _line(0, 0, 1, F.format_string("Valid samples: %d/%d", "valid", "total")),
        _line(0, 0, 2, F.format_string("Invalid samples: %d", "invalid")),
        _line(0, 0, 3, ""),
        _line(0, 0, 4, f"Sample errors (up to {shown_errors} shown):"),
        _line(2, 0, 0, ""),
        _line(2, 0, 1, "Scoring summary:"),
        _line(3, len(criteria) + 1, 0, ""),
        _line(3, len(criteria) + 1, 1, ""),
    )
    errors = _lines(
        M.first_k_errors(validated, shown_errors),
        _line(1, F.col("rank"), 0, F.format_string("  Line %d: %s", F.col("pos") + 1, "reason")),
    )
    at = _index("trait", criteria)
    traits = _lines(
        M.trait_summary(validated, threshold, criteria).withColumn(
            "avg_text", fixed(F.col("avg_score"), 2)
        ),
        _line(3, at, 0, ""),
        _line(3, at, 1, F.concat(F.lit("Trait: "), "trait")),
        _line(3, at, 2, F.concat(F.lit("  Avg Score: "), "avg_text")),
        _line(
            3,
            at,
            3,
            F.format_string(f"  >{threshold}: %d | <={threshold}: %d", "n_above", "n_at_or_below"),
        ),
        _line(3, at, 4, F.format_string("  Min: %d, Max: %d", "min_score", "max_score")),
    )
    return union_sources(head, errors, traits)


def _values(df: DataFrame, item: Column, **named: Column) -> DataFrame:
    """One ``  name: value`` line per named number, four decimals; NULLs are left out."""
    rows = [
        F.struct(F.lit(i).alias("_no"), F.lit(name).alias("_name"), c.alias("_value"))
        for i, (name, c) in enumerate(named.items())
    ]
    prefix = F.concat(F.col("trait"), F.lit("_")) if "trait" in df.columns else F.lit("")
    name = F.when(F.col("_name") == "", F.col("trait") if "trait" in df.columns else F.lit(""))
    long = df.select("*", F.inline(F.array(*rows))).where("_value IS NOT NULL")
    text = F.concat(
        F.lit("  "),
        F.coalesce(name, F.concat(prefix, "_name")),
        F.lit(": "),
        fixed(F.col("_value"), 4),
    )
    return long.select(
        "system",
        F.lit(4).alias("part"),
        item.alias("item"),
        F.col("_no").alias("line_no"),
        text.alias("line"),
    )


def comparison_report(
    per_trait: DataFrame,
    coverage: DataFrame,
    criteria: Sequence[str] = CRITERIA,
    match: DataFrame | None = None,
) -> DataFrame:
    """The same columns for the comparison block; its title and the coverage line have a NULL
    system. Each system's values are followed by a blank line.
    ``match``: precision, recall and F1 per trait, to be listed beside the MSE."""
    at, last = _index("trait", criteria), F.lit(len(criteria) + 1)
    head = _lines(
        per_trait.select("system").distinct(),
        _line(4, 0, 0, F.concat(F.lit("Generated File: "), "system")),
        _line(4, len(criteria) + 2, 0, ""),
    )
    kind = "MSE" if match is None else "MSE and Match"
    title = _lines(
        coverage.withColumn("system", F.lit(None).cast("string")),
        _line(4, -1, 0, ""),
        _line(4, -1, 1, f"{kind} Metrics across generated files:"),
        _line(4, -1, 2, ""),
    )
    if match is None:
        values = [
            _values(per_trait, at, **{"": F.col("mse")}),
            _values(M.overall_mse(per_trait), last, overall_avg_mse=F.col("overall_mse")),
        ]
    else:
        both = per_trait.join(match, ["system", "trait"])
        overall = M.overall_mse(per_trait).join(M.overall_match_f1(match), "system")
        values = [
            _values(
                both,
                at,
                **{"": F.col("mse")},
                match_precision=F.col("precision"),
                match_recall=F.col("recall"),
                match_f1=F.col("f1"),
            ),
            _values(
                overall,
                last,
                overall_avg_mse=F.col("overall_mse"),
                overall_avg_match_f1=F.col("overall_f1"),
            ),
        ]
    foot = _lines(
        coverage.withColumn("system", F.lit(None).cast("string")),
        _line(
            5,
            0,
            0,
            F.format_string(
                "Compared %d/%d lines successfully (only counting lines valid in all files).",
                "compared",
                "total",
            ),
        ),
    )
    return union_sources(title, head, *values, foot)


def write_report(lines: DataFrame, path: str) -> None:
    """One text file in report order: validity by system, then the comparison. The report is
    a few lines per system and trait; pass it stored, so that only these meet in one task."""
    order = ["part", "item", "line_no"]
    if "block" in lines.columns:  # several thresholds: a block per system and threshold
        order = ["block", *order]
    part = F.col("part")
    section = F.when(part < 4, 0).when(F.col("item") < 0, 1).when(part == 4, 2).otherwise(3)
    rank = [section, F.col("system").asc_nulls_last(), *order]
    lines.coalesce(1).sortWithinPartitions(*rank).select("line").write.mode("overwrite").text(path)
