"""Parsing, repair, validation and cleaning of labels held as JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import jsontext
from gradeloom.functions import labels as L
from gradeloom.settings import CRITERIA

def evaluate_once(df: DataFrame, *new: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a projected column is normally pushed below the projection with the
    expression copied into it, so a JSON parse would run several times. The one-element
    ``inline`` is where that copying stops; it stays inside generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*new))))


def quoted(names: Sequence[str]) -> list[str]:
    """Column names for use in SQL text."""
    return [f"`{n}`" for n in names]


_CANDIDATE = {"simple": lambda text: text, "extract": jsontext.extract_object}

# Text between [ and ] so that trailing words or a second value are rejected.
_WRAPPED = "try_parse_json(concat('[', {0}, ']'))"

# The one JSON value of the text, NULL if there is anything else in it. Text that closes
# the bracket itself ("{..}] x") would hide what follows, so text with a "]" must also
# parse inside an object.
_SINGLE = """CASE WHEN try_variant_get({0}, '$[1]', 'variant') IS NULL
  AND (NOT contains({1}, ']') OR try_parse_json(concat('{{"v":', {1}, '}}')) IS NOT NULL)
  THEN try_variant_get({0}, '$[0]', 'variant') END"""


def parse_label(
    df: DataFrame,
    label: str = "label",
    fix: str | None = None,
    always: bool = False,
    out: str = "parsed",
) -> DataFrame:
    """Add ``parsed`` (VARIANT, NULL if unreadable), ``parsed_text`` and ``repaired``.

    ``fix``: None, ``simple`` or ``extract``. The fix is tried on text that does not parse;
    with ``always`` it is applied first, to every row.
    """
    kept = df.columns
    if always:
        df = df.select("*", _CANDIDATE[fix](F.col(label)).alias("_e"))
        df = df.select("*", jsontext.simple_fix(F.col("_e")).alias("_t"))
        src, fix = "_t", None
    else:
        src = label
    df = df.selectExpr("*", _WRAPPED.format(f"`{src}`") + " AS _w")
    df = df.selectExpr("*", _SINGLE.format("_w", f"`{src}`") + " AS _p")
    value, text, repaired = F.col("_p"), F.col(src), F.lit(False)
    if fix:
        candidate = F.when(F.col("_p").isNull(), _CANDIDATE[fix](F.col(label)))
        df = df.select("*", candidate.alias("_e"))
        df = df.select("*", jsontext.simple_fix(F.col("_e")).alias("_f"))
        df = df.selectExpr("*", _WRAPPED.format("_f") + " AS _fw")
        df = df.selectExpr("*", _SINGLE.format("_fw", "_f") + " AS _fp")
        repaired = F.col("_fp").isNotNull()
        value = F.coalesce(value, F.col("_fp"))
        text = F.when(repaired, F.col("_f")).otherwise(text)
    new = F.struct(value.alias(out), text.alias(f"{out}_text"), repaired.alias("repaired"))
    return df.select(*kept, F.inline(F.array(new)))


def filter_valid_strict(
    df: DataFrame, criteria: Sequence[str] = CRITERIA, label: str = "label"
) -> DataFrame:
    """Rows whose label parses as it stands and passes the strict rules."""
    keep = parse_label(df, label).where(L.strict_ok("parsed", criteria))
    return keep.select(*df.columns)


def clean_labels(
    df: DataFrame, criteria: Sequence[str] = CRITERIA, label: str = "label", key: str = "id"
) -> DataFrame:
    """Valid rows only, with the repaired text in place of a label that needed repair.

    The key is kept: inference and evaluation need it later. Rows without one are rejected.
    """
    keep = parse_label(df.where(F.col(key).isNotNull()), label, fix="simple").where(
        L.strict_ok("parsed", criteria)
    )
    return keep.withColumn(label, F.col("parsed_text")).select(*df.columns)


def with_reason(
    df: DataFrame,
    criteria: Sequence[str] = CRITERIA,
    label: str = "label",
    fix: str | None = "extract",
    always: bool = False,
) -> DataFrame:
    """Add ``parsed``, ``repaired``, ``reason`` (NULL for a valid label) and ``scores``
    (whole numbers in criteria order, NULL unless valid)."""
    df = parse_label(df, label, fix=fix, always=always)
    kept, names = df.columns, [f"_s{i}" for i in range(len(criteria))]
    scores = [f"{L.score_sql('parsed', t)} AS {n}" for n, t in zip(names, criteria)]
    df = df.selectExpr("*", *scores)
    df = df.select("*", L.lenient_reason("parsed", criteria, names).alias("_r"))
    ints = ", ".join(f"int({n})" for n in names)
    new = f"struct(_r AS reason, IF(_r IS NULL, array({ints}), NULL) AS scores)"
    return df.selectExpr(*quoted(kept), f"inline(array({new}))")


def validate_lenient(
    df: DataFrame, criteria: Sequence[str] = CRITERIA, label: str = "label"
) -> DataFrame:
    """Every row, with ``reason``, ``repaired`` and ``scores``."""
    return with_reason(df, criteria, label).select(*df.columns, "reason", "repaired", "scores")


def reject_reasons(
    df: DataFrame, criteria: Sequence[str] = CRITERIA, label: str = "label"
) -> DataFrame:
    """The rows that fail, with why."""
    return validate_lenient(df, criteria, label).where("reason is not null").drop("scores")


def traits_to_long(
    df: DataFrame, criteria: Sequence[str] = CRITERIA, label: str = "label"
) -> DataFrame:
    """One row per valid label and trait: ``trait``, ``score``, ``feedback``."""
    valid = with_reason(df, criteria, label).where("reason IS NULL")
    rows = ", ".join(
        f"struct({L.literal(t)} AS trait, scores[{i}] AS score, "
        f"{L.feedback_sql('parsed', t)} AS feedback)"
        for i, t in enumerate(criteria)
    )
    return valid.selectExpr(*quoted(df.columns), f"inline(array({rows}))")


def project_labeled(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """id, text, label and, where the source has it, trait; other columns are dropped, but
    for those of ``keep`` (such as ``rest``, the unread keys of a record)."""
    trait = F.col("trait") if "trait" in df.columns else F.lit(None)
    return df.select("id", "text", "label", trait.cast("string").alias("trait"), *keep)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; a column one source lacks is NULL there. Copies are kept."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
