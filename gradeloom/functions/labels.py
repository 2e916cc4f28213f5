"""What makes a parsed label valid, and how scores are read from it.

A parsed label is a VARIANT column (see ``operators.labels.parse_label``). Two rule sets
exist: *strict* accepts whole-number scores only; *lenient* accepts whatever converts to a
whole number and names the first failing trait otherwise.

The rules are written as Spark SQL text, which costs one call per rule when a plan is built
instead of hundreds. The common case, a label with just the expected keys and types, is
recognised by its schema, so that generated code stays small; the rules proper are written
once, over an array of traits, and run for the other rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DECODE_ERROR = "Unrecoverable JSON decode error"
NOT_AN_OBJECT = "Label is not an object"
OUTER_ERROR = "Outer JSON error"

_INT_TEXT = r"^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$"
_GROUPED_INT = r"^\\s*([+-]?[0-9]+(?:_[0-9]+)+)\\s*$"


def literal(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def path(*keys: str) -> str:
    """A variant path as a SQL literal; names may hold spaces."""
    return literal("$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys))


def _get(v: str, *keys: str, kind: str = "variant") -> str:
    return f"try_variant_get({v}, {path(*keys)}, '{kind}')"


def _int_of(v: str, *keys: str) -> str:
    """Truncates numbers, reads digits in strings (also grouped by ``_``), maps booleans to
    0/1; else NULL."""
    grouped = f"regexp_extract({_get(v, *keys, kind='string')}, '{_GROUPED_INT}', 1)"
    return (
        f"coalesce({_get(v, *keys, kind='bigint')}, "
        f"try_cast(replace({grouped}, '_', '') AS BIGINT))"
    )


def score_sql(v: str, trait: str) -> str:
    return _int_of(v, trait, "score")


def score(v: str, trait: str) -> Column:
    """The score as a whole number (BIGINT), NULL if it is not one."""
    return F.expr(score_sql(v, trait))


def feedback_sql(v: str, trait: str) -> str:
    return _get(v, trait, "feedback", kind="string")


def _plain_schema(criteria: Sequence[str]) -> str:
    """The schema of a label with just the expected keys and types (keys are sorted)."""
    trait = "OBJECT<feedback: STRING, score: BIGINT>"
    names = [c if c.replace("_", "").isalnum() else f"`{c}`" for c in sorted(criteria)]
    return literal("OBJECT<" + ", ".join(f"{n}: {trait}" for n in names) + ">")


def _traits(v: str, criteria: Sequence[str]) -> str:
    items = [f"struct({literal(t)} AS name, {_get(v, t)} AS value)" for t in criteria]
    return f"array({', '.join(items)})"


def strict_ok(v: str, criteria: Sequence[str]) -> Column:
    """True when every trait has a whole-number score in 1..10 and a text feedback."""
    in_range = " AND ".join(
        f"coalesce({_get(v, t, 'score', kind='bigint')} BETWEEN 1 AND 10, false)" for t in criteria
    )
    rule = f"""forall({_traits(v, criteria)}, x -> coalesce(
        schema_of_variant({_get('x.value', 'score')}) IN ('BIGINT', 'BOOLEAN')
        AND schema_of_variant({_get('x.value', 'feedback')}) = 'STRING', false))"""
    plain = f"coalesce(schema_of_variant({v}) = {_plain_schema(criteria)}, false)"
    return F.expr(f"{in_range} AND ({plain} OR {rule})")


def lenient_reason(v: str, criteria: Sequence[str], scores: Sequence[str]) -> Column:
    """NULL for a valid label, else why it fails, for the first failing trait in order.

    ``scores``: names of the columns that hold ``score`` of each trait.
    """
    in_range = " AND ".join(f"coalesce({s} BETWEEN 1 AND 10, false)" for s in scores)
    sc, fb = _get("x.value", "score"), _get("x.value", "feedback")
    number, kind = _int_of("x.value", "score"), f"schema_of_variant({sc})"
    # A number too large for BIGINT is still a whole number: out of range, not "not int".
    huge = f"""(startswith({kind}, 'DECIMAL')
        OR ({kind} = 'DOUBLE' AND abs({_get('x.value', 'score', kind='double')}) < double('Infinity'))
        OR ({kind} = 'STRING' AND {_get('x.value', 'score', kind='string')} RLIKE '{_INT_TEXT}'))"""
    rule = f"""CASE
        WHEN schema_of_variant(x.value) = 'OBJECT<feedback: STRING, score: BIGINT>'
          AND {_get('x.value', 'score', kind='bigint')} BETWEEN 1 AND 10 THEN NULL
        WHEN x.value IS NULL THEN concat('Missing field: ', x.name)
        WHEN NOT startswith(schema_of_variant(x.value), 'OBJECT')
          THEN concat("Field '", x.name, "' is not a dict")
        WHEN {sc} IS NULL OR {fb} IS NULL
          THEN concat("Field '", x.name, "' missing 'score' or 'feedback'")
        WHEN {number} IS NULL AND NOT {huge} THEN concat("Score in '", x.name, "' is not int")
        WHEN NOT coalesce({number} BETWEEN 1 AND 10, false)
          THEN concat("Score in '", x.name, "' outside range")
        WHEN schema_of_variant({fb}) <> 'STRING'
          THEN concat("Feedback in '", x.name, "' is not str")
        END"""
    failing = f"filter(transform({_traits(v, criteria)}, x -> {rule}), r -> r IS NOT NULL)"
    return F.expr(
        f"""CASE WHEN {in_range} AND schema_of_variant({v}) = {_plain_schema(criteria)} THEN NULL
        WHEN {v} IS NULL THEN '{DECODE_ERROR}'
        WHEN schema_of_variant({v}) RLIKE '^(BIGINT|DOUBLE|DECIMAL|BOOLEAN|VOID)'
          THEN '{NOT_AN_OBJECT}'
        ELSE get({failing}, 0) END"""
    )


def score_bin(value: Column, threshold: int) -> Column:
    """``high`` above the threshold, ``low`` otherwise, NULL without a score."""
    return F.when(value > threshold, "high").when(value.isNotNull(), "low")


def bin_sql(v: str, *keys: str, threshold: int) -> str:
    """The bin of a score as it stands: fractions count, text does not (NULL)."""
    numeric = f"schema_of_variant({_get(v, *keys)}) RLIKE '^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)'"
    high = f"{_get(v, *keys, kind='double')} > {threshold}"
    return f"IF({numeric}, IF({high}, 'high', 'low'), NULL)"


def strat_key(v: str, traits: Sequence[str], threshold: int) -> Column:
    """Bins joined by ``_``. An absent trait is skipped; a label that cannot be read, or a
    trait whose score is not a number, gives ``unknown``."""
    bins = f"""transform(filter({_traits(v, traits)}, x -> x.value IS NOT NULL),
        x -> {bin_sql('x.value', 'score', threshold=threshold)})"""
    readable = f"schema_of_variant({v}) RLIKE '^(OBJECT|ARRAY|STRING)'"
    plain = [f"schema_of_variant({_get(v, t, 'score')}) = 'BIGINT'" for t in traits]
    fast = ", ".join(
        f"IF({_get(v, t, 'score', kind='bigint')} > {threshold}, 'high', 'low')" for t in traits
    )
    return F.expr(
        f"""CASE WHEN {' AND '.join(plain)} THEN concat_ws('_', {fast})
        WHEN NOT coalesce({readable}, false) OR exists({bins}, b -> b IS NULL) THEN 'unknown'
        ELSE concat_ws('_', {bins}) END"""
    )
