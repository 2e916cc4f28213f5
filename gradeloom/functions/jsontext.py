"""Repair of JSON held in model output, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import SPACE, SPACE_CHARS, UNICODE, drop_prefix, drop_suffix, strip

# What counts as a fenced block and as a dangling comma.
FENCED_OBJECT = rf"{UNICODE}(?s)```json[{SPACE}]*(\{{.*?\}})[{SPACE}]*```"
DANGLING_COMMA = rf"{UNICODE},[{SPACE}]*([}}\]])"


def _pieces(c: Column, pattern: str) -> Column:
    """One more than ``pattern`` occurs; an escaped character is not matched as a pattern."""
    return F.size(F.split(c, pattern))


def _may_dangle(c: Column) -> Column:
    """Whether a comma, or white space other than blanks, stands before a closer, by the pieces
    between closers. The pattern itself is many times dearer, and most text needs none."""
    pieces = F.split(F.replace(c, F.lit("]"), F.lit("}")), r"\}")
    before_closer = F.slice(pieces, 1, F.size(pieces) - 1)
    ends = "," + SPACE_CHARS.replace(" ", "")

    def doubtful(x: Column) -> Column:
        own = F.rtrim(x)
        return reduce(lambda a, b: a | b, [F.endswith(own, F.lit(e)) for e in ends])

    return F.exists(before_closer, doubtful)


def simple_fix(c: Column) -> Column:
    """Drop commas that precede a closer, then add one ``}`` if more open than close.

    Dropping commas leaves the brace counts alone, so they are taken from the input.
    """
    missing = F.when(_pieces(c, r"\{") > _pieces(c, r"\}"), "}").otherwise("")
    plain = F.when(_may_dangle(c), F.regexp_replace(c, DANGLING_COMMA, "$1")).otherwise(c)
    return F.concat(plain, missing)


def outer_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such span.

    Positions instead of a greedy pattern: linear also on long text full of open braces.
    """
    start = F.instr(c, "{")
    # substring_index(.., -1) is the part behind the last "}", or all of it without one.
    tail = F.length(F.substring_index(c, "}", -1))
    size = F.length(c) - tail - start + 1
    whole = F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}"))
    return F.when(whole, c).when((start > 0) & (size > 1), F.substr(c, start, size))


def extract_object(c: Column) -> Column:
    """A fenced block if present, else the outer object, else the stripped text."""
    fenced = F.when(
        F.contains(c, F.lit("```json")), F.nullif(F.regexp_extract(c, FENCED_OBJECT, 1), F.lit(""))
    )
    return F.coalesce(fenced, outer_object(c), strip(c))


def extract_and_fix(c: Column) -> Column:
    return simple_fix(extract_object(c))


def strip_code_fence(c: Column) -> Column:
    """Remove the fence a judge model may put around its whole answer."""
    return drop_suffix(drop_prefix(strip(c), "```json\n"), "\n```")
