"""Text helpers with Python's idea of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's ``str.isspace`` accepts.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java pattern: with (?U), \\s covers all but four of these code points, in
# one test per character. Prefix UNICODE; use SPACE inside a character class.
UNICODE = "(?U)"
SPACE = r"\s\x1c-\x1f"
_GAP = rf"{UNICODE}[{SPACE}]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def _split(c: Column, empty: Column, use=lambda parts: parts) -> Column:
    text = strip(c)
    return F.when(text == "", empty).otherwise(use(F.split(text, _GAP)))


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return _split(c, F.lit(0), F.size)


def words(c: Column) -> Column:
    """Lower-cased words in order, repeats kept; an empty text gives an empty array."""
    return _split(F.lower(c), F.array().cast("array<string>"))


def drop_prefix(c: Column, prefix: str) -> Column:
    return F.when(
        F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))
    ).otherwise(c)


def drop_suffix(c: Column, suffix: str) -> Column:
    return F.when(
        F.endswith(c, F.lit(suffix)), F.left(c, F.length(c) - F.lit(len(suffix)))
    ).otherwise(c)
