"""Seeded hash order: the same shuffle in every run, on any number of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key: Sequence[str], seed: int) -> Column:
    """md5 of the key and the seed, as hex; NULL key parts count as empty."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def hex_to_long(hex_text: Column, digits: int) -> Column:
    return F.conv(F.left(hex_text, F.lit(digits)), 16, 10).cast("bigint")


def text_hash(text: Column) -> Column:
    """What a text is known by: the first 16 bytes of its SHA-256. A null text counts as empty."""
    return F.unhex(F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(32)))
