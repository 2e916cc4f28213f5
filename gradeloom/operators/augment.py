"""New examples for weak traits: draw, ask for a rewrite, tag."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import prompts as P
from gradeloom.functions.text import strip
from gradeloom.operators.infer import Client, call_with_retry
from gradeloom.operators.sample import sample_join
from gradeloom.settings import SEED


def augment_minority(
    raw: DataFrame,
    n: int,
    client_factory: Callable[[], Client],
    traits: Sequence[str] = tuple(P.PERSONAS),
    key: str = "id",
    seed: int = SEED,
) -> DataFrame:
    """``trait, id, text, original, error``: ``n`` rewrites per trait of drawn texts.

    ``id`` runs 1..n within each trait, so the key of the result is (trait, id). A call is
    made once; a failed one stays as a row with its error.
    """
    source = raw.select(F.col(key).alias("_key"), strip(F.col("text")).alias("original"))
    drawn = sample_join(source, traits, n, "_key", seed)
    messages = P.rewrite_messages(F.col("trait"), F.col("original"))
    out = drawn.withColumn(
        "_r",
        call_with_retry(
            F.get(messages, F.lit(0))["content"],
            F.get(messages, F.lit(1))["content"],
            client_factory,
            max_retries=1,
            pause=0.0,
        ),
    )
    return out.select(
        "trait",
        F.col("draw").alias("id"),
        strip(F.col("_r.answer")).alias("text"),
        "original",
        F.col("_r.error").alias("error"),
    )


def until_first_error(generated: DataFrame) -> DataFrame:
    """Per trait, the rows before its first failed one. Read ``generated`` from a written
    table: it is scanned twice."""
    failed = generated.where("error is not null").groupBy("trait").agg(F.min("id").alias("_first"))
    kept = generated.join(failed, "trait", "left")
    return kept.where("_first is null or id < _first").drop("_first", "error")
