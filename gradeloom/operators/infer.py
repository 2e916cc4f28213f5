"""Batch model calls.

A model is passed in as a picklable factory and built once per task. Only the prompt goes to
Python and only the answer comes back; id, text and the rest of the row stay in the JVM.
Calls are marked non-deterministic, so Spark neither repeats nor moves them within a plan.
A lost executor still means its calls are made again: write the result with
``session.materialize`` before reading it more than once, and leave speculation off.
Rows reach Python in Arrow batches of ``spark.sql.execution.arrow.maxRecordsPerBatch``;
lower it where texts are very long. The batch a model sees is ``batch_size``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import jsontext
from gradeloom.functions import prompts as P
from gradeloom.settings import CRITERIA

# (instructions, input) -> answer
Client = Callable[[str, str], str]
# chat texts -> answers, one per text
Model = Callable[[Sequence[str]], Sequence[str]]


def call_with_retry(
    system: Column,
    user: Column,
    client_factory: Callable[[], Client],
    max_retries: int = 2,
    pause: float = 2.0,
) -> Column:
    """``struct(answer, error, attempts)`` of one call per row, tried ``max_retries`` times."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for systems, users in batches:
            out = []
            for s, u in zip(systems, users):
                answer, error, tried = None, None, 0
                while answer is None and tried < max_retries:
                    tried += 1
                    try:
                        answer, error = client(s, u), None
                        if answer is None:
                            raise ValueError("no answer")
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause)
                out.append((answer, error, tried))
            yield pd.DataFrame(out, columns=["answer", "error", "attempts"])

    udf = F.pandas_udf(run, "answer string, error string, attempts int").asNondeterministic()
    return udf(system, user)


def judge_label_rows(
    df: DataFrame,
    client_factory: Callable[[], Client],
    criteria: Sequence[str] = CRITERIA,
    max_retries: int = 2,
    pause: float = 2.0,
    concurrency: int | None = None,
) -> DataFrame:
    """Ask the judge about every text: ``label`` without its code fence, ``error`` and
    ``attempts``. A row that fails every try stays, with a NULL label.

    ``concurrency`` bounds the parallel callers by spreading rows over that many tasks.
    """
    if concurrency:
        df = df.repartition(concurrency)
    messages = P.judge_messages(F.col("text"), criteria)
    out = df.withColumn(
        "_r",
        call_with_retry(
            F.get(messages, F.lit(0))["content"],
            F.get(messages, F.lit(1))["content"],
            client_factory,
            max_retries,
            pause,
        ),
    )
    return out.withColumns(
        {
            "label": jsontext.strip_code_fence(F.col("_r.answer")),
            "error": F.col("_r.error"),
            "attempts": F.col("_r.attempts"),
        }
    ).drop("_r")


def generate(
    prompt: Column, model_factory: Callable[[], Model], batch_size: int = 20
) -> Column:
    """``struct(answer, error)``: prompts go to the model ``batch_size`` at a time; if the
    model raises, or gives more or fewer answers than prompts, every row of that batch gets
    the error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for prompts in batches:
            out = []
            for i in range(0, len(prompts), batch_size):
                part = prompts.iloc[i : i + batch_size].tolist()
                try:
                    answers = list(model(part))
                    if len(answers) != len(part):
                        raise ValueError(f"{len(answers)} answers for {len(part)} prompts")
                    out += [(a, None) for a in answers]
                except Exception as e:
                    out += [(None, f"{type(e).__name__}: {e}")] * len(part)
            yield pd.DataFrame(out, columns=["answer", "error"])

    return F.pandas_udf(run, "answer string, error string").asNondeterministic()(prompt)


def batch_infer(
    df: DataFrame,
    model_factory: Callable[[], Model],
    criteria: Sequence[str] = CRITERIA,
    batch_size: int = 20,
) -> DataFrame:
    """``id, text, label, error`` for every row: prompt, model and result in one job."""
    prompt = P.chat_text(P.prompt_messages(F.col("text"), criteria))
    out = df.select("id", "text", generate(prompt, model_factory, batch_size).alias("_r"))
    return out.select(
        "id", "text", F.col("_r.answer").alias("label"), F.col("_r.error").alias("error")
    )


def infer_many_systems(
    df: DataFrame,
    systems: Mapping[str, Callable[[], Model]],
    criteria: Sequence[str] = CRITERIA,
    batch_size: int = 20,
) -> DataFrame:
    """The same for several checkpoints, named by ``system``. Each has tasks of its own, so
    a worker holds one model at a time; no group of rows is gathered."""
    parts = [
        batch_infer(df, factory, criteria, batch_size).select(F.lit(name).alias("system"), "*")
        for name, factory in systems.items()
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out
