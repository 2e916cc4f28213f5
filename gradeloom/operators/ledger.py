"""Judge calls that are made once and kept: a ledger of answers by prompt.

A call costs money and time, so its answer outlives the job. The ledger is a folder of Parquet
files with one row per call, keyed by the SHA-256 of the prompt. A run first looks up what the
ledger holds, asks once for every distinct prompt that is missing, and adds the answers. The
files of a task are moved into place when the task ends, so a run that dies midway
leaves the answers of its finished tasks, and the next run asks only for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import jsontext
from gradeloom.functions import prompts as P
from gradeloom.operators.infer import Client, call_with_retry
from gradeloom.session import materialize
from gradeloom.settings import CRITERIA

SCHEMA = "prompt_hash STRING, answer STRING, error STRING, attempts INT"
CALLS_PER_TASK = 1000  # at most so many calls are lost with a task


def prompt_hash(system: Column, user: Column) -> Column:
    """Of both parts and their border."""
    parts = [F.coalesce(c, F.lit("")) for c in (system, user)]
    return F.sha2(F.concat(F.length(parts[0]).cast("string"), F.lit(":"), *parts), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``prompt_hash, answer, error, attempts``: one row per prompt, an answer if there is one.

    A prompt may stand there more than once: it failed before it was answered, or a task was
    repeated after it had stored its answers. The least answer counts, else the last error by text.
    """
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:  # not begun yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    # An answer sorts before an error.
    entry = F.min(F.struct(F.col("answer").isNull().alias("failed"), "answer", "error", "attempts"))
    best = rows.groupBy("prompt_hash").agg(entry.alias("e"))
    return best.select("prompt_hash", "e.answer", "e.error", "e.attempts")


def fill_ledger(
    asked: DataFrame,
    ledger: str,
    client_factory: Callable[[], Client],
    max_retries: int = 2,
    pause: float = 2.0,
    calls_per_task: int = CALLS_PER_TASK,
) -> int:
    """Answer every distinct prompt of ``asked(prompt_hash, system, user)`` that the ledger has
    no answer to; returns how many were asked. Prompts that failed before are asked again."""
    spark = asked.sparkSession
    done = read_ledger(spark, ledger).where("answer IS NOT NULL").select("prompt_hash")
    missing = asked.join(done, "prompt_hash", "left_anti")
    # Equal prompts are one; the text of one of them goes along.
    missing = missing.groupBy("prompt_hash").agg(F.first("system").alias("system"), F.first("user").alias("user"))
    missing = materialize(missing, "missing-prompts")
    n = missing.count()
    if n:
        spread = missing.repartition(max(1, -(-n // calls_per_task)), "prompt_hash")
        answers = spread.select(
            "prompt_hash",
            call_with_retry(F.col("system"), F.col("user"), client_factory, max_retries, pause).alias("_r"),
        ).select("prompt_hash", "_r.answer", "_r.error", "_r.attempts")
        writer = answers.write.mode("append")
        # Committed per task, not per job: what is answered stays answered.
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    return n


def judge_with_ledger(
    df: DataFrame,
    ledger: str,
    client_factory: Callable[[], Client],
    criteria: Sequence[str] = CRITERIA,
    max_retries: int = 2,
    pause: float = 2.0,
    calls_per_task: int = CALLS_PER_TASK,
) -> DataFrame:
    """As ``judge_label_rows``, with the answers of ``ledger``: a second run over the same
    texts, or over some of them, makes no call, and equal texts are asked about once.

    A row that fails every try stays, with a NULL label and its error, and is tried again by
    the next run. Runs that share a ledger must follow each other.
    """
    messages = P.judge_messages(F.col("text"), criteria)
    system, user = F.get(messages, F.lit(0))["content"], F.get(messages, F.lit(1))["content"]
    key = prompt_hash(system, user)
    asked = df.select(key.alias("prompt_hash"), system.alias("system"), user.alias("user"))
    fill_ledger(asked, ledger, client_factory, max_retries, pause, calls_per_task)
    answers = read_ledger(df.sparkSession, ledger)
    answers = answers.select(
        F.col("prompt_hash").alias("_key"),
        F.struct("answer", "error", "attempts").alias("_answer"),
    )
    out = df.withColumn("_own", key).join(answers, F.col("_own") == F.col("_key"), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("label", "error", "attempts")],
        jsontext.strip_code_fence(F.col("_answer.answer")).alias("label"),
        F.when(F.col("_answer.answer").isNull(), F.col("_answer.error")).alias("error"),
        F.col("_answer.attempts").alias("attempts"),
    )
