"""Supervised fine-tuning examples and their token masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import prompts as P
from gradeloom.settings import CRITERIA, IGNORE_INDEX, MAX_TOKENS

NO_OUTPUT = "no output"

# texts -> token ids, one list per text
Encode = Callable[[Sequence[str]], Sequence[Sequence[int]]]


def sft_examples(df: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """``id, messages, output``: the prompt and the label the model should learn."""
    return df.select(
        "id",
        P.prompt_messages(F.col("text"), criteria).alias("messages"),
        F.col("label").alias("output"),
    )


def conversation_sft(turns: DataFrame) -> DataFrame:
    """Every turn: ``conv_id, turn, role, content, target, unanswered, duplicate``.

    ``target``: an assistant turn that answers the user turn before it, which a model should
    learn. ``unanswered``: a user turn without an answer right after it. ``duplicate``:
    another row has the same conversation and turn. Neighbours are found by one join on both,
    so a long conversation is spread over many tasks and never gathered; rows come in no
    order.
    """
    def seen(shift: int, flag: str, rows: DataFrame) -> DataFrame:
        return rows.select("conv_id", (F.col("turn") + shift).alias("turn"), F.lit(flag).alias("flag"))

    role = F.col("role")
    marks = (
        seen(0, "own", turns)
        .unionByName(seen(1, "asked", turns.where(role == "user")))
        .unionByName(seen(-1, "answered", turns.where(role == "assistant")))
        .groupBy("conv_id", "turn")
        .agg(*[F.count_if(F.col("flag") == f).alias(f"_{f}") for f in ("own", "asked", "answered")])
    )
    return turns.join(marks, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("content"),
        F.coalesce((role == "assistant") & (F.col("_asked") > 0), F.lit(False)).alias("target"),
        F.coalesce((role == "user") & (F.col("_answered") == 0), F.lit(False)).alias("unanswered"),
        F.coalesce(F.col("_own") > 1, F.lit(False)).alias("duplicate"),
    )


def encode_pair(
    prompt: Column, output: Column, tokenizer_factory: Callable[[], Encode], max_length: int
) -> Column:
    """``struct(n_prompt, n_full, ids)``: token counts of the prompt and of prompt + output,
    and the first ``max_length`` ids of the latter. Whole texts are tokenized, each on its
    own, since tokens may span the border; the tokenizer is loaded once per task."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenize = tokenizer_factory()
        for prompts, outputs in batches:
            short = list(tokenize(prompts.tolist()))
            full = list(tokenize((prompts + outputs).tolist()))
            if len(short) != len(prompts) or len(full) != len(prompts):
                raise ValueError(f"the tokenizer gave {len(short)} and {len(full)} results for {len(prompts)} texts")
            yield pd.DataFrame(
                {
                    "n_prompt": [len(p) for p in short],
                    "n_full": [len(f) for f in full],
                    "ids": [list(f[:max_length]) for f in full],
                }
            )

    return F.pandas_udf(run, "n_prompt int, n_full int, ids array<int>")(prompt, output)


def sft_tokenize_mask(
    examples: DataFrame,
    tokenizer_factory: Callable[[], Encode],
    max_length: int = MAX_TOKENS,
    pad_id: int = 0,
) -> DataFrame:
    """``id, n_prompt, n_full, input_ids, attention_mask, labels, error``, arrays of fixed length.

    Prompt + output is cut or padded (on the right) to ``max_length``; labels repeat the ids
    with the prompt's positions set to -100. ``n_prompt`` and ``n_full`` are counts before
    the cut. Only the encoding runs in Python. An example without an output has NULLs and an
    ``error``, so that none goes missing unseen.
    """
    prompt = P.chat_text(F.col("messages"))
    output = F.coalesce("output", F.lit(""))
    tokens = encode_pair(prompt, output, tokenizer_factory, max_length)
    known = F.col("output").isNotNull()
    df = examples.select("id", known.alias("_known"), tokens.alias("_all")).select(
        "id", F.when(F.col("_known"), F.col("_all")).alias("_t"), "_known"
    )
    size = F.lit(max_length)
    used, masked = F.when(F.col("_known"), F.size("_t.ids")), F.least(F.col("_t.n_prompt"), size)
    df = df.select(
        "id",
        "_t.n_prompt",
        "_t.n_full",
        F.concat(F.col("_t.ids"), F.array_repeat(F.lit(pad_id), size - used)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), size - used)).alias(
            "attention_mask"
        ),
        masked.alias("_masked"),
        F.when(~F.col("_known"), NO_OUTPUT).alias("error"),
    )
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE_INDEX), F.col("_masked")),
        F.slice("input_ids", F.col("_masked") + 1, size - F.col("_masked")),
    )
    labels = F.when(F.col("error").isNull(), labels)
    return df.withColumn("labels", labels).select(
        "id", "n_prompt", "n_full", "input_ids", "attention_mask", "labels", "error"
    )


def sft_token_budget(tokenized: DataFrame, max_length: int = MAX_TOKENS) -> DataFrame:
    """How many examples are cut at ``max_length``, have nothing left to learn, or have no
    output; ``n`` counts those with one."""
    return tokenized.agg(
        F.count_if(F.col("error").isNull()).alias("n"),
        F.count_if(F.col("error").isNotNull()).alias("n_without_output"),
        F.count_if(F.col("n_full") > max_length).alias("n_truncated"),
        F.count_if(F.col("n_prompt") >= max_length).alias("n_fully_masked"),
        F.sum(F.least(F.col("n_full"), F.lit(max_length))).alias("tokens_kept"),
        F.sum("n_full").alias("tokens_total"),
    )
