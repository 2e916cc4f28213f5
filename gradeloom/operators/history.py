"""Chat examples with as much history as fits: one per answer of a conversation.

Tokens are summed up along every conversation by a partitioned prefix scan, so each turn knows
where in its conversation it starts, in tokens. Conversations are then cut into cells of as
many tokens as the budget; a turn goes to its own cell and to the next one, and the history of
an answer is a range of token positions inside its cell. A cell holds at most two budgets of
tokens, whatever the length of the conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.functions import text as TX
from gradeloom.session import materialize

OVERHEAD = 4  # tokens that a chat template spends on a message

# texts -> token ids, one list per text
Encode = Callable[[Sequence[str]], Sequence[Sequence[int]]]


def token_count(content: Column, tokenizer_factory: Callable[[], Encode] | None = None) -> Column:
    """Tokens of a text: by the tokenizer, loaded once per task, or else its words."""
    if tokenizer_factory is None:
        return TX.word_count(F.coalesce(content, F.lit(""))).cast("bigint")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer_factory()
        for texts in batches:
            ids = list(encode(texts.fillna("").tolist()))
            if len(ids) != len(texts):
                raise ValueError(f"the tokenizer gave {len(ids)} results for {len(texts)} texts")
            yield pd.Series([len(x) for x in ids], dtype="int64")

    return F.pandas_udf(run, "bigint")(content)


def _running(group: int, amount: int):
    """Rows sorted by group, with ``part`` (the task) and ``start``: the amounts of the group
    before the row, as far as the task has seen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group).to_pylist()
            n = batch.column(amount).to_numpy()
            new = np.array([first or keys[0] != last, *[a != b for a, b in zip(keys[1:], keys)]])
            before = np.cumsum(n) - n
            begin = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            start = before - np.where(begin >= 0, before[begin], 0) + np.where(begin < 0, total, 0)
            last, total, first = keys[-1], int(start[-1] + n[-1]), False
            columns = [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(start)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "start"])

    return run


def running_start(df: DataFrame, group: str, order_by: Sequence[str], amount: str) -> DataFrame:
    """Add ``start``: the sum of ``amount`` (a BIGINT, not null) over the earlier rows of the group.

    A prefix scan: rows are range-partitioned and sorted once, every task sums up what it has,
    and the sums of a group's earlier tasks, at most one row per group and task, are
    joined on. A group may be of any size.
    """
    ordered = df.repartitionByRange(group, *order_by).sortWithinPartitions(group, *order_by)
    schema = StructType.fromDDL("part int, start bigint")
    schema = StructType([*df.schema.fields, *schema.fields])
    local = materialize(
        ordered.mapInArrow(_running(df.columns.index(group), df.columns.index(amount)), schema), "running"
    )
    sums = local.groupBy(F.col(group).alias("_g"), F.col("part").alias("_p")).agg(F.sum(amount).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_g", "_p", F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
    joined = local.join(
        materialize(offsets, "running-offsets"),
        F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")),
        "left",
    )
    start = F.col("start") + F.coalesce(F.col("_before"), F.lit(0))
    return joined.select(*df.columns, start.alias("start"))


def conversation_messages(
    turns: DataFrame,
    budget: int,
    overhead: int = OVERHEAD,
    tokenizer_factory: Callable[[], Encode] | None = None,
    target_role: str = "assistant",
) -> DataFrame:
    """One example per turn of ``target_role``: ``conv_id, turn, messages, n_tokens, output,
    answers``.

    ``messages`` (``array<struct<role, content>>``, in order) are the turns right before it, as
    many as fit into ``budget`` tokens; a turn costs ``overhead`` (at least 1) and its tokens.
    ``n_tokens`` is their cost, ``output`` the turn's own text, which does not count. The last
    message decides ``answers``: whether it is a user's. A turn that is longer than the budget
    ends every history it would belong to, so the answer right after it has no messages.

    Turns are taken by ``turn``, nulls first; rows of one turn by the MD5 of role and text, and
    each counts. A null text is an empty one.
    """
    if overhead < 1:
        raise ValueError("a turn must cost something")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    ).withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "content")))
    rows = rows.withColumn("cost", token_count(F.col("content"), tokenizer_factory) + overhead)
    placed = running_start(rows, "conv_id", ["turn", "tie"], "cost")
    own = F.floor(F.col("start") / F.lit(budget)).cast("bigint")
    # A turn may be history of answers in its own and in the next cell.
    cells = F.when(F.col("cost") <= budget, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.select(
        "conv_id", "turn", "role", "content", "cost", "start", own.alias("own"), F.explode(cells).alias("cell")
    )
    before = Window.partitionBy("conv_id", "cell").orderBy("start").rangeBetween(-budget, -1)
    message = F.struct("role", "content", "cost")
    target = F.col("role") == target_role
    seen = spread.withColumn("_kept", F.when(target, F.collect_list(message).over(before)))
    out = seen.where(target & (F.col("own") == F.col("cell")))
    return out.select(
        "conv_id",
        "turn",
        F.expr("transform(_kept, m -> struct(m.role AS role, m.content AS content))").alias("messages"),
        F.expr("aggregate(_kept, 0L, (s, m) -> s + m.cost)").alias("n_tokens"),
        F.col("content").alias("output"),
        F.coalesce(F.expr("try_element_at(_kept, -1).role") == "user", F.lit(False)).alias("answers"),
    )
