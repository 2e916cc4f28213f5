"""Batch inference by an engine that is kept busy: batches under a token budget, prepared ahead.

Prompts reach a task in Arrow batches. A thread takes the next ones from Spark, which renders
prompts on its side of the pipe, counts their tokens and packs them by length into batches
that cost at most a budget of tokens with padding; the model runs meanwhile. A bounded queue
lies between the two, so no more than a few batches wait. Answers go back to the order of
the prompts.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.functions import prompts as P
from gradeloom.operators.infer import Model
from gradeloom.settings import CRITERIA

TOKEN_BUDGET = 16384
MAX_BATCH = 128
AHEAD = 2  # Arrow batches that may wait

# texts -> number of tokens of each
Count = Callable[[Sequence[str]], Sequence[int]]


def characters():
    """A count for models without a tokenizer: a token per four characters, and one."""
    return lambda texts: [len(t) // 4 + 1 for t in texts]


def pack(costs: Sequence[int], token_budget: int, max_batch: int) -> list[list[int]]:
    """Positions in batches, the longest first.

    A batch is as wide as its longest prompt, so its cost is that times its prompts: at most
    ``token_budget``, unless a single prompt is longer by itself, which goes alone.
    """
    batches: list[list[int]] = []
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        own = batches[-1] if batches else None
        if own and len(own) < max_batch and costs[own[0]] * (len(own) + 1) <= token_budget:
            own.append(i)
        else:
            batches.append([i])
    return batches


def ahead(source: Iterator, depth: int = AHEAD) -> Iterator:
    """The items of ``source``, taken by a thread that is at most ``depth`` items ahead.

    An error in the source is raised here, after the items before it. When the reader stops
    early the thread stops at its next item.
    """
    waiting: queue.Queue = queue.Queue(depth)
    stopped = threading.Event()

    def offer(what) -> bool:
        while not stopped.is_set():
            try:
                waiting.put(what, timeout=0.1)
                return True
            except queue.Full:
                pass
        return False

    def work() -> None:
        try:
            for item in source:
                if not offer((item, None)):
                    return
            offer((None, StopIteration()))
        except BaseException as e:  # noqa: BLE001  goes to the reader
            offer((None, e))

    thread = threading.Thread(target=work, daemon=True, name="prepare-batches")
    thread.start()
    try:
        while True:
            item, error = waiting.get()
            if isinstance(error, StopIteration):
                return
            if error is not None:
                raise error
            yield item
    finally:
        stopped.set()
        thread.join(timeout=2)  # a read that waits for Spark ends with the worker


def _answers(model: Model, prompts: list[str], batches: list[list[int]]) -> tuple[list, list]:
    """Answer and error per prompt, in the order of the prompts."""
    answers: list = [None] * len(prompts)
    errors: list = [None] * len(prompts)
    for own in batches:
        try:
            got = list(model([prompts[i] for i in own]))
            if len(got) != len(own):
                raise ValueError(f"{len(got)} answers for {len(own)} prompts")
            for i, a in zip(own, got):
                answers[i] = a
        except Exception as e:
            for i in own:
                errors[i] = f"{type(e).__name__}: {e}"
    return answers, errors


def generate_rows(
    df: DataFrame,
    prompt: str,
    model_factory: Callable[[], Model],
    token_budget: int = TOKEN_BUDGET,
    max_batch: int = MAX_BATCH,
    count_factory: Callable[[], Count] = characters,
    overlap: int = AHEAD,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``df`` without its column ``prompt``, with ``answer`` and ``error`` per row.

    ``profile`` gives this stage its own executors, such as ones with a GPU; the rest of the
    job keeps the usual ones. With ``overlap=0`` batches are prepared between model runs. An
    error of the model is one of its batch; an error of the token count fails the task.
    """
    place = df.columns.index(prompt)
    kept = [i for i, c in enumerate(df.columns) if c != prompt]
    schema = StructType([df.schema[i] for i in kept]).add("answer", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, count = model_factory(), count_factory()

        def prepared() -> Iterator[tuple[pa.RecordBatch, list[str], list[list[int]]]]:
            for batch in batches:
                prompts = [p or "" for p in batch.column(place).to_pylist()]
                costs = list(count(prompts)) if prompts else []
                if len(costs) != len(prompts):
                    raise ValueError(f"{len(costs)} counts for {len(prompts)} prompts")
                yield batch, prompts, pack(costs, token_budget, max_batch)

        for batch, prompts, packed in ahead(prepared(), overlap) if overlap else prepared():
            answers, errors = _answers(model, prompts, packed)
            columns = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], schema.names
            )

    return df.mapInArrow(run, schema, profile=profile)


def engine_infer(
    df: DataFrame,
    model_factory: Callable[[], Model],
    criteria: Sequence[str] = CRITERIA,
    token_budget: int = TOKEN_BUDGET,
    max_batch: int = MAX_BATCH,
    count_factory: Callable[[], Count] = characters,
    overlap: int = AHEAD,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``id, text, label, error`` for every row of ``df(id, text)``, as ``batch_infer``."""
    prompt = P.chat_text(P.prompt_messages(F.col("text"), criteria))
    rows = df.select("id", "text", prompt.alias("_prompt"))
    out = generate_rows(
        rows, "_prompt", model_factory, token_budget, max_batch, count_factory, overlap, profile
    )
    return out.select("id", "text", F.col("answer").alias("label"), "error")
