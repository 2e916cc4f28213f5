"""Chat messages for judging, inference, fine-tuning and rewriting.

Templates are rendered once, when the plan is built; per row only the text is joined on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import strip
from gradeloom.settings import CRITERIA

# Prompt wording. Indentation and the blank lines are part of the text; the
# judge's wording differs from the other in its outer white space and one padded blank line.
_OPENING = (
    "You are an expert speech evaluator. Given a transcript of a speaker's message, assess "
    "the communication quality in terms of the following traits:"
)
_SCALE = (
    "For each trait, assign a score from 1 (poor) to 10 (excellent). Be honest and critical "
    "in your assessment without bias toward high scores. "
)
_EXPLAIN = (
    "Then provide a short explanation (1–2 sentences) justifying your score for that trait."
)
_FORMAT = "The final output must be a JSON string with the exact format below:"
REWRITE_SYSTEM = (
    "You are an assistant with a persona who rewrites reference sample for training a "
    "communication evaluation model. Do not include any introductory phrases or openings; "
    "start directly with the main content."
)
_REWRITE_OPENING = "You are given a reference article-style sample."
_REWRITE_ONLY = "Only output the transcript content."
_REWRITE_SAMPLE = "### Reference Sample:"
PERSONAS = {
    "formality": (
        "Imitate a casual blogger who uses informal language, contractions, or slang "
        "inappropriately in a serious context, rewrite the sample in a way that "
        "**lacks formality**."
    ),
    "persuasiveness": (
        "Imitate a passive commentator who avoids strong arguments and fails to support "
        "claims with logic or evidence, rewrite the sample in a way that "
        "**lacks persuasiveness**."
    ),
    "transition logic": (
        "Imitate a disorganized writer who jumps between ideas without smooth transitions or "
        "coherent flow, rewrite the sample in a way that **lacks clear transition logic**."
    ),
    "filler words": (
        "Imitate a writer who uses redundant connectors, rewrite the sample in a way that "
        "**includes filler words rarely but surely**."
    ),
}
_PADDED_BLANK = {"transition logic": " "}  # this persona's first blank line holds one space


def criteria_format(criteria: Sequence[str]) -> str:
    """The answer format, as the text of a Python dict."""
    return str({c: {"score": "<int>", "feedback": "<string>"} for c in criteria})


def _instruction_lines(criteria: Sequence[str]) -> list[str]:
    body = [_OPENING, str(list(criteria)), "", _SCALE, _EXPLAIN, "", _FORMAT]
    body.append(criteria_format(criteria))
    return [line if line == "" else "    " + line for line in body]


def instruction(criteria: Sequence[str] = CRITERIA) -> str:
    """System text for inference and fine-tuning, without outer white space."""
    return "\n".join(_instruction_lines(criteria)).strip()


def judge_instruction(criteria: Sequence[str] = CRITERIA) -> str:
    """System text for the judge. Its second blank line is four spaces; the text keeps
    its outer line breaks and indentation."""
    lines = _instruction_lines(criteria)
    lines[5] = "    "
    return "\n" + "\n".join(lines) + "\n    "


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(text: Column, criteria: Sequence[str] = CRITERIA) -> Column:
    """system + user messages for inference and fine-tuning."""
    return F.array(
        _message("system", F.lit(instruction(criteria))),
        _message("user", F.concat(F.lit("Transcript:\n"), text)),
    )


def judge_messages(text: Column, criteria: Sequence[str] = CRITERIA) -> Column:
    """system + user messages for the judge."""
    return F.array(
        _message("system", F.lit(judge_instruction(criteria))),
        _message("user", F.concat(F.lit("\n    Transcript:\n    "), text, F.lit("\n    "))),
    )


def _rewrite_prefix(trait: str) -> str:
    pad = " " * 16
    blank = _PADDED_BLANK.get(trait, "")
    lines = [pad + PERSONAS[trait], "", pad + _REWRITE_ONLY, "", pad + _REWRITE_SAMPLE, pad]
    return "\n".join([_REWRITE_OPENING, blank, *lines])


def rewrite_prompt(trait: Column, text: Column) -> Column:
    """The user text that asks for a rewrite of ``text`` lacking ``trait``; NULL for a
    trait without a persona."""
    prefix = F.lit(None).cast("string")
    for name in PERSONAS:
        prefix = F.when(trait == name, _rewrite_prefix(name)).otherwise(prefix)
    return strip(F.concat(prefix, strip(text)))


def rewrite_messages(trait: Column, text: Column) -> Column:
    return F.array(
        _message("system", F.lit(REWRITE_SYSTEM)), _message("user", rewrite_prompt(trait, text))
    )


def completion(ids: Column, prompt_len: Column) -> Column:
    """Generated token ids without the prompt's own."""
    return F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))


def chat_text(messages: Column) -> Column:
    """The messages as one ChatML text that ends where the answer starts."""
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")
        ),
    )
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))
