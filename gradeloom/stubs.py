"""Deterministic stand-ins for models, clients, tokenizers and encoders.

They let every inference operator run, and be checked, where no model is available.
"""

from __future__ import annotations

import numpy as np


def judge_client():
    """Scores a transcript by its length; refuses one in seven."""

    def call(system: str, user: str) -> str:
        if len(user) % 7 == 0:
            raise ValueError("refused")
        return '```json\n{"n": %d}\n```' % (1 + len(user) % 10)

    return call


def rewrite_client():
    def call(system: str, user: str) -> str:
        return f"  rewritten from {len(user)} characters\n"

    return call


def fussy_rewrite_client():
    """Refuses one prompt in thirteen, by its length."""
    rewrite = rewrite_client()

    def call(system: str, user: str) -> str:
        if len(user) % 13 == 0:
            raise ValueError("refused")
        return rewrite(system, user)

    return call


class LengthModel:
    """A picklable model factory: answers with its name and the prompt's length."""

    def __init__(self, name: str = "base"):
        self.name = name

    def __call__(self):
        return lambda texts: [f"{self.name}: {len(t)}" for t in texts]


def word_length_tokenizer():
    """White-space tokens; a token's id is its number of characters."""
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def letter_encoder():
    """A vector of three numbers per word, by its first character: texts have few different
    ones, and any engine can state them."""

    def encode(texts):
        out = []
        for t in texts:
            first = np.array([ord(w[0].lower()) for w in t.split()])
            out.append(np.stack([np.ones(len(first)), first % 5, first % 7], 1) if len(first) else np.empty((0, 3)))
        return out

    return encode
