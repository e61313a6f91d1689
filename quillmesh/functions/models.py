"""Language models as a boundary: anything that completes a prompt, called once for a batch of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmesh.functions.vectors import hash_vector


class LlmClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class StubClient:
    """A deterministic stand-in: the first reply whose key occurs in the prompt, or an empty one."""

    def __init__(self, replies: dict[str, str] | None = None):
        self.replies = replies or {}

    def complete(self, prompt: str) -> str:
        return next((v for k, v in self.replies.items() if k in prompt), "")


def completion(make: Callable[[], LlmClient]):
    """A column function; a client is made once for each task, and a failing call gives null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()

        def one(prompt):
            try:
                return client.complete(prompt or "")
            except Exception:
                return None

        for prompts in batches:
            yield prompts.map(one)

    return run


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """The deterministic stand-in: vectors made of digests of the texts."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([hash_vector(t, self.dims) for t in texts])


def embedding(make: Callable[[], Embedder], batch: int = 8):
    """A column function of texts; a model is loaded once for each task and called for ``batch`` texts at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            rows = texts.fillna("").tolist()
            yield pd.Series([v.tolist() for at in range(0, len(rows), batch) for v in model.embed(rows[at : at + batch])], dtype=object)

    return run


def estimated_tokens(text):
    """A quarter of the characters, rounded."""
    return F.round(F.length(text) / 4).cast("long")
