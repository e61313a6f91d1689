"""Vector expressions, and a deterministic embedder for tests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column) -> Column:
    """The vector over its length; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Zero if either has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def binarized(v: Column) -> Column:
    """Sign bits in words of 32, the lowest bit first; a bit is set where the value is over zero."""
    word = lambda g: F.aggregate(
        F.transform(F.slice(v, g * 32 + 1, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x),
    )
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1), word)).otherwise(F.array().cast("array<bigint>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits over the words that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_words(a: Column, b: Column, words: int) -> Column:
    """The same for a known number of words: one sum, which stays in generated code."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))


def hash_vector(text: str, dims: int = 384) -> np.ndarray:
    """A unit vector made of SHA-256 digests of the text and a block number, read as signed 16-bit numbers."""
    blocks = -(-dims // 16)
    raw = b"".join(hashlib.sha256(f"{text}::{i}".encode()).digest() for i in range(blocks))
    v = np.frombuffer(raw, "<i2")[:dims] / 32768
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def hash_embedding(dims: int = 384):
    """The embedder as a vectorised function of a text column."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: hash_vector(t, dims).tolist())

    return embed


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token states that the mask keeps, as unit vectors; without kept tokens the sum is over all of them."""
    kept = mask.sum(axis=1, keepdims=True)
    total = (states * mask[:, :, None]).sum(axis=1) / np.where(kept > 0, kept, states.shape[1])
    n = np.linalg.norm(total, axis=1, keepdims=True)
    return total / np.where(n > 0, n, 1)


def embed_config(device: str, cores: int, memory_gb: int) -> tuple[int, int]:
    """Batch size and number of workers for a device. The ladder."""
    steps = ((16, 16), (8, 12)) if device == "webgpu" else ((8, 6), (4, 4))
    if device != "webgpu" and cores >= 12 and memory_gb >= 8:
        return 8, 2
    for size, batch in steps:
        if max(cores, memory_gb) >= size:
            return batch, 1
    return (8 if device == "webgpu" else 2), 1
