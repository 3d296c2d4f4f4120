"""Vector expressions and the deterministic embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from confab.functions.text import tokenise


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null or all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hash_vectors(texts: list[str | None], dim: int = 64) -> np.ndarray:
    """Signed feature hashing of the tokens of many texts, rows of unit length; a text without tokens points along the
    diagonal. A token's place is its MD5 modulo the dimension, its sign bit 8. Every distinct token is hashed once."""
    lists = [tokenise(t) for t in texts]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    known, which = np.unique(np.array([t for x in lists for t in x], dtype=object).astype(str), return_inverse=True)
    numbers = [int(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest(), 16) for t in known.tolist()]
    place = np.array([n % dim for n in numbers], dtype=np.int64)
    sign = np.array([(n >> 8) % 2 for n in numbers], dtype=np.int64) * 2 - 1
    sums = np.bincount(row * dim + place[which], weights=sign[which], minlength=len(lists) * dim).reshape(len(lists), dim) if len(row) else np.zeros((len(lists), dim))
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.where(norm > 0, sums / np.where(norm > 0, norm, 1), dim**-0.5).astype(np.float32)


def hash_embedding(text: Column, prefix: str = "", dim: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors([prefix + t if isinstance(t, str) else None for t in texts], dim)), index=texts.index)

    return embed(text)
