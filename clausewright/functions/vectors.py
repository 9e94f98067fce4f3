"""Vector functions over array columns, and the seam for embedding models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from clausewright.functions.text import let


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """A zero vector stays."""
    return let(norm(a), lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x / n)))


def hashed_words(text: Column, dims: int = 16) -> Column:
    """Counts of words by hash bucket: a plain stand-in for a model, not one."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims)
    return let(at, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda a: a == i))))


class Buckets(dict):
    """Hash buckets of the words met lately."""

    def __init__(self, dimensions: int, most: int = 50_000) -> None:
        self.dimensions, self.most = dimensions, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        b = self[word] = int(hashlib.md5(word).hexdigest()[:4], 16) % self.dimensions
        return b


class HashedWords:
    """Counts of words by hash bucket at length one, in steps of 2^-12 so that inner products are exact in any order: a plain stand-in for a model, not one."""

    def __init__(self, dimensions: int = 32) -> None:
        self.dimensions, self.fingerprint = dimensions, f"hashed-words-{dimensions}"
        self.bucket = Buckets(dimensions)

    def _counts(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()  # of bytes: at ASCII white space only
        return np.bincount(np.fromiter(map(self.bucket.__getitem__, words), np.int64, len(words)), minlength=self.dimensions)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        counts = np.stack([self._counts(t) for t in texts]).astype(np.float64)
        length = np.sqrt((counts**2).sum(axis=1))
        return (np.floor(counts / np.where(length > 0, length, 1.0)[:, None] * 4096 + 0.5) / 4096).tolist()


class Embedder(Protocol):
    """What a model must offer."""

    dimensions: int
    fingerprint: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_with(make: Callable[[], Embedder]):
    """An Arrow-batched function column; make() runs once a worker task."""

    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            found = model.embed(batch.fillna("").tolist())
            if any(len(v) != model.dimensions for v in found):
                raise ValueError("a vector has the wrong number of dimensions")
            yield pd.Series(found)

    return embed
