"""Text encoders: ``encode(df, key, text) -> (key, vector)`` with L2-normalised vectors.

All are row-local, so encoding never shuffles the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind
from ..functions.text import words
from ..functions.vectors import dense, l2_normalize


class Encoder(Protocol):
    def encode(self, df: DataFrame, key: str, text: Column, out: str) -> DataFrame:
        """``df``'s key and the vector of ``text``."""


def hashed_counts(text: Column, dim: int) -> Column:
    """The hash buckets below ``dim`` that words of the text fall into, ascending, and how many fall into each.

    A struct ``(at, n)``; each word is hashed once, and a bucket's count is the length of its run in the sorted buckets.
    Null counts as empty.
    """
    buckets = F.transform(
        F.coalesce(words(text), F.array().cast("array<string>")),
        lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int") % dim).cast("int"),
    )

    def runs(b: Column) -> Column:
        ends = F.array_compact(F.transform(b, lambda x, i: F.when(F.coalesce(F.get(b, i + 1) != x, F.lit(True)), i)))
        return bind(
            ends,
            lambda e: F.struct(
                F.transform(e, lambda i: F.get(b, i)).alias("at"),
                F.transform(e, lambda i, k: i - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("n"),
            ),
        )

    return bind(F.sort_array(buckets), runs)


class HashEncoder:
    """Hashed bag of words; needs no model and can be checked in SQL."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, df: DataFrame, key: str, text: Column, out: str) -> DataFrame:
        def vector(c: Column) -> Column:
            return dense(c["at"], l2_normalize(c["n"]), self.dim)

        return df.select(key, bind(hashed_counts(text, self.dim), vector).alias(out))


class JoinEncoder:
    """Vectors computed elsewhere, looked up by key. Rows without a vector drop out."""

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        self.vectors = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))

    def encode(self, df: DataFrame, key: str, text: Column, out: str) -> DataFrame:
        found = df.select(key).join(self.vectors, F.col(key) == F.col("_key"))
        return found.select(key, l2_normalize(F.col("_vector")).alias(out))


class ModelEncoder:
    """A user's model. ``load()`` runs once per task and returns ``texts -> float matrix``."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.load = load

    def encode(self, df: DataFrame, key: str, text: Column, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                matrix = np.asarray(model(texts.tolist()), dtype=np.float64)
                norms = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
                yield pd.Series(list(matrix / norms))

        return df.select(key, embed(text).alias(out))


def encode_new(df: DataFrame, done: DataFrame, encoder: Encoder, key: str, text: Column, out: str) -> DataFrame:
    """Vectors of ``done`` plus those of the rows it lacks (matched by key, not by position)."""
    fresh = encoder.encode(df.join(done.select(key), key, "left_anti"), key, text, out)
    return done.select(key, out).unionByName(fresh)
