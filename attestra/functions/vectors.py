"""Vectors as arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; null where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, 1 - dot(a, b) / length)


def hashed(dimensions: int = 384) -> Callable[[str | None], np.ndarray]:
    """A function of a text: signed token hashing, normalised to length 1; empty texts give zeros."""
    seen: dict[str, tuple[int, float]] = {}

    def embed(text: str | None) -> np.ndarray:
        vector = np.zeros(dimensions)
        for token in (text or "").lower().split():
            if token not in seen:
                digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
                seen[token] = int.from_bytes(digest[:4], "big") % dimensions, 1.0 if digest[4] % 2 == 0 else -1.0
            at, sign = seen[token]
            vector[at] += sign
        if len(seen) > 1 << 18:
            seen.clear()
        length = np.linalg.norm(vector)
        return (vector / length if length else vector).astype(np.float32)

    return embed


def hashing_embedder(dimensions: int = 384):
    """The same as a column function.

    blake2b has no Spark function, hence the pandas UDF.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = hashed(dimensions)
        for batch in texts:
            yield pd.Series([one(text) for text in batch])

    return embed


def rounded(values: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as Spark's round does: halves of the shortest decimal go up."""
    scaled = values * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def nearest_texts(queries: list[np.ndarray], k: int, many: int = 2048):
    """A column function of an array of texts: for each query the places of the k nearest by :func:`cosine_distance` of hashed tokens (six digits), ties by place.

    Products are added in the order of the dimensions, as cosine_distance does.
    """

    def distances(vectors: np.ndarray) -> list[np.ndarray]:
        by_dimension = np.ascontiguousarray(vectors.T, np.float64)
        square = np.zeros(len(vectors))
        for row in by_dimension:
            square += row * row
        out = []
        for q in queries:
            own, dot, q_square = np.asarray(q, np.float32).astype(np.float64), np.zeros(len(vectors)), 0.0
            for d in np.flatnonzero(own):
                dot += own[d] * by_dimension[d]
                q_square += own[d] * own[d]
            length = np.sqrt(q_square) * np.sqrt(square)
            there = length > 0
            out.append(np.where(there, rounded(1 - dot / np.where(there, length, 1)), np.inf))
        return out

    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = hashed()
        for batch in batches:
            texts, sizes = batch.flatten(), batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            parts = [distances(np.stack([embed(t.as_py()) for t in texts[a : a + many]])) for a in range(0, len(texts), many)]
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            places, lists, rows, at = [], [0], [0], 0
            for n in sizes.tolist():
                for d in found:
                    own = d[at : at + n]
                    order = np.argsort(own, kind="stable")[:k]
                    places.append(order[np.isfinite(own[order])])
                    lists.append(lists[-1] + len(places[-1]))
                rows.append(len(lists) - 1)
                at += n
            flat = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(flat))
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)

    return F.arrow_udf(near, "array<array<int>>").asNondeterministic()  # neither repeated nor moved
