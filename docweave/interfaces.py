"""What a user may plug in: encoders, counters, scorers, sinks, searchers and language models, with offline defaults."""

from __future__ import annotations

import itertools
import zlib
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class Encoder(Protocol):
    """Texts to vectors of one size and length 1."""

    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@runtime_checkable
class TokenCounter(Protocol):
    def __call__(self, text: str) -> int: ...


@runtime_checkable
class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


@runtime_checkable
class PointSink(Protocol):
    def ensure(self, vector_size: int) -> None: ...

    def write(self, points: DataFrame) -> None: ...


@runtime_checkable
class WebSearcher(Protocol):
    def search(self, query: str, max_results: int) -> list[dict]: ...


@runtime_checkable
class Llm(Protocol):
    def json(self, prompt: str) -> dict: ...

    def text(self, prompt: str) -> str: ...


class HashedWords:
    """The offline encoder: words hashed to signed places, normalised. No model, the same everywhere."""

    def __init__(self, size: int = 256):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [(t or "").lower().split() for t in texts]
        place = {w: 2 * ((h := zlib.crc32(w.encode())) % self.size) + (h >> 31) for w in set(itertools.chain.from_iterable(words))}
        at = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        own = np.repeat(np.arange(len(texts), dtype=np.int64) * self.size, [len(w) for w in words])
        out = np.bincount(own + (at >> 1), 2.0 * (at & 1) - 1, len(texts) * self.size).reshape(len(texts), self.size).astype(np.float32)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def encoded(text: Column, encoder: Encoder | None = None) -> Column:
    """A column of vectors; the encoder is shipped once a task and sees Arrow batches."""
    model = encoder or HashedWords()

    @F.pandas_udf("array<float>")
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series(list(model.encode(s.fillna("").tolist())))

    return encode(text)


def scored(query: Column, text: Column, scorer: PairScorer) -> Column:
    """Scores of pairs by an injected scorer, in Arrow batches."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(list(zip(q.fillna(""), t.fillna("")))), dtype="float64")

    return score(query, text)


class ParquetSink:
    """The default sink: a Parquet table of points."""

    def __init__(self, path: str):
        self.path, self.size = path, None

    def ensure(self, vector_size: int) -> None:
        self.size = vector_size

    def write(self, points: DataFrame) -> None:
        from docweave.sources.artifacts import checked_points

        checked_points(points, self.size).dropDuplicates(["id"]).write.mode("append").parquet(self.path)


def domain_query(query: str, domains: list[str] | None) -> str:
    """The query narrowed to sites; blank domains count for nothing."""
    clean = [d.strip() for d in domains or [] if d and d.strip()]
    return f"({' OR '.join(f'site:{d}' for d in clean)}) {query}" if clean else query


def result_limit(n: int) -> int:
    return max(1, min(10, n))
