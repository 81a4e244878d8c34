"""Model calls behind one interface, and deterministic stand-ins that need no network. Results of stand-ins say nothing of a model's quality."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Texts to unit vectors.
Encoder = Callable[[list[str]], np.ndarray]
#: (question, passage) pairs to scores.
Reranker = Callable[[list[tuple[str, str]]], list[float]]
#: Prompts to answers.
Generator = Callable[[list[str]], list[str]]


def hashed_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """Character trigrams hashed to signed places, as unit vectors; a text without any has zeros."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        x = f" {t.lower()} "
        for k in range(len(x) - 2):
            h = int.from_bytes(hashlib.blake2b(x[k : k + 3].encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def overlap_reranker(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of the question's words that the passage has."""
    out = []
    for q, p in pairs:
        w = set(q.lower().split())
        out.append(len(w & set(p.lower().split())) / len(w) if w else 0.0)
    return out


def echo_generator(prompts: list[str]) -> list[str]:
    return ["unknown" for _ in prompts]


def embed(rows: DataFrame, text: str, into: str, encoder: Encoder = hashed_encoder, prefix: str = "") -> DataFrame:
    """Adds the vector of a text column, null for a null text; one call of the encoder for each Arrow batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            got = encoder([prefix + (t or "") for t in x])
            yield pd.Series([v.tolist() if t is not None else None for v, t in zip(got, x)], dtype=object)

    return rows.withColumn(into, run(text))


def rerank(rows: DataFrame, question: str, passage: str, into: str, reranker: Reranker = overlap_reranker) -> DataFrame:
    """Adds the score of each (question, passage) pair."""

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(reranker([(a or "", b or "") for a, b in zip(q, p)]), dtype="float64")

    return rows.withColumn(into, run(question, passage))


def generate(rows: DataFrame, prompt: str, into: str, generator: Generator = echo_generator) -> DataFrame:
    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(generator([x or "" for x in p]))

    return rows.withColumn(into, run(prompt))
