"""Similarities of names and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; 100 for two empty names."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """The best ratio of the shared words and each side's words; 100 if one side's words are all the other's. 0 if either has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    best = ratio(one, two)
    if both:
        best = max(best, ratio(both, one), ratio(both, two))
    return best


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
