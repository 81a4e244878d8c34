"""Problem 7: token ids by a public tokenizer, built up over a tree of text halves."""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from weft.sources.tables import table

#: Texts of so many characters at most are leaves of the tree. It changes no id, only the work of a leaf.
LEAF = 4096
#: Characters on either side of a joint that the first window has.
WINDOW = 64


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file; $TOKENIZERS_DIR names another folder."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


class Piece:
    """An element of the monoid: a text with its ids and the character at which each token begins. The empty text is the identity.

    A token that starts inside a character of several bytes has that character's place.
    """

    __slots__ = ("text", "ids", "starts")

    def __init__(self, text: str, ids: list[int], starts: list[int]):
        self.text, self.ids, self.starts = text, ids, starts


def leaves(texts: list[str], path: str) -> list[Piece]:
    got = tokenizer(path).encode_batch(texts, add_special_tokens=False)
    return [Piece(t, e.ids, [a for a, _ in e.offsets]) for t, e in zip(texts, got)]


def stable(text: str, i: int) -> bool:
    """A letter followed by white space: the pre-tokenizer's pattern ends a match exactly there, whatever stands before or after, and
    merges never cross it. Encoding the two sides on their own gives the ids of the whole."""
    return 0 < i < len(text) and text[i - 1].isascii() and text[i - 1].isalpha() and text[i] in " \n\t"


def joined(a: Piece, b: Piece, path: str) -> Piece:
    """a + b: the window around the joint is encoded again, widened until it begins and ends at stable places, or with the text."""
    if not a.text or not b.text:
        return a if a.text else b
    whole, m = a.text + b.text, len(a.text)
    lo, hi, w = m, m, WINDOW
    while True:
        lo = next((i for i in range(max(m - w, 1), m) if stable(a.text, i)), 0 if w >= m else None)
        hi = next((i for i in range(min(m + w, len(whole) - 1), m, -1) if stable(whole, i) and i > m), len(whole) if w >= len(b.text) else None)
        if lo is not None and hi is not None:
            break
        w *= 2
    mid = leaves([whole[lo:hi]], path)[0]
    left, right = bisect_left(a.starts, lo), bisect_left(b.starts, hi - m)
    return Piece(
        whole,
        a.ids[:left] + mid.ids + b.ids[right:],
        a.starts[:left] + [s + lo for s in mid.starts] + [s + m for s in b.starts[right:]],
    )


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of a text, left to right: it is halved until the parts have leaf characters at most."""
    if len(text) <= leaf:
        return [text]
    m = len(text) // 2
    return halves(text[:m], leaf) + halves(text[m:], leaf)


def reduced(pieces: list[Piece], path: str) -> Piece:
    """The sum of neighbours, pairwise, level by level."""
    while len(pieces) > 1:
        pieces = [joined(pieces[i], pieces[i + 1], path) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def encoded(texts: list[str | None], path: str, leaf: int = LEAF) -> list[list[int]]:
    """The ids of each text; [] for an empty and for a null one."""
    parts = [halves(t, leaf) if isinstance(t, str) and t else [] for t in texts]
    flat = leaves([p for ps in parts for p in ps], path)
    out, at = [], 0
    for ps in parts:
        out.append(reduced(flat[at : at + len(ps)], path).ids if ps else [])
        at += len(ps)
    return out


def decoded(ids: list[int], path: str) -> str:
    """The text of ids, concatenated up the same tree; the bytes of a character that two halves share are joined before they are read."""
    t = tokenizer(path)
    table_ = byte_table()

    def bytes_of(lo: int, hi: int) -> bytes:
        if hi - lo <= 512:
            return b"".join(bytes(table_[c] for c in t.id_to_token(i)) for i in ids[lo:hi])
        m = (lo + hi) // 2
        return bytes_of(lo, m) + bytes_of(m, hi)

    return bytes_of(0, len(ids)).decode("utf-8", "replace")


@cache
def byte_table() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_ids(text: Column, path: str | None = None, leaf: int = LEAF) -> Column:
    """The ids of a text column: [] for empty and null texts. One Arrow batch at a time, the vocabulary read once per worker."""
    path = path or vocabulary()

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            got: list[list[int]] = []
            for i in range(0, len(x), 64):
                got += encoded(x.iloc[i : i + 64].tolist(), path, leaf)
            yield pd.Series(got, dtype=object)

    return run(text)


def token_text(ids: Column, path: str | None = None) -> Column:
    """The text of an id column; null for null."""
    path = path or vocabulary()

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([None if i is None else decoded([int(k) for k in i], path) for i in x], dtype=object)

    return run(ids)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, tokens, differing): differing counts texts that decoding does not give back; 0 is right."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), token_ids(F.col("text")).alias("ids"))
    back = docs.select("text", F.size("ids").alias("n"), token_text(F.col("ids")).alias("again"))
    return back.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count(F.when(F.col("text") != F.col("again"), 1)).alias("differing"))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
SQL: dict[str, str] = {}
