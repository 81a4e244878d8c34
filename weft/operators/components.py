"""Connected components by minimum propagation with contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import cut, drop


def propagate(edges: DataFrame, kept: list[str]) -> list[DataFrame]:
    """Minimum propagation on edges (u, v), either direction once at least; a list of (node, up) whose composition leads to the least vertex.

    Each round every vertex takes the least of itself and its neighbours, follows that pointer eight steps by doubling, and
    the edges are drawn again between the ends of the pointers. Ids are hashes, so that even a long chain shrinks to a third
    or less in a round; the loop ends when no edge is left, whatever the number of rounds.
    """
    steps: list[DataFrame] = []
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), kept)
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("up")), kept)
        for _ in range(3):
            up = up.select("node", F.col("up").alias("mid")).join(up.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up")
        up = cut(up, kept)
        steps.append(up)
        at = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))  # noqa: E731, B023
        drawn = edges.join(at("u"), "u").join(at("v"), "v").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        edges = cut(drawn.where("u < v").distinct(), kept)
    return steps


def composed(steps: list[DataFrame]) -> DataFrame | None:
    """(node, root) of the pointers of all rounds, from the last back; None without a round."""
    label = None
    for up in reversed(steps):
        if label is None:
            label = up.select("node", F.col("up").alias("root"))
        else:  # a pointer's end has a label from the later rounds, or was the least of its component
            later = label.select(F.col("node").alias("up"), "root")
            label = up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return label


def reachable(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, c): the component of every vertex (v) under edges (a, b) of strings, named by its least vertex; 64-bit hashes stand for them on the way."""
    kept: list[str] = []
    steps = propagate(edges.where("a is not null and b is not null").select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")), kept)
    roots = composed(steps)
    v = vertices.select("v").distinct().withColumn("h", F.xxhash64("v"))
    named = v.withColumn("root", F.col("h")) if roots is None else v.join(roots, F.col("h") == F.col("node"), "left").select("v", F.coalesce("root", "h").alias("root"))
    named = cut(named.select("v", "root"), kept)
    out = cut(named.join(named.groupBy("root").agg(F.min("v").alias("c")), "root").select("v", "c"))
    drop(edges.sparkSession, kept)
    return out
