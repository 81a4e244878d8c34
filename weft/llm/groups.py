"""Problem 2: one group for all records linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import words
from weft.operators.components import composed, propagate
from weft.sources.tables import cut, drop, table

#: A frontier of so many vertices at most (8 bytes each) is broadcast; a larger one is joined by a shuffle.
SMALL_FRONTIER = 100_000
#: The search from the hub ends when a level adds less than this share of what it has reached: the rest is a thin tail, left to the propagation.
TAIL = 0.02


def peel(edges: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Of both-way edges (u, v): what a breadth-first search from the vertex of the highest degree reaches, as (node, root), and the other edges.

    The root is the least vertex reached. If the search was ended at a thin tail, the edges from the reached part into
    the rest stay, with the root in place of their reached ends, so that no link is lost.
    """
    spark = edges.sparkSession
    hub = edges.groupBy("u").count().orderBy(F.desc("count"), "u").first()
    if hub is None:
        return None
    layers = [spark.createDataFrame([(hub.u,)], "node long")]
    reached, total, least = layers[0], 1, hub.u
    while True:
        front = layers[-1]
        side = F.broadcast(front) if total == 1 or size <= SMALL_FRONTIER else front  # noqa: F821
        new = edges.join(side.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).distinct()
        # a neighbour of a level is in it, in the one before or new
        new = cut(new.join(layers[-1].union(layers[-2]) if len(layers) > 1 else layers[-1], "node", "left_anti"), kept)
        size, low = new.agg(F.count("*"), F.min("node")).first()
        if not size:
            break
        layers.append(new)
        reached, total, least = reached.union(new), total + size, min(least, low)
        if size < TAIL * total:
            break
    inside = cut(reached.select("node", F.lit(least).alias("root")), kept)
    mark = lambda e, c: e.join(inside.select(F.col("node").alias(c), F.lit(1).alias(f"in_{c}")), c, "left")
    outside = mark(edges.join(inside.select(F.col("node").alias("u")), "u", "left_anti"), "v")
    return inside, outside.select("u", F.when(F.col("in_v") == 1, F.lit(least)).otherwise(F.col("v")).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the undirected edges (u, v), bigint; root is one vertex of the component, the same for all its vertices.

    Null ends and loops link nothing. Empty input gives no rows.
    """
    kept: list[str] = []
    one = edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = cut(one.union(one.select("v", "u")), kept)
    peeled = peel(both, kept)
    if peeled is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("root"))
    inside, rest = peeled
    steps = propagate(rest, kept)
    label = composed(steps)
    if label is None:
        out = inside
    else:
        # the peeled part follows its root, which a tail edge may have led further
        of_root = F.broadcast(inside.agg(F.min("root").alias("node")).join(label, "node", "left").select("node", "root"))
        out = inside.join(of_root.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        out = out.union(label.join(inside.select("node"), "node", "left_anti"))
    out = cut(out)
    drop(edges.sparkSession, kept)
    return out


def grouped(links: DataFrame) -> DataFrame:
    """(mention, group_id): group_id is the least name of all that (a, b) link directly or indirectly.

    Numbers stand for the long ids on the way; two ids that share their 64-bit hash would be taken for one.
    """
    numbered = links.where("a is not null and b is not null and a != b").select("a", "b").distinct()
    roots = components(numbered.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")))
    names = numbered.select(F.explode(F.array("a", "b")).alias("mention")).distinct()
    named = cut(names.join(roots, F.xxhash64("mention") == F.col("node")).select("mention", "root"))
    least = named.groupBy("root").agg(F.min("mention").alias("group_id"))
    return named.join(least, "root").select("mention", "group_id")


def same_links(decisions: DataFrame) -> DataFrame:
    """Rows whose verdict is the word same, however written."""
    return decisions.where(words(F.col("verdict")) == F.array(F.lit("same"))).select("a", "b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(same_links(table(spark, sf_dir, "pilot_decisions")))


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": """
        with recursive link as (
            select a, b from pilot_decisions
            where regexp_extract_all(lower(verdict), '[\\p{L}\\p{N}]+') = ['same'] and a is not null and b is not null and a <> b),
        e as (select a, b from link union select b, a from link),
        r as (select a, b as c from e union select r.a, e.b from r join e on r.c = e.a)
        select a as mention, min(c) as group_id from (select a, c from r union select a, a from r) group by a""",
}
