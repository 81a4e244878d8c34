"""Problem 5: the top N items of every group, by one global sort and prefix-summed positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weft.sources.tables import table


def scored(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def positions(groups: list[str], item: str, n: str):
    """Of a sorted partition: the items that stand among the first n of their group within it, with that place;
    and, for the group still open at its end, one row without place that says how many items it had here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for b in batches:
            if not len(b):
                continue
            keys = list(zip(*(b[g] for g in groups)))
            new = np.fromiter((x != y for x, y in zip(keys, [last, *keys])), bool, len(keys))
            at = np.arange(len(keys))
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start, at + seen) + 1
            last, seen = keys[-1], int(place[-1])
            b = b.assign(place=place, held=0, part=part)
            yield b.loc[place <= b[n], [*groups, item, n, "place", "held", "part"]]
        if last is not None:
            yield pd.DataFrame([[*last, None, 0, 0, seen, part]], columns=[*groups, item, n, "place", "held", "part"])

    return run


def top_n(rows: DataFrame, groups: list[str], score: str, item: str, n: str) -> DataFrame:
    """(groups, item, place): the n highest-scoring items of each group, equal scores by item, ascending.

    rows has one row per group and item at most, scores neither null nor NaN; n is a column, constant in a group. A null group is
    a group, a null item comes first among equals. Rows are range-partitioned on group, score and item, so that a group of any
    size is spread over as many tasks as it needs; only its first n rows of each partition and one count per partition go on.
    Those counts, summed up over the partitions before, turn places into exact positions. Empty input gives no rows.
    """
    spark = rows.sparkSession
    order = [*map(F.col, groups), F.desc(score), F.asc(item)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = {f.name: f.dataType for f in rows.schema}
    schema = StructType(
        [*(StructField(g, fields[g]) for g in groups), StructField(item, fields[item]), StructField(n, IntegerType()), StructField("place", LongType()), StructField("held", LongType()), StructField("part", IntegerType())]
    )
    placed = rows.select(*groups, score, item, F.col(n).cast("int").alias(n)).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(positions(groups, item, n), schema)
    before = Window.partitionBy(*groups).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    exact = placed.withColumn("place", F.when(F.col("place") > 0, F.col("place") + F.coalesce(F.sum("held").over(before), F.lit(0))))
    return exact.where(F.col("place") <= F.col(n)).select(*groups, item, "place")


def best_items(passages: DataFrame, paths: DataFrame, k_passages: int = 5, k_paths: int = 3) -> DataFrame:
    """(kind, question_id, item_id, place). An item listed repeatedly counts once, with its highest score; null and NaN scores are left out."""

    def one(rows: DataFrame, item: str, kind: str, k: int) -> DataFrame:
        return (
            rows.where(scored(F.col("score")))
            .groupBy("question_id", F.col(item).alias("item_id"))
            .agg(F.max("score").alias("score"))
            .select(F.lit(kind).alias("kind"), "question_id", "item_id", "score", F.lit(k).alias("n"))
        )

    return top_n(one(passages, "chunk_id", "passage", k_passages).union(one(paths, "path_id", "path", k_paths)), ["kind", "question_id"], "score", "item_id", "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_items(table(spark, sf_dir, "passages"), table(spark, sf_dir, "paths")).select("kind", "question_id", "item_id")


QUERIES = {"p5_found": p5_found}
SQL = {
    "p5_found": """
        with p as (
            select 'passage' as kind, question_id, chunk_id as item_id, max(score) as score, 5 as k from passages
            where score is not null and not isnan(score) group by question_id, chunk_id
            union all
            select 'path', question_id, path_id, max(score), 3 from paths
            where score is not null and not isnan(score) group by question_id, path_id)
        select kind, question_id, item_id from p
        qualify row_number() over (partition by kind, question_id order by score desc, item_id nulls first) <= k""",
}
