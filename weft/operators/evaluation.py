"""Answer scores, bootstrap intervals and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import normalize_answer

#: Answers that are right as a whole or not at all.
WHOLE = ["yes", "no", "noanswer"]


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def f1(prediction: Column, gold: Column) -> Column:
    """F1 over the words of the normalised answers, a word as often as both have it; 0 if one is a whole answer and they differ, or without a common word."""
    p, g = normalize_answer(prediction), normalize_answer(gold)
    pw, gw = (F.filter(F.split(x, " "), lambda w: w != "") for x in (p, g))
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    common = F.aggregate(F.array_distinct(pw), F.lit(0), lambda s, w: s + F.least(count(pw, w), count(gw, w)))
    whole = (p.isin(WHOLE) | g.isin(WHOLE)) & (p != g)
    return F.when(whole | (common == 0), 0.0).otherwise(2.0 * common / (F.size(pw) + F.size(gw)))


def bootstrap(rows: DataFrame, group: str, order: str, value: str, resamples: int, seed: str = "0") -> DataFrame:
    """(group, mean, ci_low, ci_high, n): percentile bootstrap of the mean with hash-drawn indices, the same in every engine.

    Index i of resample r is a hash of (seed, r, i) modulo n. A group's values are an array, so that no resample is shuffled; a
    group is the questions of one system, whose number is bounded by the benchmark.
    """
    one = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("v"))
    each = one.select(group, "v", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"))
    drawn = F.expr(f"aggregate(sequence(1, size(v)), 0D, (s, i) -> s + v[cast(conv(substr(md5(concat_ws(':', '{seed}', r, i)), 1, 8), 16, 10) as bigint) % size(v)]) / size(v)")
    means = each.withColumn("m", drawn).groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    mean = one.select(group, (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("mean"), F.size("v").cast("bigint").alias("n"))
    return mean.join(means, group).select(group, F.round("mean", 4).alias("mean"), F.round("lo", 4).alias("ci_low"), F.round("hi", 4).alias("ci_high"), "n")


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, n, em, f1, unknown_rate, answered_n, answered_em, answered_f1) over each type, multi_hop and all; groups without rows are absent."""
    labels = F.array_compact(F.array(F.when(F.col("type").isNotNull(), F.col("type")), F.when(F.col("type") != "single_hop", "multi_hop"), F.lit("all")))
    known = ~F.coalesce(F.col("unknown"), F.lit(False))
    return (
        rows.withColumn("grp", F.explode(labels))
        .groupBy(*keys, "grp")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("em"), 4).alias("em"),
            F.round(F.avg("f1"), 4).alias("f1"),
            F.round(F.avg((~known).cast("double")), 4).alias("unknown_rate"),
            F.count(F.when(known, 1)).alias("answered_n"),
            F.round(F.avg(F.when(known, F.col("em"))), 4).alias("answered_em"),
            F.round(F.avg(F.when(known, F.col("f1"))), 4).alias("answered_f1"),
        )
    )


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
