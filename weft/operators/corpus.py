"""Corpus preparation: splits, merging of text variants, distractors, single-hop facts, batches, incremental load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import hash_order, spacing_key


def stratified_split(rows: DataFrame, key: str, stratum: str, n_dev: int, n_test: int, seed: str) -> DataFrame:
    """(key, stratum, part): of each stratum, in a seeded order, the first n_dev are dev, the next n_test test, the others left out."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, F.concat(stratum, F.lit(":"), key)), key))
    got = rows.where(F.col(stratum).isNotNull()).select(key, stratum, place.alias("p")).where(F.col("p") <= n_dev + n_test)
    return got.select(key, stratum, F.when(F.col("p") <= n_dev, "dev").otherwise("test").alias("part"))


def merged_corpus(raw: DataFrame) -> DataFrame:
    """(chunk_id, title, key, text, variants, uses, kept_apart) of raw paragraphs (title, text).

    Texts of a title that differ only in blanks around punctuation are one chunk, stored as the variant used most (ties: the smallest); really
    different texts are all kept, with a short hash of their key in the id.
    """
    use = raw.groupBy("title", "text").agg(F.count("*").alias("uses")).withColumn("key", spacing_key(F.col("text")))
    best = F.min_by("text", F.struct(-F.col("uses"), F.col("text")))
    one = use.groupBy("title", "key").agg(best.alias("text"), F.count("*").alias("variants"), F.sum("uses").alias("uses"))
    many = one.groupBy("title").agg((F.count("*") > 1).alias("kept_apart"))
    out = one.join(many, "title")
    hashed = F.concat("title", F.lit("#"), F.substring(F.sha1("key"), 1, 8))
    return out.select(F.when(F.col("kept_apart"), hashed).otherwise(F.col("title")).alias("chunk_id"), "title", "key", "text", "variants", "uses", "kept_apart")


def collision_log(merged: DataFrame) -> DataFrame:
    """(title, kind, id, ids, variants): merged_spacing_variants for a chunk of several texts, kept_apart for a title of several chunks."""
    spacing = merged.where("variants > 1").select("title", F.lit("merged_spacing_variants").alias("kind"), F.col("chunk_id").alias("id"), F.lit(None).cast("string").alias("ids"), "variants")
    apart = merged.where("kept_apart").groupBy("title").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), "|").alias("ids"))
    return spacing.union(apart.select("title", F.lit("kept_apart"), F.lit(None).cast("string"), "ids", F.lit(None).cast("bigint")))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch, place): rows in the order of their keys, size to a batch. Positions are prefix sums over hash-free range buckets: the global order needs no single task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from weft.sources.tables import cut

    placed = cut(rows.select(key).repartitionByRange(parts, key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    per = placed.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    start = per.select("p", "m0", (F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    at = F.col("before") + F.col("m") - F.col("m0")
    return placed.join(F.broadcast(start), "p").select(key, F.floor(at / size).cast("bigint").alias("batch"), (at % size).alias("place"))


def distractors(gold: DataFrame, pool: DataFrame, n: int, seed: str) -> DataFrame:
    """(question_id, chunk_id, role): a question's gold chunks, and n others of pool (question_id, chunk_id) in a seeded order."""
    rest = pool.join(gold, ["question_id", "chunk_id"], "left_anti").distinct()
    order = Window.partitionBy("question_id").orderBy(hash_order(seed, F.concat("question_id", F.lit(":"), "chunk_id")), "chunk_id")
    some = rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return gold.distinct().select("question_id", "chunk_id", F.lit("gold").alias("role")).union(some.select("question_id", "chunk_id", F.lit("distractor")))


def load_diff(stored: DataFrame, wanted: DataFrame, model: str) -> DataFrame:
    """(id, action): insert, update, delete or unchanged, by a hash of model, title and text of both sides (id, title, text)."""
    digest = F.sha1(F.concat_ws("\n", F.lit(model), "title", "text"))
    a, b = stored.select("id", digest.alias("old")), wanted.select("id", digest.alias("new"))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("unchanged")
    return a.join(b, "id", "full_outer").select("id", kind.alias("action"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of a request as canonical JSON, keys sorted."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
