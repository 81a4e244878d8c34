"""JSON lines, JSON documents, append-only tables and a response cache in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a declared schema; a line that is no such object gives a row of nulls, which callers may count."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON document of many lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One object a line, UTF-8 unescaped; in one order over all parts if it is given."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def verified(spark: SparkSession, path: str, sums: dict[str, str]) -> DataFrame:
    """(name, ok): whether each file's SHA-256 is the pinned one."""
    got = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sum"))
    want = spark.createDataFrame(list(sums.items()), "name string, want string")
    return want.join(got, "name", "left").select("name", F.coalesce(F.col("sum") == F.col("want"), F.lit(False)).alias("ok"))


def request_key(*fields: Column) -> Column:
    """SHA-256 of a request as JSON with its fields in the given order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def cached_calls(requests: DataFrame, cache: DataFrame, call) -> tuple[DataFrame, DataFrame]:
    """(answers, new) of requests (key, ...): answers (key, text, cached) of all, new (key, text) those that cache (key, text) lacked.

    call takes the distinct missing requests as a DataFrame and gives (key, text); callers append new to the cache.
    """
    missing = requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = call(missing)
    held = requests.select("key").distinct().join(cache.select("key", "text"), "key").withColumn("cached", F.lit(True))
    return held.union(new.select("key", "text", F.lit(False))), new


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds (ts, model, provider, input_tokens, output_tokens, cost_usd) to the ledger; rows are never rewritten."""
    rows.select("ts", "model", "provider", "input_tokens", "output_tokens", "cost_usd").write.mode("append").parquet(path)


def ledger_total(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def upsert(stored: DataFrame, wanted: DataFrame, key: str, model: str) -> DataFrame:
    """The store after an incremental load: wanted rows, each with its digest and whether its vector must be made anew (new, or changed title or text)."""
    digest = F.sha1(F.concat_ws("\n", F.lit(model), "title", "text"))
    old = stored.select(key, digest.alias("old"))
    return wanted.withColumn("digest", digest).join(old, key, "left").withColumn("embed", ~F.col("digest").eqNullSafe(F.col("old"))).drop("old")
