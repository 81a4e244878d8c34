"""Incremental variants: spending by time window, and the corpus kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.sources.files import upsert


def spending(ledger: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, provider, calls, cost_usd) of a ledger stream (ts, provider, cost_usd); rows more than late behind are dropped by the watermark."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", window), "provider").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def keep_corpus(chunks: DataFrame, path: str, checkpoint: str, model: str) -> StreamingQuery:
    """Writes each batch of a chunk stream (id, title, text, loaded_at) as a version of the store under path: the newest row of an id, with its digest and embed flag.

    Versions are folders v=<batch>; a batch that is run again writes the same folder again.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        newest = batch.where("id is not null").groupBy("id").agg(F.max_by(F.struct("title", "text"), F.struct("loaded_at", "title", "text")).alias("r")).select("id", "r.*")
        empty = spark.createDataFrame([], "id string, title string, text string")
        stored = current(spark, path, n) if n else empty
        got = upsert(stored, newest, "id", model)
        rest = stored.join(newest.select("id"), "id", "left_anti") if n else empty
        rest = rest.withColumn("digest", F.sha1(F.concat_ws("\n", F.lit(model), "title", "text"))).withColumn("embed", F.lit(False))
        got.select("id", "title", "text", "digest", "embed").unionByName(rest.select("id", "title", "text", "digest", "embed")).write.mode("overwrite").parquet(f"{path}/v={n}")

    return chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The store as the batch before left it."""
    return spark.read.parquet(f"{path}/v={before - 1}").select("id", "title", "text")
