"""Problem 8: records of several sources mixed to target shares, as token blocks drawn by index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from weft.llm.tokens import token_ids
from weft.sources.tables import cut, table

#: Tokens of a block; the last block of a source has what is left. Short, so that a source of a few hundred tokens has several.
BLOCK = 32
#: Blocks of an output shard.
SHARD = 2048
#: Hash buckets of a source whose token counts are summed up to offsets.
BUCKETS = 512
SEED = 17


def packed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, ids): the documents (doc_id, source, ids) of each source one after another in hash order, cut into blocks.

    Offsets are prefix sums in two steps: over at most BUCKETS buckets of a source, then within a bucket, so that a source of any
    size is spread over many tasks.
    """
    one = docs.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n"), F.xxhash64("doc_id").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    one = one.where("n > 0")
    per = one.groupBy("source", "bucket").agg(F.sum("n").alias("held"))
    base = per.select("source", "bucket", (F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("upto", F.sum("n").over(inside)).join(base, ["source", "bucket"]).withColumn("first", F.expr("base + upto - n"))
    parts = placed.select("source", "first", "n", "ids", F.explode(F.expr(f"sequence(first div {block}, (first + n - 1) div {block})")).alias("block"))
    cuts = parts.select(
        "source",
        "block",
        F.expr(f"greatest(block * {block}, first)").alias("at"),
        F.expr(f"slice(ids, cast(greatest(block * {block} - first, 0) as int) + 1, cast(least((block + 1) * {block}, first + n) - greatest(block * {block}, first) as int))").alias("piece"),
    )
    return cuts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("ids"))


def feistel(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(size), taken at index: a Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(rounds):
            z = b + np.uint64((key * 1_000_003 + r * 7_919 + 1) % (1 << 63))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= size).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def shard_counts(wanted: np.ndarray, shard: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): each shard's counts are multinomial in the shares, drawn under the condition that all shards together take
    exactly what is wanted of each source (the multinomial given its margins, which is the multivariate hypergeometric)."""
    rng, left, out = np.random.default_rng(seed), wanted.astype(np.int64).copy(), []
    while left.sum() > 0:
        k = int(min(shard, left.sum()))
        if left.sum() < 10**9:
            row = rng.multivariate_hypergeometric(left, k, method="marginals")
        else:  # drawing without replacement from so many is drawing with it, but for what is used up
            row = np.minimum(rng.multinomial(k, left / left.sum()), left)
        out.append(row)
        left = left - row
    return np.array(out or [np.zeros(len(wanted), np.int64)])


def plan_mixture(sizes: pd.DataFrame, shard: int = SHARD, seed: int = SEED) -> tuple[pd.DataFrame, pd.DataFrame]:
    """sizes: source, target_share, max_repeats, blocks, one row per source. Gives the sources with the blocks wanted of each, and
    (shard, source, slots, first): first counts the source's slots in the shards before.

    The mixture is the largest whose sources all reach their share with no block used more than max_repeats times. A
    source with no block, or no or a negative target, takes no part and the others keep their shares among themselves.
    """
    s = sizes[(sizes.blocks > 0) & (sizes.target_share > 0) & (sizes.max_repeats > 0)].sort_values("source").reset_index(drop=True)
    share = s.target_share / s.target_share.sum() if len(s) else s.target_share
    total = float((s.blocks * s.max_repeats / share).min()) if len(s) else 0.0
    s = s.assign(wanted=np.minimum(np.floor(total * share + 1e-9), s.blocks * s.max_repeats).astype(np.int64))
    counts = shard_counts(s.wanted.to_numpy(), shard, seed) if len(s) else np.zeros((0, 0), np.int64)
    first = np.cumsum(counts, axis=0) - counts
    rows = [(i, s.source[j], int(counts[i, j]), int(first[i, j])) for i in range(len(counts)) for j in range(len(s)) if counts[i, j]]
    return s, pd.DataFrame(rows, columns=["shard", "source", "slots", "first"])


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture as rows (shard, slot, source, block, pass, n_tokens, ids), and a row per source of what is reached.

    Documents without a source or without text (null, empty or blank) take no part, nor does one of a source that targets doesn't name. A
    source's slots go through it in passes, each pass in another pseudorandom order, so that no block comes more than once a pass.
    Driver-side are only the sources of targets and one row per shard and source.
    """
    spark = documents.sparkSession
    want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.where(F.col("source").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}\p{C}]")).select("doc_id", "source", "text")
    docs = docs.join(want.select("source"), "source", "left_semi").select("doc_id", "source", token_ids(F.col("text")).alias("ids"))
    blocks = cut(packed(docs, block).withColumn("n_tokens", F.size("ids")))
    held = blocks.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens"))
    sizes = want.join(held, "source", "left").fillna(0, ["blocks", "tokens"]).toPandas()
    plan, cells = plan_mixture(sizes, shard, seed)
    schema = StructType([StructField("shard", IntegerType()), StructField("source", StringType()), StructField("slots", IntegerType()), StructField("first", LongType()), StructField("blocks", LongType()), StructField("salt", IntegerType())])
    number = {s: i for i, s in enumerate(plan.source)}
    of = dict(zip(plan.source, plan.blocks))
    small = spark.createDataFrame([(int(r.shard), r.source, int(r.slots), int(r.first), int(of[r.source]), number[r.source]) for r in cells.itertuples()], schema)

    @F.pandas_udf(LongType())
    def drawn(j: pd.Series, size: pd.Series, salt: pd.Series) -> pd.Series:
        out = np.zeros(len(j), np.int64)
        at, n, c = j.to_numpy(), size.to_numpy(), salt.to_numpy()
        for n_, c_, p in set(zip(n, c, at // n)):
            m = (n == n_) & (c == c_) & (at // n == p)
            out[m] = feistel(at[m] % n_, int(n_), int(seed + 1009 * c_ + 65_537 * p))
        return pd.Series(out)

    slots = small.repartition(max(1, min(len(cells), 2 * spark.sparkContext.defaultParallelism)), "shard").select("shard", "source", "blocks", "salt", F.posexplode(F.expr("sequence(first, first + slots - 1)")).alias("i", "j"))
    slots = slots.select("shard", "source", F.expr("int(j div blocks) + 1").alias("pass"), drawn("j", "blocks", "salt").alias("block"), F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "source", "j"), "source", "j")).alias("slot"))
    mixed = slots.join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "pass", "n_tokens", "ids")
    used = slots.join(blocks.select("source", "block", "n_tokens"), ["source", "block"]).groupBy("source").agg(F.count("*").alias("blocks_used"), F.sum("n_tokens").alias("tokens_used"), F.max("pass").alias("repeats"))
    all_used = used.agg(F.sum("tokens_used").alias("all_used"))
    report = (
        spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats), int(r.blocks), int(r.tokens)) for r in sizes.itertuples() if r.target_share == r.target_share and r.max_repeats == r.max_repeats], "source string, target_share double, max_repeats int, blocks_held long, tokens_held long")
        .join(used, "source", "left")
        .join(F.broadcast(all_used))
        .select("source", "target_share", "max_repeats", "blocks_held", "tokens_held", F.coalesce("blocks_used", F.lit(0)).alias("blocks_used"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.round(F.coalesce("tokens_used", F.lit(0)) / F.col("all_used"), 6).alias("reached_share"))
    )
    return mixed, report


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the mixture with its tokens."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: target, what it holds, what is used and the share reached."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
